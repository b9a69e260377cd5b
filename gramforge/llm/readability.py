"""Reading level of English prose (problem 8).

Per document: markup, mail headers and bibliographic tags are taken off, the
rest is cut into paragraphs and sentences, sentences of English prose are told
from notices, logs, sequences and other languages by their share of English
function words, and the prose is graded by six classic readability formulas
over sentence lengths, letters and syllables.  The median of the six grades is
the document's grade; grade limits, fitted on a bounded sample of rated
documents (:func:`fit_limits`), give one of four levels.

Everything runs in one ``mapInArrow`` pass over ``(id, text)``: no shuffle, no
state between documents, whole texts.

Edge cases: null, empty or blank text -> no prose (``is_prose`` false,
``sentences`` 0, null grade and level).  Null ids are kept.  Repeated rows are
graded each by itself.  An empty table gives an empty result with the same
columns.  Extra input columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# English function words (determiners, pronouns, auxiliaries,
# conjunctions, adverbs).  Running English prose has them at every turn;
# telegraphic notices, records and other languages don't.
FUNCTION_WORDS = frozenset(
    """
    a an the this that these those my your his her its our their some each every any another both few most neither nor
    i he she it we they you him them us who which whose what
    is are was were be been being has have had do does did will would can could may might must shall should cannot not never
    but because so when while until after before although though since if than as whereas insofar inasmuch
    notwithstanding nevertheless consequently however there then once soon just already also only too very
    """.split()
)

# Words that begin a sentence when they are capitalised within text.
STARTERS = FUNCTION_WORDS | frozenset("no and or during early around in on at for by with without before until under most from look did thanks as of to".split())

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("approx", "fig", "figs", "eq", "dr", "mr", "mrs", "ms", "prof", "st", "no", "vol", "vs", "etc", "cf", "e.g", "i.e", "p.m", "a.m", "al", "jr", "sr", "ch", "sec", "ref", "pp", "p")

# School grades at which primary school, lower secondary and upper secondary
# end, roughly.  They serve where there are no ratings; else use fit_limits.
DEFAULT_LIMITS = (5.2, 11.2, 15.9)

_TAG_BLOCK = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|table|body|html|head|title|blockquote|pre)\b)[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*+>")
_OPEN = re.compile(r"<(script|style)\b|<!--", re.I)
_CLOSE = {"script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I), None: re.compile("-->")}
_HEADER = re.compile(r"^(?:From|To|Cc|Bcc|Subject|Date|Sent|Reply-To|Message-ID|X-[\w-]+|Content-[\w-]+|Mime-Version):.*$", re.M | re.I)
_BIB = re.compile(r"^#[*@%tcindex].*$", re.M)
_LABEL = re.compile(r"^(?:#!\s*)?(?:Abstract\.\s*)?", re.M)
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
_ATTRIBUTION = re.compile(r"^.{0,120}\bwrote:[ \t]*$", re.M)
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_CITE = re.compile(r"(?<!\s)\s*+(?:\((?:see\s+)?Fig[^()]*\)|\(p\s*[<=>][^()]*\)|\[\d+(?:[,\s\d-]*)\])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"(?<![.!?])[.!?]++[\"'”’)\]]*+(?=\s|$)")
_BULLET = re.compile(r"^\s*(?:[•*–—·-]|\d{1,3}[.)])\s+")
_LOST = re.compile(r"(?<![a-z0-9])([a-z0-9]{2,}+)\s++([A-Z][a-z]*)(?=\s+[a-z])")
_SPACE = re.compile(r"\s*+")
WINDOW = 200
_VOWELS = re.compile(r"[aeiouy]+")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of one lower-case word by hyphenation-style rules.

    Vowel groups are counted; a silent final ``e``, ``es`` or ``ed`` is taken
    off, and the usual hiatus groups (``ia``, ``io`` outside ``tion``/``sion``,
    ``eo``, ``ua``, ...) are split.  Never less than one.
    """
    if "-" in word:
        return sum(map(syllables, filter(None, word.split("-")))) or 1
    w = word.replace("'", "").replace("’", "")
    n = len(_VOWELS.findall(w))
    if w.endswith("e") and not w.endswith(("le", "ee", "ie", "ye", "oe", "ue")) and n > 1:
        n -= 1
    elif w.endswith("le") and len(w) > 2 and w[-3] in "aeiouy" and n > 1:
        n -= 1
    elif w.endswith("ed") and len(w) > 3 and w[-3] not in "tdaeiouy" and n > 1:
        n -= 1
    elif w.endswith("es") and len(w) > 3 and w[-3] not in "sxzcgaeiouy" and not w.endswith(("shes", "ches")) and n > 1:
        n -= 1
    n += len(re.findall(r"i(?:a(?!l\b|n\b|t)|o(?!n|us\b))|eo(?!n\b|us\b)|[^q]ua(?!r)|[^aeiouy]ism\b|uous|[aeiou]ing\b", w))
    return max(n, 1)


def without_scripts(text: str) -> str:
    """Text without scripts, styles and comments; one that is never closed stays.  Goes through the text once."""
    out, at, open_for_good = [], 0, set()
    for m in _OPEN.finditer(text):
        kind = m.group(1).lower() if m.group(1) else None
        if m.start() < at or kind in open_for_good:
            continue
        end = _CLOSE[kind].search(text, m.end())
        if end is None:
            open_for_good.add(kind)
            continue
        out += [text[at : m.start()], " " if kind else ""]
        at = end.end()
    return "".join([*out, text[at:]])


def clean(text: str) -> str:
    """Text without markup, mail headers, quote signs and bibliographic tags."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = _TAG.sub("", _TAG_BLOCK.sub("\n\n", without_scripts(text)))
    if "&" in text:
        text = html.unescape(text)
    text = _BIB.sub("\n", _ATTRIBUTION.sub("\n", _HEADER.sub("\n", text)))
    return _LABEL.sub("", _QUOTE.sub("", text))


def lines_or_flow(paragraph: str) -> list[str]:
    """A list (bulleted, or nearly every line beginning as a sentence does) by its lines; running text as one piece."""
    lines = [x for x in paragraph.split("\n") if x.strip()]
    if len(lines) > 1:
        bare = [_BULLET.sub("", x) for x in lines]
        if sum(x[:1].isupper() for x in bare) >= 0.8 * len(lines):
            return bare
    return [_BULLET.sub("", " ".join(lines))] if lines else []


def sentences(paragraph: str) -> list[str]:
    """Sentences of running text.

    Abbreviations, initials and decimals end none.  Where full stops were
    lost, a capitalised function word after a word in lower case begins one.
    """
    out = []
    for piece in _stops(paragraph):
        start = 0
        for m in _LOST.finditer(piece):
            if m.group(2).lower() in STARTERS:
                out.append(piece[start : m.end(1)])
                start = m.start(2)
        out.append(piece[start:])
    return out


def _stops(paragraph: str) -> list[str]:
    out, start = [], 0
    for m in _END.finditer(paragraph):
        # a window is enough: no abbreviation is longer, and a piece of white space only is no sentence
        before = paragraph[max(start, m.start() - WINDOW) : m.start()]
        last = before.rsplit(None, 1)[-1].lower().lstrip("([\"'") if before.strip() else ""
        at = _SPACE.match(paragraph, m.end()).end()
        after = paragraph[at : at + 1]
        if m.group()[0] == "." and after and (last in ABBREVIATIONS or (len(last) == 1 and last.isalpha()) or after.islower()):
            continue
        if before.strip():
            out.append(paragraph[start : m.end()].strip())
        start = m.end()
    if paragraph[start:].strip():
        out.append(paragraph[start:].strip())
    return out


def measure(text: str | None) -> tuple:
    """(prose sentences, words, syllables, letters, words of three syllables and more, prose share of all characters but white space)."""
    if not text:
        return 0, 0, 0, 0, 0, 0.0
    n = words = sylls = letters = hard = inside = total = 0
    for para in _PARAGRAPH.split(clean(text)):
        total += sum(map(len, para.split()))
        for s in (s for x in lines_or_flow(_CITE.sub("", para)) for s in sentences(x)):
            ws = _WORD.findall(s.lower())
            if len(ws) < 3:
                continue
            own = sum(map(FUNCTION_WORDS.__contains__, ws))
            if own < 0.1 * len(ws) or own < 1:
                continue
            parts = s.split()
            if len(ws) < 0.6 * len(parts):
                continue
            n += 1
            words += len(ws)
            inside += sum(map(len, parts))
            counts = list(map(syllables, ws))
            sylls += sum(counts)
            hard += sum(c >= 3 for c in counts)
            letters += sum(map(len, ws))
    return n, words, sylls, letters, hard, inside / total if total else 0.0


def grades(n: int, words: int, sylls: int, letters: int, hard: int) -> tuple[float, ...]:
    """Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, automated readability and Linsear-Write grades."""
    per, syl, let = words / n, sylls / words, letters / words
    linsear = (words - hard + 3 * hard) / n
    return (
        0.39 * per + 11.8 * syl - 15.59,
        0.4 * (per + 100 * hard / words),
        1.043 * (30 * hard / n) ** 0.5 + 3.1291,
        5.88 * let - 29.6 * n / words - 15.8,
        4.71 * let + 0.5 * per - 21.43,
        linsear / 2 if linsear > 20 else linsear / 2 - 1,
    )


SCHEMA = "doc_id long, sentences int, words int, syllables int, prose_share double, grade double, is_prose boolean, reading_level int"
_TYPES = pa.schema([("doc_id", pa.int64()), ("sentences", pa.int32()), ("words", pa.int32()), ("syllables", pa.int32()), ("prose_share", pa.float64()), ("grade", pa.float64()), ("is_prose", pa.bool_()), ("reading_level", pa.int32())])

LEAST_SENTENCES = 3
LEAST_SHARE = 0.5
SAMPLE = 20_000


def _grade(limits: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in _TYPES)
            ids, texts, *carried = batch.columns
            for doc_id, text in zip(ids.to_pylist(), texts):
                n, words, sylls, letters, hard, share = measure(text.as_py())
                grade = median(grades(n, words, sylls, letters, hard)) if words else None
                prose = n >= LEAST_SENTENCES and share >= LEAST_SHARE
                level = 1 + sum(grade > x for x in limits) if prose else None
                for column, x in zip(out, (doc_id, n, words, sylls, share, grade, prose, level)):
                    column.append(x)
            columns = [pa.array(c, f.type) for c, f in zip(out, _TYPES)]
            yield pa.RecordBatch.from_arrays([*columns, *carried], names=[*_TYPES.names, *("carried" for _ in carried)])

    return run


def reading_levels(docs: DataFrame, limits: tuple[float, ...] = DEFAULT_LIMITS, carry: str | None = None) -> DataFrame:
    """One row per document ``(doc_id, text)``: its counts, median grade, whether it is mainly English prose, and if so its level (1 to 4).

    ``carry`` names one more (string) column to pass through.
    """
    rows = docs.select("doc_id", "text", *([F.col(carry).cast("string").alias("carried")] if carry else []))
    return rows.mapInArrow(_grade(limits), SCHEMA + (f", `{carry}` string" if carry else ""))


def rated_levels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(grade, rating)`` of at most ``sample`` rated documents of English prose, chosen by a hash of the id: the median rating of each.

    Null ratings don't count and copies of a rating count once.
    """
    rated = labels.select("doc_id", "rater", "reading_level").filter("reading_level is not null").distinct().groupBy("doc_id").agg(F.expr("percentile_disc(0.5) within group (order by reading_level)").alias("rating"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi")
    return reading_levels(own).filter("is_prose").join(chosen, "doc_id").select("grade", "rating")


def fit_limits(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """Grade limits that misjudge the fewest of the :func:`rated_levels`; of limits that are equally good the middle one.

    A limit without any rated document on either side is the default one.
    """
    rows = rated_levels(docs, labels, sample).collect()
    limits = []
    for cut, default in enumerate(DEFAULT_LIMITS, 1):
        above = sorted((r.grade, r.rating > cut) for r in rows)
        if not above or all(up for _, up in above) or not any(up for _, up in above):
            limits.append(default)
            continue
        wrong = best = sum(not up for _, up in above)  # all counted as above
        at = [above[0][0]]
        for k, (g, up) in enumerate(above[:-1]):
            wrong += 1 if up else -1
            if wrong < best:
                best, at = wrong, []
            if wrong == best:
                at.append((g + above[k + 1][0]) / 2)
        limits.append(at[len(at) // 2])
    return tuple(sorted(limits))
