"""Evaluation texts inside training text (problem 7).

Latent semantic retrieval with an exact check of the order of words:

1. **Items.** Standing instructions are taken off: sentences at the head of an
   item that begin a share of ``STANDING`` of all different items (three at
   least), as long as they are less than half of the item's words
   (:func:`standing_sentences` reports them); what is left is the item's own
   passage.  The items are a query set of bounded size: they are handled in
   blocks whose latent basis is at most ``BASIS_BYTES``, and only a block's
   vocabulary goes to the tasks.
2. **TF-IDF passages.** Texts are cut into passages of ``2 * STRIDE`` words that
   overlap by half.  Terms are pairs of words of the items' passages that are
   adjacent or have one word between them, so that a passage with every second
   word replaced still has terms; document frequencies are counted over all
   documents.
3. **Distributed randomised SVD.** The latent space is fitted on all item
   passages and a bounded sample of corpus passages (``SAMPLE``, chosen by a
   hash of the text; both sides weigh the same): A'(A W) is summed over
   partitions and orthonormalised on the driver, again for a power iteration,
   and a last time to rotate the basis to the singular directions.
4. **Cosine search.** Every passage of every document is folded into the space
   and compared with all items in one matrix product; every pair at or above
   ``COSINE`` is a candidate.  There is no top k and no cap.
5. **Check.** Around a candidate the longest common subsequence is taken twice:
   of word triples (Hunt-Szymanski over their matches, in order), whose
   covered words are the letter-by-letter part, and of single words in a span
   of one and a half passages (bit-parallel).  A pair is a leak if the triples
   cover ``SHARE`` of the item's words, or if the words do and the triples
   still cover half of that; for a paraphrase, whose triples are broken,
   the words must cover ``SHARE`` and a quarter more and the item's rarest
   words (its answer) must be there, or triples of every second word must
   cover ``SHARE``.

Steps 4 and 5 run in one pass over the documents without a shuffle; texts are
whole and never leave their task.

Edge cases: null or empty texts and items have no passages and give no rows;
an item without own words is never found; equal items and equal documents are
found each by itself; items and documents may be as long as they like; extra
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.plans.cut import checkpointed

STANDING = 0.02
STRIDE = 32
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 3
SAMPLE, SAMPLE_TASKS = 20_000, 3
COSINE = 0.25
SHARE = 0.4
BASIS_BYTES = 64 << 20

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]*>")
_HYPHEN = re.compile(r"(?<=[a-z])-\s*\n\s*(?=[a-z])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    """Lower-case words without typography: markup, ligatures, soft hyphens, entities and line breaks in words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "").replace("‍", "").replace("﻿", "")
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).replace("­", "")
    text = text.lower()
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text)


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s.strip()]


def standing_sentences(texts: list[str]) -> dict[str, int]:
    """The sentences that are taken as standing instructions, with the number of different texts they begin.

    A sentence that follows other standing ones at the head of a text counts as
    beginning it, too.
    """
    different = [_sentences(t) for t in sorted({t for t in texts if t})]
    least = max(3, STANDING * len(different))
    found: dict[str, int] = {}
    while True:
        heads = Counter(next((s for s in cut if s not in found), None) for cut in different)
        new = {s: n for s, n in heads.items() if s is not None and n >= least}
        if not new:
            return found
        found |= new


def own_passages(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """The words of each item without the standing instructions at its head; the whole item where they are half of it or more."""
    standing = standing_sentences([t for _, t in items])
    out = {}
    for i, t in items:
        if t:
            cut = _sentences(t)
            head = next((k for k, s in enumerate(cut) if s not in standing), len(cut))
            whole, own = words(t), words(" ".join(cut[head:]))
            out[i] = own if 2 * len(own) > len(whole) else whole
    return out


class Vocabulary:
    """The words of a block of items and the pairs of adjacent ones that are its terms."""

    def __init__(self, passages: list[list[str]]) -> None:
        self.ids = {w: k for k, w in enumerate(sorted({w for p in passages for w in p}))}
        self.n = len(self.ids) + 1
        found = [self.pairs(self.number(p), apart) for p in passages for apart in (1, 2)]
        self.terms = np.unique(np.concatenate([f[f >= 0] for f in found])) if found else np.zeros(0, np.int64)

    def number(self, ws: list[str]) -> np.ndarray:
        """Word numbers; -1 for a word that no item has."""
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))

    def pairs(self, numbers: np.ndarray, apart: int = 1) -> np.ndarray:
        """Keys of the pairs of words ``apart`` from each other that begin at each word; -1 where a word is unknown."""
        if len(numbers) <= apart:
            return np.zeros(0, np.int64)
        a, b = numbers[:-apart], numbers[apart:]
        return np.where((a >= 0) & (b >= 0), (a * self.n + b) * 2 + apart - 1, -1)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms) of the terms in a sequence of word numbers, in order of their positions."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        positions, found = [], []
        for apart in (1, 2):
            keys = self.pairs(numbers, apart)
            at = np.flatnonzero(keys >= 0)
            place = np.searchsorted(self.terms, keys[at])
            good = self.terms[np.minimum(place, len(self.terms) - 1)] == keys[at]
            positions.append(at[good])
            found.append(place[good])
        at = np.concatenate(positions)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(found)[order]


_STATS = pa.schema([("term", pa.int32()), ("n", pa.int64()), ("sample", pa.list_(pa.int32()))])
STATS_SCHEMA = "term int, n long, sample array<int>"


def _count(vocabulary: Vocabulary, modulus: int):
    """Document frequencies of the task's documents, and the passages of those whose hash is drawn for the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary.terms), np.int64)
        for batch in batches:
            drawn: list[np.ndarray] = []
            for text, code in zip(batch.column(0), batch.column(1).to_pylist()):
                at, terms = vocabulary.hits(vocabulary.number(words(text.as_py())))
                df[np.unique(terms)] += 1
                if code % modulus == 0 and len(terms):
                    block = at // STRIDE
                    drawn += [terms[(block == b) | (block == b + 1)] for b in range(int(block[-1]) + 1)]
            drawn = [x for x in drawn if len(x) > 1]
            if drawn:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(drawn), pa.int32()), pa.nulls(len(drawn), pa.int64()), pa.array([x.astype(np.int32) for x in drawn], pa.list_(pa.int32()))], schema=_STATS)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen]), pa.nulls(len(seen), pa.list_(pa.int32()))], schema=_STATS)

    return run


def _rows(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows as (row of each entry, term, value)."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    term = np.concatenate(passages).astype(np.int64) if passages else np.zeros(0, np.int64)
    key, n = np.unique(row * len(idf) + term, return_counts=True)
    row, term = key // len(idf), key % len(idf)
    value = n * idf[term]
    norm = np.sqrt(np.bincount(row, value**2, len(passages)))
    return row, term, (value / np.maximum(norm[row], 1e-12)).astype(np.float32)


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by index, as a dense matrix."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    _add_by(out, index, rows)
    return out


def _add_by(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Rows added to ``out`` by index."""
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        start = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[start]] += np.add.reduceat(rows[order], start, axis=0)


def _fold(term: np.ndarray, weight: np.ndarray, first: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Weighted sums of the basis rows of consecutive stretches of terms; stretches of one length are one batched product."""
    length = np.diff(first, append=len(term))
    out = np.empty((len(first), basis.shape[1]), np.float32)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        at = first[rows][:, None] + np.arange(n)
        out[rows] = (weight[at][:, None, :] @ basis[term[at]])[:, 0]
    return out


def _gram_product(passages: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, out: np.ndarray, block: int = 64) -> None:
    """A' (A basis) of these passages added to ``out``, a block at a time, so that little more than the result is held."""
    for a in range(0, len(passages), block):
        row, term, value = _rows(passages[a : a + block], idf)
        left = _sum_by(row, value[:, None] * basis[term], min(block, len(passages) - a))
        _add_by(out, term, value[:, None] * left[row])


_SCALE = np.float32(1024)  # keeps the entries of an orthonormal basis in the range of half precision


def _halved(a: np.ndarray) -> np.ndarray:
    """Half precision for the way between driver and tasks; its relative error of 2**-11 doesn't matter to a subspace or a cosine."""
    return (a * _SCALE).astype(np.float16)


def _restored(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float32) / _SCALE


def _partial(idf: np.ndarray, basis: np.ndarray):
    sent = _halved(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = _restored(sent)
        total = np.zeros_like(basis)
        for batch in batches:
            _gram_product([np.array(x, np.int64) for x in batch.column(0).to_pylist()], idf, basis, total)
        used = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        total = total[used]
        scale = np.float32(np.abs(total).max(initial=1e-6))
        yield pa.RecordBatch.from_pydict({"terms": [used.tobytes()], "sums": [_halved(total / scale).tobytes()], "scale": [float(scale)]})

    return run


def _turn(a: np.ndarray, by: np.ndarray, rows: int = 2048) -> None:
    """``a @ by`` in place, some rows at a time."""
    by = by.astype(np.float32)
    for k in range(0, len(a), rows):
        a[k : k + rows] = a[k : k + rows] @ by


def _orthonormalise(a: np.ndarray, rows: int = 2048) -> None:
    """Columns that span the same space, in place; directions without weight become nothing."""
    gram = np.zeros((a.shape[1], a.shape[1]))
    for k in range(0, len(a), rows):
        part = a[k : k + rows].astype(np.float64)
        gram += part.T @ part
    weight, turn = np.linalg.eigh(gram)
    used = weight > weight.max(initial=0.0) * 1e-10
    _turn(a, turn * np.where(used, 1 / np.sqrt(np.where(used, weight, 1.0)), 0.0))


def latent_basis(sample: DataFrame, n_sample: int, items: list[np.ndarray], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Orthonormal columns (terms x rank) of the leading right singular space, by distributed randomised SVD.

    ``sample(sample array<int>)`` are the corpus passages of the fit.  Their
    number is bounded by a parameter, so the partial sums of their
    ``SAMPLE_TASKS`` tasks are, too; each is (terms of the block x rank).
    """
    width = min(rank + OVERSAMPLE, len(idf))
    basis = np.random.default_rng(7).standard_normal((len(idf), width), np.float32)
    _orthonormalise(basis)
    weight = len(items) / max(n_sample, 1)
    for last in range(ITERATIONS, 0, -1):
        total = np.zeros_like(basis)
        _gram_product(items, idf, basis, total)
        for r in sample.mapInArrow(_partial(idf, basis), "terms binary, sums binary, scale double").toLocalIterator():
            used = np.frombuffer(r.terms, np.int32)
            if not len(used):
                continue
            total[used] += np.float32(weight * r.scale) * _restored(np.frombuffer(r.sums, np.float16).reshape(len(used), -1))
        if last == 1:  # the directions of the basis in order of their singular values
            _turn(basis, np.linalg.eigh((basis.T @ total).astype(np.float64))[1][:, ::-1])
        else:
            basis = total
            _orthonormalise(basis)
    return np.ascontiguousarray(basis[:, : min(rank, width)])


def triple_cover(item: np.ndarray, text: np.ndarray) -> int:
    """Words of ``item`` covered by the longest chain of its word triples that reappear in ``text`` in order."""
    places: dict[tuple, list[int]] = {}
    a = item.tolist()
    for k in range(len(a) - 3, -1, -1):  # descending: a triple of the text uses one place of the item
        places.setdefault((a[k], a[k + 1], a[k + 2]), []).append(k)
    tails: list[int] = []
    nodes: list[tuple[int, int | None]] = []
    ends: list[int] = []
    b = text.tolist()
    for k in range(len(b) - 2):
        for p in places.get((b[k], b[k + 1], b[k + 2]), ()):
            at = bisect_left(tails, p)
            nodes.append((p, ends[at - 1] if at else None))
            if at == len(tails):
                tails.append(p)
                ends.append(len(nodes) - 1)
            else:
                tails[at], ends[at] = p, len(nodes) - 1
    covered: set[int] = set()
    node = ends[-1] if ends else None
    while node is not None:
        p, node = nodes[node]
        covered.update((p, p + 1, p + 2))
    return len(covered)


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def judge(item: np.ndarray, text: np.ndarray, answer: set[int]) -> tuple[bool, float, float]:
    """(leak, share covered by triples, share of words in order) of a stretch of text."""
    n = len(item)
    exact = triple_cover(item, text) / n
    span, step = max(int(1.5 * n), 8), max(n // 4, 1)
    loose = max(common_words(item, text[a : a + span]) for a in range(0, max(len(text) - span, 0) + step, step)) / n
    there = len(answer & set(text.tolist())) / max(len(answer), 1)
    leak = exact >= SHARE or loose >= SHARE and exact >= SHARE / 2 or loose >= 1.25 * SHARE and there >= 0.5
    if not leak and loose >= SHARE:  # every second word may be replaced: triples over one word each
        leak = max(triple_cover(item[a::2], text[b::2]) for a in (0, 1) for b in (0, 1)) / n >= SHARE
    return leak, exact, loose


SCHEMA = "item_id long, doc_id long, cosine double, exact_share double, word_share double"
_LEAKS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("cosine", pa.float64()), ("exact_share", pa.float64()), ("word_share", pa.float64())])


class Searcher:
    """Finds the items of a block in texts."""

    def __init__(self, vocabulary: Vocabulary, ids: list[int], passages: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> None:
        self.vocabulary, self.ids, self.passages, self.basis = vocabulary, ids, passages, basis
        self.idf = idf.astype(np.float32)
        latent = np.zeros((len(passages), basis.shape[1]), np.float32)
        for a in range(0, len(passages), 64):
            row, term, value = _rows([vocabulary.hits(p)[1] for p in passages[a : a + 64]], idf)
            latent[a : a + 64] = _sum_by(row, value[:, None] * basis[term], len(passages[a : a + 64]))
        self.queries = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)).T.copy()
        self.longest = max(map(len, passages), default=0)
        # the answer: the rarest fifth of an item's words, by the rarest term they are part of
        self.answers = []
        for p in passages:
            at, terms = vocabulary.hits(p)
            best: dict[int, float] = {}
            for k, t in zip(at.tolist(), terms.tolist()):
                for w in (int(p[k]), int(p[k + 1 + int(vocabulary.terms[t]) % 2])):
                    best[w] = best.get(w, 0.0) + float(idf[t])
            best = {w: x / int((p == w).sum()) for w, x in best.items()}
            self.answers.append(set(sorted(best, key=lambda w: (-best[w], w))[: max(2, len(best) // 5)]))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"basis": _halved(self.basis)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, basis=_restored(state["basis"]))

    def candidates(self, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(document, item, passage, cosine) of the passages of many documents, one after the other in ``numbers``.

        Document k begins at ``starts[k]``; a number of -1 stands between two.
        """
        at, term = self.vocabulary.hits(numbers)
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        block = (at - starts[doc]) // STRIDE
        width = int(block.max()) + 2
        key, first = np.unique(doc * width + block, return_index=True)
        for a in range(0, len(key), 20_000):  # blocks of passages; the one before is repeated, as passages overlap
            lo, hi = max(a - 1, 0), min(a + 20_000, len(key))
            begin, end = first[lo], first[hi] if hi < len(key) else len(at)
            w = self.idf[term[begin:end]]
            half = _fold(term[begin:end], w, first[lo:hi] - begin, self.basis)
            mass = np.add.reduceat(w * w, first[lo:hi] - begin)
            own = key[lo:hi]
            follows = np.flatnonzero(np.diff(own) == 1)
            both, both_mass = half.copy(), mass.copy()
            both[follows] += half[follows + 1]
            both_mass[follows] += mass[follows + 1]
            cosine = (both @ self.queries) / np.sqrt(both_mass)[:, None]
            for p, i in zip(*np.nonzero(cosine >= COSINE)):
                yield int(own[p]) // width, int(i), int(own[p]) % width, float(cosine[p, i])

    def search(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, cosine, exact share, word share) of the leaks."""
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for doc, item, passage, cosine in self.candidates(numbers, starts):
            found.setdefault((doc, item), []).append((passage, cosine))
        for (doc, item), places in found.items():
            passage, text = self.passages[item], numbers[starts[doc] : ends[doc]]
            best = None
            spans: list[list[int]] = []
            for p in sorted({p for p, _ in places}):
                lo, hi = max(p * STRIDE - len(passage), 0), (p + 2) * STRIDE + len(passage)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                leak, exact, loose = judge(passage, text[lo:hi], self.answers[item])
                if leak and (best is None or (exact, loose) > best):
                    best = exact, loose
            if best:
                yield doc, item, max(c for _, c in places), *best


def _search(searcher: Searcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            parts, starts, ends, at = [], [], [], 0
            for text in texts:
                n = searcher.vocabulary.number(words(text.as_py()))
                parts += [n, np.array([-1])]
                starts.append(at)
                ends.append(at + len(n))
                at += len(n) + 1
            if not parts:
                continue
            out: tuple[list, ...] = tuple([] for _ in _LEAKS)
            for doc, item, *shares in searcher.search(np.concatenate(parts), np.array(starts), np.array(ends)):
                for column, x in zip(out, (searcher.ids[item], ids[doc], *shares)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LEAKS)], schema=_LEAKS)

    return run


def _blocks(passages: dict[int, list[str]]) -> Iterator[list[int]]:
    block, n = [], 0
    for i, ws in sorted(passages.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        if len(ws) < 2:
            continue
        # a word begins two terms, a term is a row of the basis
        if block and 2 * (n + len(ws)) * 4 * (RANK + OVERSAMPLE) > BASIS_BYTES:
            yield block
            block, n = [], 0
        block.append(i)
        n += len(ws)
    if block:
        yield block


def prepared(docs: DataFrame, vocabulary: Vocabulary, ids: list[int], passages: list[np.ndarray]) -> Searcher:
    """The searcher of a block of items: document frequencies over all ``docs(doc_id, text)``, and the latent space."""
    n_docs = docs.count()
    texts = docs.select("text").filter("length(text) > 0").withColumn("code", F.xxhash64("text"))
    # about three passages a document: a modulus that draws about SAMPLE of them
    stats = checkpointed(texts.mapInArrow(_count(vocabulary, max(1, 3 * n_docs // SAMPLE)), STATS_SCHEMA))
    df = np.zeros(len(vocabulary.terms), np.int64)
    for r in stats.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # at most the terms of a block of items
        df[r.term] = r.n
    idf = np.log((n_docs + 1) / (df + 1)) + 1.0
    sample = stats.filter("sample is not null").select("sample").orderBy(F.xxhash64("sample"), "sample").limit(SAMPLE).repartition(SAMPLE_TASKS)
    sample = checkpointed(sample)
    basis = latent_basis(sample, sample.count(), [vocabulary.hits(p)[1] for p in passages], idf)
    return Searcher(vocabulary, ids, passages, idf, basis)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, doc_id, cosine, exact_share, word_share)``: each item of ``items(item_id, text)`` in each document of ``docs(doc_id, text)`` that holds two fifths of its own passage or more."""
    own = own_passages([(r.item_id, r.text) for r in items.select("item_id", "text").distinct().toLocalIterator()])
    texts = docs.select("doc_id", "text")
    found = None
    for ids in _blocks(own):
        vocabulary = Vocabulary([own[i] for i in ids])
        searcher = prepared(texts, vocabulary, ids, [vocabulary.number(own[i]) for i in ids])
        part = texts.filter("length(text) > 0").mapInArrow(_search(searcher), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found
