"""What the selectors share: gram counts by level, counts of given strings, the bound on the number of keys."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.match import Finder
from gramforge.plans.cut import written

KEYS = "gram string, df long"


def prefix_of(k: int):
    """The first ``k - 1`` code points of a k-gram."""
    return F.substring("gram", 1, k - 1)


def level_counts(corpus: DataFrame, k: int, extend: DataFrame) -> DataFrame:
    """``(gram, df)`` of the k-grams whose prefix is in ``extend(gram)``, kept as a table.

    As long as ``extend`` is small (Spark decides by its size) it is broadcast
    and the other grams are dropped where they arise; else counting comes
    first, so that counts are joined and not occurrences.
    """
    prefixes = extend.select(F.col("gram").alias("prefix"))
    limit = corpus.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    small = int(str(prefixes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= int(limit)
    rows = exploded(corpus, [k]).withColumn("prefix", prefix_of(k))
    if small:
        rows = rows.join(prefixes, "prefix", "left_semi")
    counted = rows.groupBy("prefix", "gram").agg(F.count(F.lit(1)).alias("df"))
    if not small:
        counted = counted.join(prefixes, "prefix", "left_semi")
    return written(counted.select("gram", "df"))


def bounded(keys: DataFrame, most: int | None) -> DataFrame:
    """At most ``most`` keys: the shortest ones, in order (code points) among equal lengths."""
    return keys if most is None else keys.orderBy(F.length("gram"), "gram").limit(most)


def _string_counts(strings: set[str]):
    """How often given strings occur, in Arrow batches; lengths 1 and 2 are counted by position, longer ones by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ({x for x in strings if len(x) == k} for k in (1, 2))
        find = Finder({x for x in strings if len(x) > 2})
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                seen: Counter = Counter()
                if one:
                    seen.update({x: n for x, n in Counter(text).items() if x in one})
                if two:
                    seen.update({x: n for x, n in Counter(map(str.__add__, text, text[1:])).items() if x in two})
                if find.automaton is None:
                    for x in find(text):
                        seen[x] = sum(text.startswith(x, i) for i in range(len(text)))
                elif find.strings:
                    seen.update(x for _, x in find.automaton.iter(text))
                total.update(seen)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


class _Trie:
    """Given strings by length, to be followed at all positions of many texts at once.

    A string is a number among its length's prefixes, its next one is found by
    that number and the next character's: in a table, or by bisection where the
    table would have more than ``TABLE`` cells.
    """

    TABLE, CELLS, CHARS = 1 << 22, 1 << 23, 1 << 17

    def __init__(self, strings: set[str]) -> None:
        chars = sorted({ord(c) for x in strings for c in x})
        self.char = np.zeros(0x110000, np.int64)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.prefixes = [sorted({x[:k] for x in strings if len(x) >= k}) for k in range(1, max(map(len, strings)) + 1)]
        self.first, self.steps = np.zeros(self.width, np.int64), []
        self.first[self.char[[ord(x) for x in self.prefixes[0]]]] = np.arange(1, len(self.prefixes[0]) + 1)
        at = {x: i + 1 for i, x in enumerate(self.prefixes[0])}
        for own in self.prefixes[1:]:
            keys = np.array([at[x[:-1]] * self.width + self.char[ord(x[-1])] for x in own])
            self.steps.append((keys, self._table(keys, (len(at) + 1) * self.width)))
            at = {x: i + 1 for i, x in enumerate(own)}
        self.counts = [np.zeros(len(own) + 1, np.int64) for own in self.prefixes]
        self.records = max(1, self.CELLS // (max(map(len, self.prefixes)) + 1))

    def _table(self, keys: np.ndarray, cells: int) -> np.ndarray | None:
        if cells > self.TABLE:
            return None
        table = np.zeros(cells, np.int32)
        table[keys] = np.arange(1, len(keys) + 1)
        return table

    def _next(self, k: int, keys: np.ndarray) -> np.ndarray:
        own, table = self.steps[k]
        if table is not None:
            return table[keys]
        # prefixes are in order, so their keys are, too
        i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[i] == keys, i + 1, 0)

    def add(self, texts: list[str]) -> None:
        """Count the records that hold each string, some of them at a time."""
        first, chars = 0, 0
        for i, text in enumerate(texts):
            if i > first and (chars + len(text) > self.CHARS or i - first >= self.records):
                self._add(texts[first:i])
                first, chars = i, 0
            chars += len(text)
        if texts[first:]:
            self._add(texts[first:])

    def _add(self, texts: list[str]) -> None:
        ends = np.cumsum([len(x) + 1 for x in texts])
        codes = self.char[np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)]
        codes[ends - 1] = 0  # no string goes beyond its text
        place = np.flatnonzero(node := self.first[codes])
        node, record = node[place], np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[place]
        for k, count in enumerate(self.counts):
            if k:
                node = self._next(k - 1, node * self.width + codes[place + k])
                on = np.flatnonzero(node)
                node, place, record = node[on].astype(np.int64), place[on], record[on]
            if not len(node):
                break
            held = np.zeros((len(texts), len(count)), bool)
            held[record, node] = True
            count += held.sum(axis=0)


def _record_counts(strings: set[str]):
    """In how many records given strings occur, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(strings)
        for batch in batches:
            trie.add(batch.column(0).to_pylist())
        total = {x: int(n) for own, counts in zip(trie.prefixes, trie.counts) for x, n in zip(own, counts[1:]) if n and x in strings}
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def string_counts(corpus: DataFrame, strings: Iterable[str], per_record: bool) -> dict[str, int]:
    """How often each of a query set's strings occurs (overlapping), or in how many records, in one pass over the texts.

    A task counts in one table of at most as many entries as there are
    strings; the sums come to the driver.  Strings that don't occur have 0.
    """
    strings = {x for x in strings if x}
    if not strings:
        return {}
    run = _record_counts(strings) if per_record else _string_counts(strings)
    counts = corpus.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return dict.fromkeys(strings, 0) | {r.gram: r.n for r in counts.collect()}


def substrings_of(literals: Iterable[str], lengths: Iterable[int] | None = None) -> set[str]:
    """The substrings of some literals, of all lengths or of these."""
    found: set[str] = set()
    for x in set(literals):
        for k in lengths if lengths is not None else range(1, len(x) + 1):
            found.update(x[i : i + k] for i in range(len(x) - k + 1))
    return found


def key_table(spark, keys: dict[str, int]) -> DataFrame:
    """``(gram, df)`` of keys that were chosen on the driver."""
    return spark.createDataFrame(sorted(keys.items()), KEYS)
