"""The regex search engine: a corpus, a query set, and an index by one of the methods.

    index = build(corpus, queries, "FREE", c=0.1, upper_n=5)
    index.match(queries).show()     # (pattern, num_after_filter, match_count)
    index.summary("my run").show()  # the figures of the index

Whatever the method, the match counts equal those of a full scan.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.regex import literals
from gramforge.operators import match, postings
from gramforge.operators.selectors import best, free, lpms, trigram, vggraph, vgopt
from gramforge.operators.selectors.common import KEYS
from gramforge.plans.boolean import ALL
from gramforge.plans.cut import written

METHODS = ("FREE", "BEST", "LPMS", "TRIGRAM", "VGGRAPH", "VGGRAPH_OPT", "NONE")


def select(corpus: DataFrame, patterns: list[str], method: str, c: float = 0.1, upper_n: int = 5, most: int | None = None, presuf: str | None = None, mode: str = "sound", **options) -> DataFrame:
    """``(gram, df)``: the keys of a method.

    ``c``: the selectivity threshold; ``upper_n``: the longest gram; ``most``:
    the bound on the number of keys; ``presuf``: None, ``sound`` or ``compat``;
    further options are those of the selector.
    """
    if method == "FREE":
        keys = free.free_keys(corpus, c, upper_n, most)
        return keys if presuf is None else free.presuf_shell(keys) if presuf == "compat" else free.without_suffixes(keys)
    if method == "BEST":
        return best.best_keys(corpus, patterns, c, most, mode=mode, **options)
    if method == "LPMS":
        return lpms.lpms_keys(corpus, patterns, most=most, mode=mode, **options)
    if method == "TRIGRAM":
        return trigram.trigram_keys(corpus, most, **options)
    if method == "VGGRAPH":
        return vggraph.vggraph_keys(corpus, patterns, c, upper_n, most, mode)
    if method == "VGGRAPH_OPT":
        return vgopt.vgopt_keys(corpus, c, upper_n, most)
    if method == "NONE":
        return corpus.sparkSession.createDataFrame([], KEYS)
    raise ValueError(f"no method {method}: {', '.join(METHODS)}")


@dataclass
class Index:
    """Keys of a corpus; posting lists are built when they are asked for."""

    corpus: DataFrame
    keys: DataFrame
    method: str = "MANUAL"
    mode: str = "sound"
    settings: dict = field(default_factory=dict)
    times: dict = field(default_factory=dict)
    _postings: DataFrame | None = None

    def postings(self) -> DataFrame:
        """``(gram, rec_id)`` of all keys, computed once and kept as a table."""
        if self._postings is None:
            start = time.monotonic()
            self._postings = written(postings.postings(self.corpus, self.keys))
            self.times["build_time"] = time.monotonic() - start
        return self._postings

    def plans(self, patterns: list[str], trees: bool = False) -> dict[str, tuple]:
        """The plan of each pattern over the keys: the AND of its literals' keys, or with ``trees`` the AND/OR plan of its structure."""
        strings = [x for p in patterns for x in (match.boolean.literals(match.boolean.plan(p)) if trees else literals(p, self.mode))]
        keys = match.keys_among(self.keys, strings)
        return match.tree_plans(patterns, keys) if trees else match.and_plans(patterns, keys, self.mode)

    def match(self, queries: DataFrame | list[str], through: str = "texts", trees: bool = False) -> DataFrame:
        """``(pattern, num_after_filter, match_count)`` of the queries' different patterns.

        ``through``: ``texts`` tests the keys on the texts in the verifying
        pass, for which no posting list is needed; ``postings`` reads only the
        texts that the lists leave.
        """
        patterns = queries if isinstance(queries, list) else match.patterns_of(queries)
        plans = self.plans(patterns, trees)
        if through == "postings" and any(p != ALL for p in plans.values()):
            return match.index_counts(self.corpus, self.postings(), patterns, plans)
        return match.scan_counts(self.corpus, patterns, plans)

    def candidates(self, pattern: str, trees: bool = False) -> DataFrame:
        """``(rec_id)``: the records that the index leaves for one pattern (all of them if it doesn't help)."""
        plan = self.plans([pattern], trees)[pattern]
        return self.corpus.select("rec_id") if plan == ALL else match.candidates(self.postings(), {0: plan}).select("rec_id")

    def size(self) -> DataFrame:
        """One row ``(num_keys, num_postings, index_size)``."""
        return postings.index_size(postings.document_frequency(self.postings()))

    def summary(self, name: str | None = None, num_queries: int | None = None, n_records: int | None = None) -> DataFrame:
        """One row as it goes into a summary file: settings, measured times in seconds, keys and size."""
        s, t = self.settings, self.times
        size = self.size()
        both = t.get("selection_time", 0.0) + t.get("build_time", 0.0)
        lit = lambda x, kind: F.lit(x).cast(kind)
        return size.select(
            F.lit(name or self.method).alias("name"), lit(self.corpus.sparkSession.sparkContext.defaultParallelism, "int").alias("num_threads"), lit(s.get("upper_n"), "int").alias("gram_size"),
            lit(s.get("c"), "double").alias("selectivity"), lit(s.get("most"), "long").alias("key_upper_bound"), lit(num_queries, "int").alias("num_queries"),
            lit(t.get("selection_time"), "double").alias("selection_time"), lit(t.get("build_time"), "double").alias("build_time"), lit(both, "double").alias("overall_index_time"),
            "num_keys", "index_size", lit(t.get("compile_time"), "double").alias("compile_time"), lit(t.get("match_time"), "double").alias("match_time"),
        )


def build(corpus: DataFrame, queries: DataFrame | list[str] | None, method: str, mode: str = "sound", **settings) -> Index:
    """An index of ``corpus(rec_id, text)`` by a method; its keys are kept as a table."""
    patterns = [] if queries is None else queries if isinstance(queries, list) else match.patterns_of(queries)
    start = time.monotonic()
    keys = written(select(corpus, patterns, method, mode=mode, **settings))
    return Index(corpus, keys, method, mode, settings, {"selection_time": time.monotonic() - start})


def manual(corpus: DataFrame, keys: DataFrame | list[str]) -> Index:
    """An index of chosen keys."""
    if isinstance(keys, list):
        keys = corpus.sparkSession.createDataFrame([(k,) for k in sorted(set(keys))], "gram string")
    return Index(corpus, keys.select("gram").filter("gram is not null and gram <> ''").distinct())


def suggested_method(common_literals: bool, small_query_set: bool, unseen_queries: bool) -> str:
    """The published decision tree: common literals ask for LPMS, a small and short query set for BEST, queries yet unknown for FREE, else VGGRAPH."""
    return "FREE" if unseen_queries else "LPMS" if common_literals else "BEST" if small_query_set else "VGGRAPH"


def session(name: str = "gramforge", **conf: str) -> SparkSession:
    """A session with adaptive execution; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
