"""Variable-length grams by set cover of the queries' literals (VGGRAPH).

From bigrams on, level by level: grams with at most ``tau`` records are
selectable; each query covers the characters of its literals greedily with
them, cheapest records per newly covered character first; grams that are too
frequent or were selected are extended by one character.  With queries only
their own grams matter, and one pass counts a level; without queries all
selectable grams are keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.match import query_literals
from gramforge.operators.postings import document_frequency
from gramforge.operators.selectors.common import KEYS, bounded, key_table, level_counts, string_counts, substrings_of
from gramforge.plans.cut import written

SHORTEST = 2


def frequency_quantile(df: DataFrame, q: float = 0.8) -> int:
    """The ``floor(n * q)``-th smallest (from 0) record count of ``df(gram, df)``; 10 if there is none.

    Equal counts are added up first, so the sorted table has one row per count.
    """
    sizes = df.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return 10
    running = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("df")))
    return running.filter(F.col("upto") > min(int(total * q), total - 1)).agg(F.min("df")).first()[0]


def threshold(corpus: DataFrame, c: float) -> int:
    """Most records of a selectable gram: a share of all, or with a negative ``c`` the 0.8-quantile over the bigrams."""
    return int(c * corpus.count()) if c >= 0 else frequency_quantile(document_frequency(exploded(corpus, [SHORTEST])))


def greedy_cover(literals: list[str], cost: dict[str, int]) -> list[str]:
    """Grams that cover the characters of the literals, each time the least cost per new character (a character counts once per occurrence over it); ties by the gram."""
    places: dict[str, list[tuple[int, int]]] = {}
    for n, x in enumerate(literals):
        for k in {len(g) for g in cost}:
            for i in range(len(x) - k + 1):
                if x[i : i + k] in cost:
                    places.setdefault(x[i : i + k], []).extend((n, j) for j in range(i, i + k))
    covered: set[tuple[int, int]] = set()
    chosen: list[str] = []
    while True:
        scores = [(cost[g] / gain, g) for g, at in places.items() if (gain := sum(p not in covered for p in at))]
        if not scores:
            return chosen
        best = min(scores)[1]
        covered.update(places.pop(best))
        chosen.append(best)


def vggraph_keys(corpus: DataFrame, patterns: list[str] | None = None, c: float = 0.1, upper_n: int = 3, most: int | None = None, mode: str = "sound") -> DataFrame:
    """``(gram, df)``: the chosen keys of up to ``upper_n`` characters."""
    tau = threshold(corpus, c)
    if not patterns:
        return _all_selectable(corpus, tau, upper_n, most)
    literals = query_literals(patterns, mode)
    keys: dict[str, int] = {}
    extend: set[str] | None = None
    for k in range(SHORTEST, upper_n + 1):
        grams = {g for g in substrings_of((x for lits in literals for x in lits), [k]) if extend is None or g[:-1] in extend}
        counts = {g: n for g, n in string_counts(corpus, grams, per_record=True).items() if n}
        if not counts:
            break
        cost = {g: n for g, n in counts.items() if n <= tau}
        chosen = sorted({g for lits in literals for g in greedy_cover(lits, cost)})
        for g in chosen:
            if most is None or len(keys) < most:
                keys[g] = counts[g]
        if most is not None and len(keys) >= most:
            break
        extend = {g for g, n in counts.items() if n > tau} | set(chosen)
    return key_table(corpus.sparkSession, keys)


def _all_selectable(corpus: DataFrame, tau: int, upper_n: int, most: int | None) -> DataFrame:
    keys, level = [], written(document_frequency(exploded(corpus, [SHORTEST])))
    for k in range(SHORTEST, upper_n + 1):
        keys.append(level.filter(F.col("df") <= tau))
        # what is selectable is selected, so every gram is extended
        if k < upper_n:
            level = level_counts(corpus, k + 1, level)
    return bounded(reduce(DataFrame.unionByName, keys, corpus.sparkSession.createDataFrame([], KEYS)), most)


def until_selective(corpus: DataFrame, tau: int, longest: int = 16) -> DataFrame:
    """``(gram, df)``: grams extended only while more than ``tau`` records have them, up to ``longest`` characters; what is left frequent then is a key as well."""
    level = written(document_frequency(exploded(corpus, [SHORTEST])))
    keys = level.filter(F.col("df") <= tau)
    for k in range(SHORTEST + 1, longest + 1):
        frequent = level.filter(F.col("df") > tau)
        if frequent.limit(1).count() == 0:
            return keys
        level = level_counts(corpus, k, frequent)
        keys = keys.unionByName(level.filter(F.col("df") <= tau))
    return keys.unionByName(level.filter(F.col("df") > tau))
