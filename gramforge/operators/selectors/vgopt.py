"""Keys by centrality in the graph of grams that share records (VGGRAPH_OPT).

Vertices are grams of 1 to n characters, edges join grams whose record sets
have a Jaccard similarity above a threshold, centrality is ``degree * (1 -
selectivity)``, and keys are taken by centrality per selectivity as long as
they add records.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.selectors.common import key_table
from gramforge.plans.cut import written

LEAST_JACCARD = 0.1
MOST_PAIRS = 1_000_000


def vertices(corpus: DataFrame, upper_n: int) -> DataFrame:
    """``(gram, rec_id)`` of all grams of 1 to ``upper_n`` characters."""
    return exploded(corpus, list(range(1, upper_n + 1)))


def gram_sets(rows: DataFrame) -> DataFrame:
    """``(set_id, grams, known, n)``: the different gram sets of the records of ``rows(gram, rec_id)`` and how many records have each, kept as a table.

    Rows without a ``rec_id`` are one record that isn't ``known``.  A table that
    this made is returned as it is, so a chain of operators makes it once.
    """
    if "grams" in rows.columns:
        return rows
    records = rows.groupBy("rec_id").agg(F.sort_array(F.collect_set("gram")).alias("grams"))
    sets = records.groupBy("grams", F.col("rec_id").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))
    return written(sets.select(F.monotonically_increasing_id().alias("set_id"), "grams", "known", "n"))


def _frequency(sets: DataFrame) -> DataFrame:
    """``(gram, df)``."""
    return sets.select("n", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("n").alias("df"))


def jaccard_edges(rows: DataFrame, least: float = LEAST_JACCARD) -> DataFrame:
    """``(g1, g2, jaccard)``, ``g1 < g2``, of all pairs of grams of ``rows(gram, rec_id)`` with a similarity above ``least``.

    The pairs of each different gram set are counted where they arise, so one
    row per pair and task is shuffled.  Only tables of one row per gram are
    built on in a join, by hint: the rows are many more than the size of the
    texts' files lets Spark expect, and would be broadcast.
    """
    sets = gram_sets(rows)
    of = sets.filter("known").select("n", "grams", F.posexplode("grams").alias("at", "g1"))
    pairs = of.select("n", "g1", F.explode(F.slice("grams", F.col("at") + 2, F.size("grams"))).alias("g2"))
    shared = pairs.groupBy("g1", "g2").agg(F.sum("n").alias("shared"))
    sizes = _frequency(sets)
    both = shared.join(sizes.select(F.col("gram").alias("g1"), F.col("df").alias("n1")).hint("shuffle_hash"), "g1").join(sizes.select(F.col("gram").alias("g2"), F.col("df").alias("n2")).hint("shuffle_hash"), "g2")
    return both.select("g1", "g2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard")).filter(F.col("jaccard") > least)


def centrality(rows: DataFrame, edges: DataFrame, n_records: int) -> DataFrame:
    """``(gram, df, selectivity, degree, centrality)``."""
    degrees = edges.select(F.explode(F.array("g1", "g2")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("degree"))
    nodes = _frequency(gram_sets(rows)).join(degrees.hint("shuffle_hash"), "gram", "left").select("gram", "df", (F.col("df") / F.lit(float(n_records))).alias("selectivity"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return nodes.withColumn("centrality", F.col("degree") * (1 - F.col("selectivity")))


def _in_order(left: DataFrame, least: int) -> list[tuple[str, int, int]]:
    """``(gram, df, adds)`` of the grams of few ``(set_id, n, ranks)`` that add ``least`` records, gone through in order on the driver."""
    rows = left.select("set_id", "n", F.explode("ranks").alias("r")).select("set_id", "n", "r.before", "r.gram", "r.df").toArrow().sort_by([("before", "ascending"), ("gram", "ascending")])
    grams, df, n = rows["gram"].to_pylist(), rows["df"].to_numpy(), rows["n"].to_numpy()
    ids = np.unique(rows["set_id"].to_numpy(), return_inverse=True)[1]
    starts = [i for i in range(len(grams)) if not i or grams[i] != grams[i - 1]]
    done, taken = np.zeros(len(grams), bool), []
    for start, end in zip(starts, [*starts[1:], len(grams)]):
        own = ids[start:end]
        adds = int(n[start:end][~done[own]].sum())
        if adds >= least:
            done[own] = True
            taken.append((grams[start], int(df[start]), adds))
    return taken


def _late(tail: DataFrame, least: int):
    """``(gram, df, adds)`` in order of the grams of ``tail(set_id, n, ranks)`` that add ``least`` records to those taken before.

    A gram is taken for certain if it is the first undecided one of so many
    records, left out if only fewer hold it.  Each round decides all such grams
    (the first of all is one) and drops them; of a record that one of them
    covers, the undecided grams before that one stay.  What is left is finished on the driver when it has at most ``MOST_PAIRS``
    rows; the keys are the same whenever that is.
    """
    spark, left, chosen = tail.sparkSession, tail, []
    while (left.agg(F.sum(F.size("ranks"))).first()[0] or 0) > MOST_PAIRS:
        held = left.select("set_id", "n", F.posexplode("ranks").alias("at", "r")).withColumn("gram", F.col("r.gram"))
        sure, holds = F.sum(F.when(F.col("at") == 0, F.col("n"))) >= least, F.sum("n") >= least
        decided = written(held.groupBy("gram").agg(F.coalesce(sure, F.lit(False)).alias("sure"), holds.alias("may")))
        chosen.append(decided.filter("sure").select("gram"))
        ranks = F.sort_array(F.collect_set(F.when(F.col("may"), F.col("r")))).alias("ranks")
        left = held.join(decided.hint("shuffle_hash"), "gram").groupBy("set_id", "n").agg(ranks, F.min(F.when(F.col("sure"), F.col("r"))).alias("covered"))
        open_ranks = F.filter("ranks", lambda r: F.col("covered").isNull() | (r < F.col("covered")))
        left = written(left.select("set_id", "n", open_ranks.alias("ranks")).filter(F.size("ranks") > 0))
    rest = _in_order(left, least)
    if not chosen:
        yield from rest
        return
    keys = spark.createDataFrame([(g,) for g, _, _ in rest], "gram string")
    for more in chosen:
        keys = keys.union(more)
    held = tail.select("set_id", "n", F.explode("ranks").alias("rank")).withColumn("gram", F.col("rank.gram"))
    first = held.join(keys.hint("shuffle_hash"), "gram", "left_semi").groupBy("set_id", "n").agg(F.min("rank").alias("rank"))
    for r in first.groupBy("rank").agg(F.sum("n").alias("adds")).orderBy("rank").toLocalIterator():
        yield r["rank"].gram, r["rank"].df, r.adds


def covering_keys(rows: DataFrame, nodes: DataFrame, n_records: int, c: float, most: int | None = None, enough: float = 0.9, late_after: int = 100) -> DataFrame:
    """``(gram, df)``: grams with selectivity up to ``c``, by ``centrality / (selectivity + 1e-10)`` descending (ties by gram), that add a record not yet covered.

    A gram adds one exactly if it is the first of some record's grams, so one
    aggregation over the records finds all keys and what each adds.  After
    ``late_after`` keys a gram has to add two, whatever the size of the input;
    that depends on the grams left out before it (see ``_late``).  It ends when
    ``enough`` of the records or ``most`` keys are reached.
    """
    score = F.col("centrality") / (F.col("selectivity") + 1e-10)
    ranked = nodes.filter(F.col("selectivity") <= c).select("gram", F.struct((-score).alias("before"), "gram", "df").alias("rank"))
    held = gram_sets(rows).select("set_id", "n", F.explode("grams").alias("gram")).join(ranked.hint("shuffle_hash"), "gram")
    sets = written(held.groupBy("set_id", "n").agg(F.sort_array(F.collect_set("rank")).alias("ranks")))
    first = sets.groupBy(F.col("ranks")[0].alias("rank")).agg(F.sum("n").alias("adds"))
    head = first.orderBy("rank").limit(late_after).collect()
    taken: dict[str, int] = {}
    covered = 0

    def ended() -> bool:
        return covered >= enough * n_records or (most is not None and len(taken) >= most)

    for r in head:
        if ended():
            break
        taken[r["rank"].gram] = r["rank"].df
        covered += r.adds
    if len(taken) == late_after and not ended():
        # records with a gram up to the last key are covered: the first of their grams is a key
        last = F.struct(F.lit(head[-1]["rank"].before).alias("before"), F.lit(head[-1]["rank"].gram).alias("gram"), F.lit(head[-1]["rank"].df).alias("df")) if head else None
        for gram, df, adds in _late(sets if last is None else sets.filter(F.col("ranks")[0] > last), 2):
            taken[gram] = df
            covered += adds
            if ended():
                break
    return key_table(rows.sparkSession, taken)


def coverage(rows: DataFrame, keys: DataFrame, n_records: int) -> float:
    """The share of the records that hold a key."""
    return rows.join(keys.select("gram"), "gram", "left_semi").select("rec_id").distinct().count() / n_records if n_records else 0.0


def vgopt_keys(corpus: DataFrame, c: float = 0.1, upper_n: int = 2, most: int | None = None) -> DataFrame:
    """``(gram, df)`` of the whole chain."""
    sets, n = gram_sets(vertices(corpus, upper_n)), corpus.count()
    return covering_keys(sets, centrality(sets, jaccard_edges(sets), n), n, c, most)
