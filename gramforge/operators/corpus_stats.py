"""Figures of a corpus ``(rec_id, text)``, of its characters and of the literals of a query set.

Order statistics come from the counts of equal lengths, so nothing but one
small row per different length is ever sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.functions import regex as rx
from gramforge.functions.grams import exploded, occurrences
from gramforge.operators.postings import document_frequency


def length_counts(corpus: DataFrame) -> DataFrame:
    """``(len, n)``: the records of each length in characters."""
    return corpus.groupBy(F.length("text").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def char_frequency(corpus: DataFrame) -> DataFrame:
    """``(char, n)``: how often each character occurs."""
    return exploded(corpus, [1], distinct=False).groupBy(F.col("gram").alias("char")).agg(F.count(F.lit(1)).alias("n"))


def top_chars(corpus: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent characters (ties by code point)."""
    return char_frequency(corpus).orderBy(F.desc("n"), "char").limit(k)


def alphabet_size(corpus: DataFrame) -> DataFrame:
    """One row ``(alphabet_size)``."""
    return char_frequency(corpus).agg(F.count(F.lit(1)).alias("alphabet_size"))


def order_statistics(counts: DataFrame, value: str, at: dict[str, tuple[int, int]]) -> DataFrame:
    """One row: for each name with ``(p, q)`` the value at place ``n * p / q`` (from 0) of the sorted values of ``counts(value, n)``."""
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    running = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    place = lambda p, q: F.floor(F.col("total") * p / q)
    return running.agg(*(F.min(F.when(F.col("upto") > place(p, q), F.col(value))).alias(name) for name, (p, q) in at.items()))


def length_stats(corpus: DataFrame) -> DataFrame:
    """One row: records, characters, average, least and greatest length, the upper median and the places 25, 75, 90 and 95 of a hundred.

    An empty corpus gives zeros and nulls.
    """
    counts = length_counts(corpus)
    plain = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).alias("total_characters"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_line_length"), F.min("len").alias("min_line_length"), F.max("len").alias("max_line_length"),
    )
    places = order_statistics(counts, "len", {"median_line_length": (1, 2), "p25": (25, 100), "p75": (75, 100), "p90": (90, 100), "p95": (95, 100)})
    one = F.lit(1).alias("one")
    return plain.select("*", one).join(places.select("*", one), "one").drop("one")


def spread_stats(corpus: DataFrame) -> DataFrame:
    """One row ``(mean, std, median)`` of the lengths: population deviation, interpolated median."""
    counts = length_counts(corpus)
    x, n = F.col("len"), F.col("n")
    mean = F.sum(x * n) / F.sum(n)
    moments = counts.agg(mean.alias("mean"), (F.sum(x * x * n) / F.sum(n)).alias("square"), F.expr("percentile(len, 0.5, n)").alias("median"))
    return moments.select("mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), "median")


def average_and_alphabet(corpus: DataFrame, least: int = 0) -> DataFrame:
    """One row ``(n, avg_length, alphabet_size)`` over records of at least ``least`` characters, white space at their ends taken off."""
    trimmed = corpus.select("rec_id", F.regexp_replace("text", r"\s+$", "").alias("text")).filter(F.length("text") >= least)
    one = F.lit(1).alias("one")
    sizes = trimmed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_length")).select("*", one)
    return sizes.join(alphabet_size(trimmed).select("*", one), "one").drop("one")


def trigram_records(corpus: DataFrame) -> DataFrame:
    """``(gram, df)``: in how many records each trigram occurs."""
    return document_frequency(exploded(corpus, [3]))


def extremes(df: DataFrame, by: str, name: str, k: int = 10) -> DataFrame:
    """The ``k`` first rows by ``by`` in either direction, marked ``top`` or ``bottom`` (ties by ``name``)."""
    top = df.orderBy(F.desc(by), name).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(df.orderBy(by, name).limit(k).withColumn("end", F.lit("bottom")))


# -- literals of a query set ------------------------------------------------------------------------------------

LITERALS = "regex string, literals array<string>"


def literal_rows(queries: DataFrame, pattern: str = "pattern", mode: str = "compat") -> DataFrame:
    """``(regex, num_literals, total_literal_chars, avg_literal_length, literals)``, one row per row of ``queries``; null patterns have no literals.

    The scanner is Python; it runs once per batch and different pattern.
    """
    def scan(patterns: pd.Series) -> pd.Series:
        found = {p: rx.literals(p, mode) for p in patterns.dropna().unique()}
        return patterns.map(lambda p: found.get(p, []))

    scanned = F.pandas_udf(scan, "array<string>")(F.col(pattern))
    rows = queries.select(F.col(pattern).alias("regex"), scanned.alias("literals"))
    return rows.select("regex", F.size("literals").alias("num_literals"), _chars("literals").alias("total_literal_chars"), "literals").select(
        "regex", "num_literals", "total_literal_chars", _average("total_literal_chars", "num_literals").alias("avg_literal_length"), "literals"
    )


def _chars(literals: str) -> Column:
    return F.aggregate(literals, F.lit(0), lambda a, x: a + F.length(x))


def _average(total: str, n: str) -> Column:
    return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col(n)), F.lit(0.0))


def literal_summary(rows: DataFrame) -> DataFrame:
    """One row of :func:`literal_rows`: totals and averages, zeros for an empty set."""
    sums = rows.agg(F.count(F.lit(1)).alias("total_regexes"), F.coalesce(F.sum("num_literals"), F.lit(0)).alias("total_literals"), F.coalesce(F.sum("total_literal_chars"), F.lit(0)).alias("total_literal_chars"))
    return sums.select(
        "*", _average("total_literals", "total_regexes").alias("avg_literals_per_regex"), _average("total_literal_chars", "total_regexes").alias("avg_literal_chars_per_regex"),
        _average("total_literal_chars", "total_literals").alias("avg_literal_length"),
    )


def literal_histograms(rows: DataFrame, width: int = 10) -> DataFrame:
    """``(kind, bin, n)``: patterns by their number of literals, and by their literal characters in bins of ``width``."""
    kinds = rows.select(F.explode(F.array(F.struct(F.lit("literals").alias("kind"), F.col("num_literals").alias("bin")), F.struct(F.lit("chars").alias("kind"), (F.floor(F.col("total_literal_chars") / width) * width).cast("int").alias("bin")))).alias("x"))
    return kinds.groupBy("x.kind", "x.bin").agg(F.count(F.lit(1)).alias("n"))
