"""Inverted lists as tables, and operations on them.

``postings(gram, rec_id)`` has one row per gram and record that holds it.
"Sorted list" operations are relational ones here: a list is the rows of a
gram, so nothing is collected and a gram in a third of all records is spread
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded

BLOCK = 1 << 16


def postings(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """``(gram, rec_id)``: the records that contain each key of ``keys(gram)``.

    The lengths that occur among the keys are collected (a handful of numbers).
    The keys are joined while the grams are made; Catalyst broadcasts them as
    long as their size allows, else both sides are shuffled by gram.
    """
    lengths = sorted(r.k for r in keys.select(F.length("gram").alias("k")).distinct().collect())
    if not lengths:
        return corpus.select(F.lit("").alias("gram"), "rec_id").limit(0)
    return exploded(corpus, lengths).join(keys.select("gram"), "gram", "left_semi").select("gram", "rec_id")


def document_frequency(rows: DataFrame) -> DataFrame:
    """``(gram, df)`` of distinct posting rows: the records of each gram."""
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(gram, block_no, n, rec_ids)``: the sorted ids of each gram in blocks of the id space, so that no list outgrows a row."""
    at = F.floor(F.col("rec_id") / F.lit(block)).cast("long")
    return rows.groupBy("gram", at.alias("block_no")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("rec_id")).alias("rec_ids"))


def lookup(rows: DataFrame, gram: str) -> DataFrame:
    """``(rec_id)`` of one gram; none for an unknown gram."""
    return rows.filter(F.col("gram") == gram).select("rec_id")


def in_all(rows: DataFrame, grams: list[str]) -> DataFrame:
    """``(rec_id)``: records with all of these grams (intersection of their lists).  No grams restrict nothing: all records with postings."""
    wanted = list(dict.fromkeys(grams))
    if not wanted:
        return rows.select("rec_id").distinct()
    return rows.filter(F.col("gram").isin(wanted)).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("rec_id")


def in_any(rows: DataFrame, grams: list[str]) -> DataFrame:
    """``(rec_id)``: records with any of these grams (union of their lists)."""
    return rows.filter(F.col("gram").isin(list(grams))).select("rec_id").distinct()


def _membership(rows: DataFrame, a: str, b: str) -> DataFrame:
    has = lambda g: F.bool_or(F.col("gram") == g)
    return rows.filter(F.col("gram").isin([a, b])).groupBy("rec_id").agg(has(a).alias("in_a"), has(b).alias("in_b"))


def in_first_only(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(rec_id)``: set difference of two lists."""
    return _membership(rows, a, b).filter("in_a and not in_b").select("rec_id")


def in_one_only(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(rec_id)``: symmetric difference of two lists."""
    return _membership(rows, a, b).filter("in_a <> in_b").select("rec_id")


def is_member(records: DataFrame, rows: DataFrame, gram: str) -> DataFrame:
    """The rows of ``records(rec_id, ...)`` that are in the gram's list."""
    return records.join(lookup(rows, gram), "rec_id", "left_semi")


def seek(keys: DataFrame, lower: str, most: int | None = None) -> DataFrame:
    """The keys at or after ``lower`` in order (code points), at most ``most`` of them."""
    found = keys.filter(F.col("gram") >= lower).orderBy("gram")
    return found if most is None else found.limit(most)


def size_model(key_length: Column, df: Column) -> Column:
    """Bytes of one key in the hash index model: the key in the table and in the key set, a list head and eight bytes per record."""
    return 2 * key_length + 24 + 24 + 8 * df


def index_size(frequency: DataFrame) -> DataFrame:
    """One row ``(num_keys, num_postings, index_size)`` of ``frequency(gram, df)``; zeros for an empty index."""
    sums = [F.count(F.lit(1)).alias("num_keys"), F.sum("df"), F.sum(size_model(F.octet_length("gram"), F.col("df")))]
    return frequency.agg(sums[0], F.coalesce(sums[1], F.lit(0)).cast("long").alias("num_postings"), F.coalesce(sums[2], F.lit(0)).cast("long").alias("index_size"))
