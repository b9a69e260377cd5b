"""Grams as Spark columns.

A gram is ``k`` consecutive code points.  All columns are built-in functions;
``regexp_extract_all`` goes through a text once, whereas ``substring`` by
position would go through it once per position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, k: int) -> Column:
    """All k-grams of a text in order, overlapping ones included; [] if it is shorter, null if it is null."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))." % k), F.lit(1))


def grams(text: Column, k: int) -> Column:
    """The different k-grams of a text."""
    return F.array_distinct(occurrences(text, k))


def exploded(corpus: DataFrame, lengths: list[int], distinct: bool = True) -> DataFrame:
    """``(rec_id, gram)``: the grams of these lengths of each record of ``corpus(rec_id, text)``, once or as often as they occur.

    The grams of one record and length are held together in its task.
    """
    of = grams if distinct else occurrences
    found = [of(F.col("text"), k) for k in lengths]
    return corpus.select("rec_id", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("gram"))


def substrings(text: Column, most: int) -> Column:
    """All substrings of up to ``most`` code points of a short text (literals of patterns) with repeats."""
    return F.flatten(F.array(*(occurrences(text, k) for k in range(1, most + 1))))


def corpus(df: DataFrame, rec_id: str, text: str) -> DataFrame:
    """``(rec_id, text)`` of the rows that have a text; every other operator counts these as the records."""
    return df.select(F.col(rec_id).alias("rec_id"), F.col(text).alias("text")).filter("text is not null")


LINE_BITS = 24


def lines(records: DataFrame) -> DataFrame:
    """The lines of a corpus as records of their own, carriage returns deleted; ``rec_id`` is ``rec_id << 24 | line number`` (from 0)."""
    numbered = records.select("rec_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line_no", "text"))
    checked = F.when(F.col("line_no") < 1 << LINE_BITS, F.col("line_no")).otherwise(F.raise_error(F.lit("a record has too many lines")).cast("int"))
    return numbered.select(F.shiftleft(F.col("rec_id").cast("long"), LINE_BITS).bitwiseOR(checked.cast("long")).alias("rec_id"), "text")
