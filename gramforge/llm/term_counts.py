"""Occurrences and records of every distinct term by last-seen counters (problem 5).

1. Every task adds up equal ``(term, record)`` tokens of a bundle, so a token
   repeated over and over crosses the shuffle as one counted row per bundle.
2. The counted tokens are hash-partitioned by term and shard and ordered by
   record.  Going through them, a term needs only its occurrences, its records
   and the last record seen: a record counts when it differs from the last one.
   No set of records is kept anywhere.
3. The shards' counters are added up.  A shard is a hash of the record, so all
   tokens of one record meet in one shard; there are as many shards as shuffle
   partitions, so a term that holds a third of all tokens is spread over all
   tasks at any size.

Sorting spills; what the second exchange moves is one counter per term and
shard.  Terms without any record travel as one row per bundle.

Edge cases: null terms don't count; null and negative records don't count, but
a term that has no other ones still has its row with zeros; null and empty
arrays likewise; repeated ids count as occurrences, once as a record; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.sources.tables import shuffle_partitions

BUNDLE = 200_000


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def added() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["term", "record"]).aggregate([("n", "sum")])
        yield from t.rename_columns(["term", "record", "n"]).to_batches()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BUNDLE:
            yield from added()
            held, rows = [], 0
    if rows:
        yield from added()


def term_counts(df: DataFrame, term: Column, records: Column, shards: int | None = None) -> DataFrame:
    """``(term, occurrences, n_records)`` over the array column ``records`` of each row of ``df``."""
    shards = shards or shuffle_partitions(df.sparkSession)
    valid = F.filter(records, lambda x: x >= 0).cast("array<bigint>")
    tokens = df.select(term.cast("string").alias("term"), F.explode_outer(valid).alias("record")).filter("term is not null")
    counted = tokens.select("term", "record", F.col("record").isNotNull().cast("long").alias("n")).mapInArrow(_combine, "term string, record long, n long")
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("record"), F.lit(shards)).cast("int"))
    last = F.lag("record").over(Window.partitionBy("term", "shard").orderBy("record"))
    flagged = sharded.withColumn("new", (F.col("record").isNotNull() & ~F.col("record").eqNullSafe(last)).cast("long"))
    states = flagged.groupBy("term", "shard").agg(F.sum("n").alias("occurrences"), F.sum("new").alias("n_records"))
    return states.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))


def marked(counts: DataFrame, n_records: int, rare: int = 2, common_one_in: int = 10) -> DataFrame:
    """``counts`` with ``selectivity`` over ``n_records`` and ``df_mark``: rare (one to ``rare`` records), common (more than a ``common_one_in``-th of all), else null."""
    r = F.col("n_records")
    mark = F.when((r >= 1) & (r <= rare), "rare").when(r * common_one_in > n_records, "common")
    return counts.withColumns({"selectivity": r / F.lit(n_records) if n_records else F.lit(None).cast("double"), "df_mark": mark})
