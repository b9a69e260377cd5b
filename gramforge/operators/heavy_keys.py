"""Per-key results although a few keys hold most records (problem 1).

1. Equal ``(key, secondary)`` pairs are counted with Spark's partial (map-side)
   aggregation, so that even one pair that holds a third of all rows reaches
   the shuffle as one row per task.
2. The pairs are range-partitioned on the composite ``(key, secondary)``.  The
   cut points are quantiles that Spark samples from the pairs themselves, so a
   heavy key spans as many partitions as its pairs need, while light keys
   share partitions.
3. Every partition folds its sorted run of a key into one partial state:
   occurrences, distinct secondaries, first and last secondary.  Spark does
   this below the last exchange, so a heavy key sends one small state per
   partition it spans.
4. The partial states are stitched.  Pairs are unique and a pair never
   straddles a boundary, so counts add up; first and last are the extremes.

No group is ever collected: the largest task reads one quantile range.

Edge cases: a null key is a group of its own (null); a null secondary counts
as an occurrence but not as a distinct secondary.  An empty table gives no
rows.  Repeated rows count as stored.  Other columns, also ones named like
the results, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.sources.tables import shuffle_partitions


def per_key(df: DataFrame, key: str, secondary: str, partitions: int | None = None) -> DataFrame:
    """``(key, occurrences BIGINT, distinct_secondary BIGINT, first_secondary, last_secondary)``, one row per key."""
    n = partitions or shuffle_partitions(df.sparkSession)
    pairs = (
        df.select(F.col(key).alias("key"), F.col(secondary).alias("secondary"))
        .groupBy("key", "secondary")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange(n, "key", "secondary")
    )
    return pairs.groupBy("key").agg(
        F.sum("n").alias("occurrences"),
        F.count("secondary").alias("distinct_secondary"),
        F.min("secondary").alias("first_secondary"),
        F.max("secondary").alias("last_secondary"),
    )


def dominant_keys(df: DataFrame, key: str, secondary: str, one_in: int) -> DataFrame:
    """The rows of :func:`per_key` whose non-null key holds at least one ``one_in``-th of all rows of ``df``."""
    total = df.count()
    return per_key(df, key, secondary).filter(F.col("key").isNotNull() & (F.col("occurrences") * one_in >= total))
