"""The most frequent items of a huge column in bounded memory (problem 3).

1. Every task adds up the weights of equal items of a bundle of rows, so that a
   hot item crosses the shuffle as a few rows.
2. The rows are hash-partitioned by item; each partition is a stream with all
   occurrences of its items.
3. A partition keeps a count-min sketch with conservative update (a cell is
   only raised to the new estimate of the items that touch it) and a bounded
   heap of the items with the highest estimates.
4. The partitions' items are disjoint, so the heaps are merged by union.

Memory of a task: ``DEPTH * WIDTH`` counters, ``keep`` candidates and one
bundle.  An estimate is never below the true weight and, with a probability of
``1 - exp(-DEPTH)``, exceeds it by at most ``e / WIDTH`` times the weight of
the partition; conservative update usually leaves heavy items exact.

Edge cases: null items and null or non-positive weights don't count; ties at
the heap's border are broken by the item; repeated rows count as they stand;
an empty table gives no rows and a total of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.plans.cut import checkpointed
from gramforge.sources.tables import shuffle_partitions

DEPTH, WIDTH = 4, 1 << 17
BUNDLE = 200_000

# Odd multipliers of the sketch rows' hash functions.
_MULTIPLIERS = np.random.default_rng(20240301).integers(1 << 40, 1 << 62, DEPTH).astype(np.uint64) | np.uint64(1)
_SHIFT = np.uint64(64 - 17)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BUNDLE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _bundles(batches):
        t = t.group_by(["item"]).aggregate([("weight", "sum")])
        yield from t.rename_columns(["item", "weight"]).to_batches()


class CountMin:
    """Count-min sketch with conservative update of whole batches."""

    def __init__(self) -> None:
        self.cells = np.zeros((DEPTH, WIDTH), np.int64)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Add different items; their estimates afterwards.

        Items of one batch that share a cell raise it to the higher of their
        estimates, which stays an upper bound of either.
        """
        with np.errstate(over="ignore"):
            x = hashes.astype(np.uint64)
            at = [(((x ^ (x >> np.uint64(31))) * m) >> _SHIFT).astype(np.int64) for m in _MULTIPLIERS]
        new = np.min([row[k] for row, k in zip(self.cells, at)], axis=0) + weights
        for row, k in zip(self.cells, at):
            np.maximum.at(row, k, new)
        return new


def _stream(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, total = CountMin(), 0
        heap = pd.DataFrame({"item": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
        for t in _bundles(batches):
            g = t.group_by(["item", "hash"]).aggregate([("weight", "sum")])
            weights = g["weight_sum"].to_numpy()
            total += int(weights.sum())
            n = sketch.add(g["hash"].to_numpy(), weights)
            if len(heap) >= keep:
                rows = np.flatnonzero(n >= heap["n"].min())
            elif len(n) > keep:
                rows = np.flatnonzero(n >= np.partition(n, -keep)[-keep])
            else:
                rows = np.arange(len(n))
            fresh = pd.DataFrame({"item": g["item"].take(pa.array(rows)).to_pandas(), "n": n[rows]})
            heap = pd.concat([heap[~heap["item"].isin(fresh["item"])], fresh]).sort_values(["n", "item"], ascending=[False, True]).head(keep)
        if total:
            yield pa.RecordBatch.from_pydict({"item": pa.array([*heap["item"], None], pa.string()), "n": pa.array([*heap["n"], total], pa.int64())})

    return run


def heaps(df: DataFrame, item: Column, weight: Column | None, keep: int) -> DataFrame:
    """``(item, n)``: the merged heaps, and one row without item per partition with its weight."""
    rows = df.select(item.cast("string").alias("item"), (F.lit(1) if weight is None else weight).cast("long").alias("weight")).filter("item is not null and weight > 0")
    streams = rows.mapInArrow(_combine, "item string, weight long").withColumn("hash", F.xxhash64("item")).repartition(shuffle_partitions(df.sparkSession), "item")
    return checkpointed(streams.select("item", "hash", "weight").mapInArrow(_stream(keep), "item string, n long"))


def frequent(df: DataFrame, item: Column, weight: Column | None = None, one_in: int = 200) -> DataFrame:
    """``(item, n, total)``: the items with at least one ``one_in``-th of the whole weight, by estimate."""
    kept = heaps(df, item, weight, 4 * one_in)
    total = kept.filter("item is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return kept.filter(F.col("item").isNotNull() & (F.col("n") * one_in >= total)).select("item", "n", F.lit(total).alias("total"))


def top(df: DataFrame, item: Column, weight: Column | None = None, k: int = 100) -> DataFrame:
    """``(item, n)``: the k items with the highest estimates (ties by item)."""
    return heaps(df, item, weight, max(4 * k, 1000)).filter("item is not null").orderBy(F.desc("n"), "item").limit(k)
