"""Percentiles of very large integer columns by dyadic Count-sketches (problem 2).

Values are encoded to an order-preserving code: exact below ``2**PRECISION``,
above it a floating code with ``PRECISION`` leading bits.  Over the code's
binary tree there is one signed Count-sketch per level (levels with few nodes
keep exact counters).  A sketch is linear: the cells of two sketches of the
same parameters add up to the sketch of both inputs, and a negative weight
deletes.  A rank is inverted by descending the levels from the root, going to
the child that holds it.

Distribution: every task keeps one sketch per group (at most ``MAX_GROUPS`` in
memory, then they are sent on) and emits its non-zero cells; Spark adds the
cells up with ``sum``.  What is shuffled for a group is bounded by the number
of its cells, whatever the number of rows.

Error: every percentile states its own.  ``value`` stands for values within a
relative distance of ``2**-(PRECISION + 1)``, and its rank differs from the
wanted one by at most ``rank_error``.  On the way down each estimate is the
median of ``DEPTH`` rows whose errors are symmetric and independent, so the
true count lies between the least and the greatest row with a probability of
``1 - 2**(1 - DEPTH)``, whatever the values; ``rank_error`` adds up these
distances over the levels that are sketched (levels with at most ``EXACT``
nodes are exact).  With the defaults all levels hold together with a
probability of 0.98.

Edge cases: null and negative values don't count; a null group is a group of
its own; a group whose values all don't count, or were all deleted, gives no
row; equal values and repeated rows count as often as they stand; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 10
LEVELS = 16  # codes are below 2**LEVELS: (63 - PRECISION + 1) * 2**PRECISION at most
EXACT = 1 << 11  # levels with no more nodes than this have exact counters
DEPTH, WIDTH = 9, 1 << 10
MAX_GROUPS = 256
BUNDLE = 500_000

SKETCH_SCHEMA = "field_name string, group_key string, cell int, n long"
_SKETCH = pa.schema([("field_name", pa.string()), ("group_key", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

# Odd multipliers of the hash functions, one pair (bucket, sign) per sketch row.
_MULTIPLIERS = np.random.default_rng(20240229).integers(1 << 40, 1 << 62, (2, DEPTH)).astype(np.uint64) | np.uint64(1)


def _layout() -> tuple[list[int], int]:
    starts, at = [], 0
    for level in range(LEVELS + 1):
        starts.append(at)
        nodes = 1 << (LEVELS - level)
        at += nodes if nodes <= EXACT else DEPTH * WIDTH
    return starts, at


STARTS, CELLS = _layout()


def encode(v: np.ndarray) -> np.ndarray:
    """Order-preserving codes of non-negative integers."""
    v = v.astype(np.int64)
    shift = np.maximum(np.frexp(v.astype(np.float64))[1] - 1 - PRECISION, 0)
    over = (v >> shift) >= (2 << PRECISION)  # the double was rounded up to the next power of two or not at all
    shift = np.where(over, shift + 1, shift)
    under = (shift > 0) & ((v >> shift) < (1 << PRECISION))
    shift = np.where(under, shift - 1, shift)
    return shift * (1 << PRECISION) + (v >> shift)


def decode(code: int) -> float:
    """The middle of the values that have this code."""
    if code < 2 << PRECISION:
        return float(code)
    shift = (code >> PRECISION) - 1
    low = (code - (shift << PRECISION)) << shift
    return low + ((1 << shift) - 1) / 2


def _places(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and signs of the nodes of one level: shape (rows, nodes)."""
    if (1 << (LEVELS - level)) <= EXACT:
        return (STARTS[level] + nodes)[None, :], np.ones((1, len(nodes)), np.int64)
    x = (nodes.astype(np.uint64) + np.uint64((level + 1) << 20))[None, :]
    with np.errstate(over="ignore"):
        mixed = (x * _MULTIPLIERS[0][:, None]) ^ ((x * _MULTIPLIERS[0][:, None]) >> np.uint64(29))
        bucket = ((mixed * _MULTIPLIERS[1][:, None]) >> np.uint64(54)).astype(np.int64)
        sign = ((mixed * _MULTIPLIERS[1][::-1][:, None]) >> np.uint64(63)).astype(np.int64) * 2 - 1
    return STARTS[level] + np.arange(DEPTH)[:, None] * WIDTH + bucket, sign


def update(sketch: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Add ``weights`` (negative: delete) of ``codes`` to all levels of ``sketch``."""
    for level in range(LEVELS + 1):
        nodes, inverse = np.unique(codes, return_inverse=True)
        weights = np.bincount(inverse, weights, len(nodes)).astype(np.int64) if len(nodes) < len(codes) else weights[np.argsort(codes)]
        cell, sign = _places(level, nodes)
        np.add.at(sketch, cell.ravel(), (sign * weights).ravel())
        codes = nodes >> 1


def count(sketch: np.ndarray, level: int, node: int) -> tuple[float, float]:
    """The estimated weight of a node, and how far the farthest row is from it."""
    cell, sign = _places(level, np.array([node]))
    rows = sketch[cell[:, 0]] * sign[:, 0]
    middle = float(np.median(rows))
    return middle, float(np.abs(rows - middle).max())


def invert(sketch: np.ndarray, rank: float) -> tuple[float, float]:
    """The value of a rank (from 1), and by how much its rank may differ."""
    node, error = 0, 0.0
    for level in range(LEVELS - 1, -1, -1):
        node *= 2
        left, off = count(sketch, level, node)
        error += off
        if rank > max(left, 0.0):
            rank -= max(left, 0.0)
            node += 1
    return decode(node), error


def _emit(sketches: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (field, group), sketch in sketches.items():
        cell = np.flatnonzero(sketch)
        columns = [pa.array([field] * len(cell), pa.string()), pa.array([group] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(sketch[cell], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH)
    sketches.clear()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketches: dict[tuple, np.ndarray] = {}
    held: list[pa.RecordBatch] = []

    def fold() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.append_column("code", pa.array(encode(t["value"].to_numpy())))
        t = t.group_by(["field_name", "group_key", "code"]).aggregate([("weight", "sum")]).sort_by([("field_name", "ascending"), ("group_key", "ascending")])
        p = t.select(["field_name", "group_key"]).to_pandas()
        new = np.flatnonzero((p != p.shift()).any(axis=1) & ~(p.isna() & p.shift().isna()).all(axis=1)) if len(p) else np.array([], int)
        codes, weights = t["code"].to_numpy(), t["weight_sum"].to_numpy()
        for a, b in zip([0, *new[new > 0]], [*new[new > 0], len(p)]):
            field, group = (None if pd.isna(x) else x for x in p.iloc[a])
            if (field, group) not in sketches:
                if len(sketches) >= MAX_GROUPS:
                    yield from _emit(sketches)
                sketches[field, group] = np.zeros(CELLS, np.int64)
            update(sketches[field, group], codes[a:b], weights[a:b])
        held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BUNDLE:
            yield from fold()
    if held:
        yield from fold()
    yield from _emit(sketches)


def sketch(df: DataFrame, field_name: str, group: Column, value: Column, weight: Column | None = None) -> DataFrame:
    """``(field_name, group_key, cell, n)``: the sketch of each group; ``weight`` -1 deletes a value."""
    rows = df.select(F.lit(field_name).alias("field_name"), group.cast("string").alias("group_key"), value.cast("long").alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("weight"))
    return merged(rows.filter("value >= 0 and weight is not null").mapInArrow(_build, SKETCH_SCHEMA))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all inputs of some sketches together."""
    all_, *rest = sketches
    for s in rest:
        all_ = all_.unionByName(s)
    return all_.groupBy("field_name", "group_key", "cell").agg(F.sum("n").alias("n")).filter("n <> 0")


def percentiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """``(field_name, group_key, n, probability, value, rank_error)``: the value of rank ceil(probability * n) of each group and by how many ranks it may be off.

    One task per group reads at most the cells of one sketch.
    """
    names = ["field_name", "group_key", "n", "probability", "value", "rank_error"]

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros(CELLS, np.int64)
        s[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        n = int(s[STARTS[LEVELS]])
        field, group = pdf["field_name"].iloc[0], pdf["group_key"].iloc[0]
        return pd.DataFrame([(field, group, n, p, *invert(s, max(1, int(np.ceil(p * n))))) for p in probabilities if n > 0], columns=names)

    return sketches.groupBy("field_name", "group_key").applyInPandas(read, "field_name string, group_key string, n long, probability double, value double, rank_error double")


def within_error(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``(field_name, group_key, probability, within)``: whether the stated errors of ``found`` hold for the values ``rows(field_name, group_key, value)``."""
    near = F.col("x").between(F.col("value") * (1 - 2.0**-PRECISION), F.col("value") * (1 + 2.0**-PRECISION))
    named = found.filter("group_key is not null").select("field_name", "group_key", "probability", "value", "rank_error")
    counted = rows.filter("value >= 0 and group_key is not null").groupBy("field_name", "group_key", F.col("value").alias("x")).agg(F.count(F.lit(1)).alias("m"))
    sums = counted.join(named, ["field_name", "group_key"]).groupBy("field_name", "group_key", "probability", "rank_error").agg(
        F.sum("m").alias("n"), F.sum(F.when((F.col("x") < F.col("value")) & ~near, F.col("m")).otherwise(0)).alias("below"), F.sum(F.when((F.col("x") <= F.col("value")) | near, F.col("m")).otherwise(0)).alias("upto")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("n")))
    return sums.select("field_name", "group_key", "probability", ((wanted > F.col("below") - F.col("rank_error")) & (wanted <= F.col("upto") + F.col("rank_error"))).alias("within"))
