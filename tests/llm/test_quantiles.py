import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.llm import quantiles as q

PROBABILITIES = [0.05, 0.5, 0.95]


def sketched(spark, values, group="g"):
    df = spark.createDataFrame([(group, v) for v in values], "grp string, v long")
    return q.sketch(df, "f", F.col("grp"), F.col("v"))


def check(found, values):
    values = sorted(values)
    for r in found.collect():
        wanted = max(1, int(np.ceil(r.probability * len(values))))
        low = sum(v < r.value * (1 - 2**-9) for v in values)
        high = sum(v <= r.value * (1 + 2**-9) for v in values)
        assert r.n == len(values) and low - r.rank_error < wanted <= high + r.rank_error, r
        assert r.rank_error < 0.05 * len(values) + 1


@pytest.mark.parametrize("draw", [lambda g: g.integers(0, 100), lambda g: int(g.lognormal(8, 3)), lambda g: 7 if g.random() < 0.4 else int(g.integers(0, 1 << 40)), lambda g: 0])
def test_percentiles_within_their_stated_error(spark, draw):
    g = np.random.default_rng(4)
    values = [int(draw(g)) for _ in range(4000)]
    check(q.percentiles(sketched(spark, values), PROBABILITIES), values)


def test_codes_keep_the_order():
    rng = random.Random(1)
    values = sorted({rng.randrange(1 << rng.randrange(1, 63)) for _ in range(5000)} | {0, 1, (1 << 62) + 1})
    codes = q.encode(np.array(values))
    assert (np.diff(codes) >= 0).all() and codes.max() < 1 << q.LEVELS
    assert all(abs(q.decode(int(c)) - v) <= v * 2.0**-q.PRECISION for c, v in zip(codes, values))


def test_days_are_merged_and_deleted(spark):
    g = np.random.default_rng(5)
    days = [[int(x) for x in g.integers(0, 5000 * (d + 1), 800)] for d in range(3)]
    sketches = [sketched(spark, d) for d in days]
    check(q.percentiles(q.merged(*sketches), PROBABILITIES), sum(days, []))
    df = spark.createDataFrame([(v,) for v in days[2]], "v long")
    gone = q.sketch(df, "f", F.lit("g"), F.col("v"), F.lit(-1))
    check(q.percentiles(q.merged(*sketches, gone), PROBABILITIES), days[0] + days[1])
    every = q.merged(sketches[2], gone)
    assert every.count() == 0 == q.percentiles(every, PROBABILITIES).count()


def test_nulls_negatives_groups_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", None, 9), ("a", -1, 9), (None, 5, 9), ("b", None, 9)], "field_name string, v long, cell int")
    found = q.percentiles(q.sketch(df, "f", F.col("field_name"), F.col("v")), [0.5]).collect()
    assert {(r.group_key, r.n, r.value, r.rank_error) for r in found} == {("a", 1, 1.0, 0.0), (None, 1, 5.0, 0.0)}
    assert q.percentiles(q.sketch(df.limit(0), "f", F.col("field_name"), F.col("v")), [0.5]).count() == 0
