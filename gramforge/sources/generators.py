"""Synthetic corpora and query sets with seeds.

A row is drawn from a generator seeded by ``(seed, row number)``, so the result
doesn't depend on partitions and a lost task draws the same rows again.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators.match import scan_counts
from gramforge.operators.results import selectivities
from gramforge.operators.selectors.trigram import sample

UPPER = string.ascii_uppercase
WIDE = string.ascii_uppercase + string.digits + string.punctuation

# The predefined configurations.
CONFIGS = {
    "small": {"alphabets": [4, 8, 16], "sizes": [1_000, 5_000, 10_000], "queries": [50, 100, 200], "selectivities": [0.01, 0.05, 0.1, 0.2], "lengths": {"mean": 100, "std": 20, "min": 20, "max": 200}},
    "medium": {"alphabets": [8, 16, 26, 32], "sizes": [10_000, 50_000, 100_000], "queries": [100, 500, 1_000], "selectivities": [0.005, 0.01, 0.02, 0.05, 0.1], "lengths": {"mean": 150, "std": 30, "min": 50, "max": 300}},
    "large": {"alphabets": [16, 26, 52, 64], "sizes": [50_000, 100_000, 200_000, 500_000], "queries": [500, 1_000, 2_000, 5_000], "selectivities": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2], "lengths": {"mean": 200, "std": 50, "min": 50, "max": 500}},
    "fixed": {"alphabets": [4, 8, 12, 16, 26], "sizes": [20_000, 40_000, 60_000, 80_000, 100_000], "queries": [100, 500, 2_000, 2_500, 5_000], "selectivities": [0.01, 0.05, 0.1], "lengths": {"fixed": 450}},
}


def _drawn(spark: SparkSession, n: int, seed: int, draw: Callable[[np.random.Generator, int], str]) -> DataFrame:
    """``(rec_id, text)``: ``n`` rows of ``draw(generator, row number)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"rec_id": pa.array(ids, pa.int64()), "text": pa.array([draw(np.random.default_rng((seed, i)), i) for i in ids], pa.string())})

    return spark.range(n).mapInArrow(run, "rec_id long, text string")


def _letters(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(len(alphabet), size=n))


def fixed_length_strings(spark: SparkSession, n: int, length: int = 450, alphabet: str = UPPER, seed: int = 0) -> DataFrame:
    """Strings of one length."""
    return _drawn(spark, n, seed, lambda rng, _: _letters(rng, alphabet, length))


def geometric_strings(spark: SparkSession, n: int, alphabet_size: int, seed: int = 0) -> DataFrame:
    """Strings that end after each character with a probability of one in ten times the alphabet."""
    return _drawn(spark, n, seed, lambda rng, _: _letters(rng, UPPER[:alphabet_size], int(rng.geometric(1 / (10 * alphabet_size)))))


def normal_length_strings(spark: SparkSession, n: int, alphabet_size: int, lengths: dict, seed: int = 0) -> DataFrame:
    """Strings of normally distributed, clipped lengths, or of a fixed one."""

    def draw(rng: np.random.Generator, _: int) -> str:
        size = lengths.get("fixed") or int(np.clip(int(rng.normal(lengths.get("mean", 100), lengths.get("std", 20))), max(lengths.get("min", 10), 1), lengths.get("max", 500)))
        return _letters(rng, WIDE[:alphabet_size], size)

    return _drawn(spark, n, seed, draw)


def trigram_strings(spark: SparkSession, n: int, means: tuple[float, float] = (100, 1_000), std: float = 50, seed: int = 0, alphabet: str = UPPER) -> DataFrame:
    """Strings of trigrams drawn by target frequencies from two normal distributions; each trigram is the last with a probability of 0.3.

    The frequencies are a table over the alphabet's trigrams; drawing in
    proportion to them takes the place of counting used ones up, so rows are
    independent of each other.
    """
    grams = ["".join(g) for g in product(alphabet, repeat=3)]
    rng = np.random.default_rng((seed, 1 << 40))
    larger = int(len(grams) * rng.uniform(0.6, 0.9))
    weights = np.concatenate([rng.normal(means[0], std, larger), rng.normal(means[1], std, len(grams) - larger)])
    weights = np.maximum(np.abs(weights).astype(int), 1)
    rng.shuffle(weights)
    upto = np.cumsum(weights) / weights.sum()
    return _drawn(spark, n, seed, lambda r, _: "".join(grams[min(int(np.searchsorted(upto, u)), len(grams) - 1)] for u in r.random(int(r.geometric(0.3)))))


def sampled(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of the rows without replacement, exactly ``int(n * share)`` of them."""
    return sample(df, ["rec_id"], int(df.count() * share), seed)


# -- queries ----------------------------------------------------------------------------------------------------


def key_queries(n: int, seed: int = 0) -> list[str]:
    """Patterns of three random keys of 3 to 8 capitals with two bounded gaps."""
    rng = np.random.default_rng(seed)
    key = lambda: _letters(rng, UPPER, int(rng.integers(3, 9)))
    gap = lambda: "(.{%d,%d})" % (rng.integers(2), rng.integers(1, 51))
    return [key() + gap() + key() + gap() + key() for _ in range(n)]


def _gap_query(rng: np.random.Generator, text: str, slices: int, low: int, high: int) -> str:
    """Slices of a text from left to right, with gaps of up to 50 characters between them; the last one may be cut by the text's end."""
    at = int(rng.integers(0, max(len(text) - (low if slices == 2 else 3 * low + 1), 0) + 1))
    out = ""
    for k in range(slices):
        length = int(rng.integers(low, high + 1))
        piece = text[at : at + length]
        out += piece
        if k + 1 == slices or (k and at + high >= len(text)):
            return out
        gap = int(rng.integers(1, max(1, min(50, len(text) - len(piece) - 1)) + 1))
        out += "(.{0,%d})" % gap
        at += length + gap
    return out


def gap_queries(strings: DataFrame, n: int, slices: int = 2, low: int = 3, high: int = 8, seed: int = 0) -> list[str]:
    """``n`` patterns from slices of strings; each pattern is made from one of the longer strings, drawn with replacement.

    At most ``n`` strings come to the driver.
    """
    long_enough = strings.filter(F.length("text") >= (low if slices == 2 else 3 * low) + 1)
    drawn = [r.text for r in sample(long_enough, ["rec_id"], n, seed).collect()]
    if not drawn:
        return []
    rng = np.random.default_rng((seed, slices))
    return [_gap_query(rng, drawn[int(rng.integers(len(drawn)))], slices, low, high) for _ in range(n)]


def _aimed(rng: np.random.Generator, alphabet: str, target: float) -> str:
    part = lambda lo, hi: _letters(rng, alphabet, int(rng.integers(lo, hi + 1)))
    gap = lambda most: "(.{0,%d})" % rng.integers(1, most + 1)
    if target > 0.1:
        return part(2, 3) + gap(10)
    if target > 0.05:
        return part(3, 4) + gap(15) + part(2, 3)
    return part(4, 6) + gap(20) + part(3, 5) + gap(20) + part(2, 4)


def selectivity_queries(corpus: DataFrame, alphabet: str, n: int, target: float, attempts: int = 50, seed: int = 0) -> DataFrame:
    """``(query_no, pattern, selectivity, hit)``: per query the first attempt within the tolerance of the target, else the nearest one.

    The attempts of all queries are drawn first and measured together in one
    pass over the corpus.
    """
    spark = corpus.sparkSession
    from gramforge.functions.regex import parse  # the alphabet may have signs of the language

    import re

    rng = np.random.default_rng((seed, int(target * 1e6)))
    tries = []
    for q in range(n):
        for a in range(attempts):
            raw = _aimed(rng, alphabet, target)
            pattern = "".join(x if x.startswith("(.{") else re.escape(x) for x in re.split(r"(\(\.\{0,\d+\}\))", raw))
            parse(pattern)
            tries.append((q, a, pattern))
    measured = selectivities(scan_counts(corpus, sorted({p for _, _, p in tries})), corpus.count()).select("pattern", "selectivity")
    rows = spark.createDataFrame(tries, "query_no int, attempt int, pattern string").join(measured, "pattern")
    off = F.abs(F.col("selectivity") - target)
    hit = off <= max(0.3 * target, 0.01)
    order = F.struct(F.when(hit, 0).otherwise(1), F.when(hit, F.lit(0.0)).otherwise(off), "attempt")
    return rows.groupBy("query_no").agg(F.min_by(F.struct("pattern", "selectivity", hit.alias("hit")), order).alias("x")).select("query_no", "x.*")


def configurations(spark: SparkSession, name: str) -> DataFrame:
    """``(alphabet_size, dataset_size, query_set_size, target_selectivity, identifier)``: every combination of a predefined configuration."""
    c = CONFIGS[name]
    rows = [(a, d, q, s, f"a{a}_d{d}_q{q}_s{s}") for a, d, q, s in product(c["alphabets"], c["sizes"], c["queries"], c["selectivities"])]
    return spark.createDataFrame(rows, "alphabet_size int, dataset_size int, query_set_size int, target_selectivity double, identifier string")


def generate(spark: SparkSession, name: str, alphabet_size: int, dataset_size: int, query_set_size: int, target: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries with their selectivities) of one combination."""
    corpus = normal_length_strings(spark, dataset_size, alphabet_size, CONFIGS[name]["lengths"], seed)
    return corpus, selectivity_queries(corpus, WIDE[:alphabet_size], query_set_size, target, seed=seed)
