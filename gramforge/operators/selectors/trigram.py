"""All grams of three characters, or a bounded number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.postings import document_frequency


def trigram_keys(corpus: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """``(gram, df)`` of all trigrams; with ``most`` a sample without replacement that depends on the seed only."""
    keys = document_frequency(exploded(corpus, [3]))
    return keys if most is None else sample(keys, ["gram"], most, seed)


def sample(df: DataFrame, by: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those with the least hashes of ``by`` and the seed, so a rerun draws the same ones."""
    return df.orderBy(F.xxhash64(*by, F.lit(seed)), *by).limit(n)
