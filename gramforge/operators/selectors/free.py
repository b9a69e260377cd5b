"""Shortest selective grams, level by level (FREE), and the removal of keys with redundant suffixes.

A gram is useful if at most a share ``c`` of the records contain it.  Useful
grams become keys, the others are extended by one character; so no key is a
prefix of another.  Unigrams and bigrams are counted in one pass (records of
one character give none), each further level in one pass of its own that only
regards extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.postings import document_frequency
from gramforge.operators.selectors.common import KEYS, bounded, level_counts, prefix_of
from gramforge.plans.cut import written


def first_levels(corpus: DataFrame) -> DataFrame:
    """``(gram, df)`` of the uni- and bigrams of the records with two characters or more."""
    return document_frequency(exploded(corpus.filter("length(text) >= 2"), [1, 2]))


def split(level: DataFrame, n_records: int, c: float) -> tuple[DataFrame, DataFrame]:
    """(useful, to be extended) grams of a level."""
    useful = F.col("df") / F.lit(float(n_records)) <= F.lit(float(c))
    return level.filter(useful), level.filter(~useful)


def free_keys(corpus: DataFrame, c: float = 0.1, upper_n: int = 5, most: int | None = None) -> DataFrame:
    """``(gram, df)``: the keys of up to ``upper_n`` characters (two at least are looked at), at most ``most`` of them.

    No records give no keys.
    """
    n = corpus.count()
    if not n:
        return corpus.sparkSession.createDataFrame([], KEYS)
    both = written(first_levels(corpus))
    keys, extend = split(both.filter("length(gram) = 1"), n, c)
    level = both.filter("length(gram) = 2").join(extend.select(F.col("gram").alias("prefix")), prefix_of(2) == F.col("prefix"), "left_semi")
    useful, extend = split(level, n, c)
    keys = keys.unionByName(useful)
    for k in range(3, upper_n + 1):
        if extend.limit(1).count() == 0 or (most is not None and keys.limit(most).count() >= most):
            break
        useful, extend = split(level_counts(corpus, k, extend), n, c)
        keys = keys.unionByName(useful)
    return bounded(keys, most)


def without_suffixes(keys: DataFrame) -> DataFrame:
    """The keys of which no proper suffix is a key: whatever they filter, the suffix filters, too (if less strictly)."""
    suffixes = keys.select("gram", F.explode(F.when(F.length("gram") > 1, F.sequence(F.lit(2), F.length("gram"))).otherwise(F.array().cast("array<int>"))).alias("at")).select("gram", F.expr("substring(gram, at)").alias("suffix"))
    redundant = suffixes.join(keys.select(F.col("gram").alias("suffix")), "suffix", "left_semi").select("gram")
    return keys.join(redundant, "gram", "left_anti")


def presuf_shell(keys: DataFrame) -> DataFrame:
    """The keys left by comparing neighbours only: reversed keys in order, one dropped if the one before it is its prefix.

    Weaker than :func:`without_suffixes` (``a, ba, ca`` keeps ``ca``).  A prefix
    shares the first character, so each first character is a window of its own.
    """
    order = Window.partitionBy(F.substring("rev", 1, 1)).orderBy("rev")
    marked = keys.withColumn("rev", F.reverse("gram")).withColumn("before", F.lag("rev").over(order))
    return marked.filter("before is null or not startswith(rev, before)").drop("rev", "before")
