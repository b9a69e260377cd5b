"""Analysis of benchmark results: filled gaps, trimmed runs, groups, best methods, histograms.

All steps are relational; windows are partitioned by the run, configuration or
group, never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- columns ----------------------------------------------------------------------------------------------------


def filled(df: DataFrame, partition: list[str], order: list[str], columns: list[str], default: float | None = -1) -> DataFrame:
    """Null ``columns`` take the last value before them in their partition; numeric ones without any take ``default``."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})
    return out if default is None else out.na.fill(default, [c for c in columns if c not in partition])


def with_times(df: DataFrame) -> DataFrame:
    """``overall_match_time`` (compile and match) and ``overall_time`` (index and match) added."""
    match = F.col("compile_time") + F.col("match_time")
    return df.withColumn("overall_match_time", match).withColumn("overall_time", F.col("overall_index_time") + match)


def precision(matches: Column, candidates: Column, zero_as_one: bool = False) -> Column:
    """Matches per candidate; without candidates null, or (``zero_as_one``) as if there were one."""
    return F.try_divide(matches.cast("double"), F.when(candidates == 0, 1).otherwise(candidates) if zero_as_one else candidates)


def relative_error(estimate: Column, truth: Column) -> Column:
    """Deviation from the truth in proportion to it; null for a truth of 0."""
    return F.try_divide(F.abs(estimate - truth).cast("double"), truth)


def method_of(name: Column) -> Column:
    """The part of a run's name before the first hyphen."""
    return F.substring_index(name, "-", 1)


def parsed_config(name: Column) -> Column:
    """``synthetic..._{dataset}_{queries}_{selectivity}_{method}_{suffix}`` as a struct; null if a part is missing or no number."""
    part = F.split(name, "_")
    at = lambda i: F.get(part, F.lit(i))
    dataset, queries, selectivity = at(1).try_cast("int"), at(2).try_cast("int"), at(3).try_cast("double")
    good = name.startswith("synthetic") & (F.size(part) >= 5) & dataset.isNotNull() & queries.isNotNull() & selectivity.isNotNull()
    suffix = F.array_join(F.slice(part, 6, F.greatest(F.size(part) - 5, F.lit(0))), "_")
    found = F.struct(dataset.alias("dataset_size"), queries.alias("query_size"), selectivity.alias("selectivity"), at(4).alias("method_name"), suffix.alias("suffix"), name.alias("folder_name"))
    return F.when(good, found)


# -- runs and groups --------------------------------------------------------------------------------------------


def without_extreme_runs(df: DataFrame, config: list[str], by: str, order: list[str], more_than: int = 2) -> DataFrame:
    """Without the fastest and the slowest run of each configuration, provided every configuration has more than ``more_than`` runs."""
    group = Window.partitionBy(*config)
    place = F.row_number().over(group.orderBy(by, *order))
    marked = df.withColumn("_place", place).withColumn("_runs", F.count(F.lit(1)).over(group))
    fewest = marked.agg(F.min("_runs")).first()[0]
    if fewest is None or fewest <= more_than:
        return df
    return marked.filter("_place > 1 and _place < _runs").drop("_place", "_runs")


def trimmed_mean(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group, n, mean, trimmed_mean)``: of more than three values the least and the greatest don't count in the trimmed mean."""
    x = F.col(value).cast("double")
    sums = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(x).alias("mean"), F.sum(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return sums.select(*group, "n", "mean", F.when(F.col("n") > 3, (F.col("s") - F.col("lo") - F.col("hi")) / (F.col("n") - 2)).otherwise(F.col("mean")).alias("trimmed_mean"))


def group_minimum(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """The least value of each column by itself within each group."""
    return df.groupBy(*group).agg(*(F.min(c).alias(c) for c in columns))


def group_mean(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """The average of each column within each group."""
    return df.groupBy(*group).agg(*(F.avg(c).alias(c) for c in columns))


def group_summary(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest value of each column within each group."""
    return df.groupBy(group).agg(*(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))


def best_groups(df: DataFrame, group: str, higher: list[str], lower: list[str]) -> DataFrame:
    """``(metric, best, value)``: the group with the best average; for ``lower`` metrics only values above 0 count.  Ties by the group's name."""
    means = df.groupBy(group).agg(*(F.avg(c).alias(c) for c in higher), *(F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in lower))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(-1.0 if c in higher else 1.0).alias("sign")) for c in higher + lower)))
    long = means.select(group, pairs.alias("x")).select(group, "x.*").filter("value is not null")
    best = long.groupBy("metric").agg(F.min(F.struct((F.col("sign") * F.col("value")).alias("key"), F.col(group).alias("best"), "value")).alias("b"))
    return best.select("metric", "b.best", "b.value")


def first_of_group(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The whole first row of each group; the order should end with a unique column."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_place = 1").drop("_place")


def best_within_limits(df: DataFrame, limits: list[int], method: str, size: str, order: list[Column | str], limit_name: str = "key_limit") -> DataFrame:
    """For each limit the first row of each method among those whose ``size`` is within it.

    A row goes to the limits it satisfies; the limits are a short list.
    """
    fitting = F.filter(F.array(*map(F.lit, limits)), lambda x: F.col(size) <= x)
    return first_of_group(df.withColumn(limit_name, F.explode(fitting)), [limit_name, method], order)


def marked_best(df: DataFrame, group: list[str], lowest: list[str], highest: list[str]) -> DataFrame:
    """A flag per column: whether the row has the best value of its group."""
    own = Window.partitionBy(*group)
    return df.withColumns({f"{c}_best": F.col(c) == f(c).over(own) for cs, f in ((lowest, F.min), (highest, F.max)) for c in cs})


def differences(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """``difference`` and ``relative_difference`` to the next row; the last row of a partition is left out."""
    after = F.lead(value).over(Window.partitionBy(*partition).orderBy(*order))
    out = df.withColumn("difference", after - F.col(value)).filter("difference is not null")
    return out.withColumn("relative_difference", F.try_divide(F.col("difference").cast("double"), F.col(value)))


def joined_stats(runs: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the sums of their per-pattern rows: ``sum_matches``, ``sum_after_filter``, ``precision``; runs without any keep nulls."""
    sums = stats.groupBy(*keys).agg(F.sum("match_count").alias("sum_matches"), F.sum("num_after_filter").alias("sum_after_filter"))
    return runs.join(sums, keys, "left").withColumn("precision", precision(F.col("sum_matches"), F.col("sum_after_filter")))


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows under all columns; a part without a column has nulls there."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


# -- histograms -------------------------------------------------------------------------------------------------


def equal_width_histogram(df: DataFrame, value: str, bins: int = 10, logarithmic: bool = False) -> DataFrame:
    """``(bin, lower, upper, n)``: ``bins`` bins of equal width between the extremes, empty ones included; the last one is closed.

    ``logarithmic`` puts the edges at equal distances of ``log10(value + 1)``.
    Equal extremes are widened by a half to either side.
    """
    x = F.log10(F.col(value) + 1) if logarithmic else F.col(value).cast("double")
    rows = df.select(x.alias("x")).filter("x is not null")
    lo, hi = rows.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    found = rows.groupBy(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame([(b, lo + b * width, lo + (b + 1) * width) for b in range(bins)], "bin int, lower double, upper double")
    return edges.join(found, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def equal_count_edges(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """``(edge_no, edge)``: edges that part the sorted values into bins of equal counts, interpolated between neighbours at places ``i * n / bins``.

    Equal values are counted first; the places are found in their running sums.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([], "edge_no int, edge double")
    places = [min(i * total / bins, total - 1) for i in range(bins + 1)]
    wanted = spark.createDataFrame([(i, int(p), min(int(p) + 1, total - 1), float(p - int(p))) for i, p in enumerate(places)], "edge_no int, lower long, upper long, part double")
    ends = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).selectExpr("v", "upto - n as since", "upto")
    hit = lambda c: (F.col(c) >= F.col("since")) & (F.col(c) < F.col("upto"))
    found = wanted.join(ends, hit("lower") | hit("upper"))
    both = found.groupBy("edge_no", "part").agg(F.max(F.when(hit("lower"), F.col("v"))).alias("a"), F.max(F.when(hit("upper"), F.col("v"))).alias("b"))
    return both.select("edge_no", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("edge"))


def binned(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``bin``: the number of the half-open interval ``[edge, next edge)`` of the value, null outside."""
    bin_ = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        bin_ = F.when((F.col(value) >= a) & (F.col(value) < b), k).otherwise(bin_)
    return df.withColumn("bin", bin_)


def selectivities(counts: DataFrame, n_records: int) -> DataFrame:
    """``counts(pattern, match_count)`` with ``selectivity`` over the records."""
    return counts.withColumn("selectivity", F.try_divide(F.col("match_count").cast("double"), F.lit(n_records)))


def within_tolerance(selectivity: Column, target: float) -> Column:
    """Whether a selectivity is as near to its target as a generated query must be: by three tenths of it, or by 0.01."""
    return F.abs(selectivity - target) <= max(0.3 * target, 0.01)
