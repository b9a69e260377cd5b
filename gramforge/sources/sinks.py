"""Writers of indexes, statistics and results.

Everything is written by Spark's file sinks, so a result is a folder of part
files; readers take the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators.postings import packed
from gramforge.sources.readers import REGEX_STATS, SUMMARY


def append_summary(summary: DataFrame, path: str) -> None:
    """Add rows to a summary (CSV with a header in each part, so that reading with a header takes any number of appends)."""
    summary.select(*SUMMARY.fieldNames()).write.mode("append").option("header", True).csv(path)


def write_regex_stats(stats: DataFrame, path: str) -> None:
    """Per-pattern rows ``(regex, time, count, num_after_filter)`` as tab separated values with header."""
    names = [c.split()[0] for c in REGEX_STATS.split(", ")]
    stats.select(*names).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_keys(keys: DataFrame, path: str) -> None:
    """The keys, one per line, in order over the part files.  Line breaks within a key are escaped, as are backslashes."""
    escaped = F.replace(F.replace(F.replace("gram", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    keys.orderBy("gram").select(escaped.alias("value")).write.mode("overwrite").text(path)


def printed_index(rows: DataFrame, full: bool = False) -> DataFrame:
    """``(gram, df)``, or with ``full`` the ids themselves in blocks ``(gram, block_no, n, rec_ids)``, in order of the grams."""
    return packed(rows).orderBy("gram", "block_no") if full else rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).orderBy("gram")


def write_stats(stats: DataFrame, path: str, as_json: bool = False) -> None:
    """Dataset statistics as CSV with header or as JSON lines (nested columns need JSON)."""
    w = stats.write.mode("overwrite")
    w.json(path) if as_json else w.option("header", True).csv(path)


def write_literals(rows: DataFrame, path: str) -> None:
    """Literal analysis as CSV: the literals of a pattern joined by semicolons, patterns numbered in order."""
    numbered = rows.withColumn("literals", F.concat_ws(";", "literals"))
    numbered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """Strings or patterns, one per line; texts with line breaks are written as JSON lines by :func:`write_stats` instead."""
    broken = F.when(F.col(column).contains("\n"), F.raise_error(F.lit("a text has a line break"))).otherwise(F.col(column))
    texts.select(broken.cast("string").alias("value")).write.mode("overwrite").text(path)


def concatenated_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of CSV files with equal headers, which count once."""
    return spark.read.option("header", True).csv(paths)


def latex_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """``(value)``: rows of a LaTeX table, best cells (``<column>_best``) in bold."""
    cells = [F.when(F.col(f"{c}_best"), F.concat(F.lit("\\textbf{"), F.col(c).cast("string"), F.lit("}"))).otherwise(F.col(c).cast("string")) if f"{c}_best" in table.columns else F.col(c).cast("string") for c in columns]
    return table.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("value"))
