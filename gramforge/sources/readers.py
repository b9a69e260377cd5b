"""Readers of corpora, query sets and result files.

Texts are read by Spark's file sources; a missing path gives an empty table, as
a workload may come without some of its files.  ``most`` caps are a feature of
the readers and off by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.operators.selectors.trigram import sample
from gramforge.plans.cut import written

SUMMARY = T.StructType([T.StructField(n, t) for n, t in (
    ("name", T.StringType()), ("num_threads", T.IntegerType()), ("gram_size", T.IntegerType()), ("selectivity", T.DoubleType()), ("key_upper_bound", T.LongType()),
    ("num_queries", T.IntegerType()), ("selection_time", T.DoubleType()), ("build_time", T.DoubleType()), ("overall_index_time", T.DoubleType()), ("num_keys", T.LongType()),
    ("index_size", T.LongType()), ("compile_time", T.DoubleType()), ("match_time", T.DoubleType()),
)])
REGEX_STATS = "regex string, time double, count long, num_after_filter long"


def _existing(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _capped(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else df.limit(most)


def read_lines(spark: SparkSession, path: str, most: int | None = None, recursive: bool = False) -> DataFrame:
    """``(path, text)``: one record per line of a file or of all files below a folder; carriage returns are deleted, empty lines are kept."""
    read = lambda: spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("text"))
    return _capped(_existing(read, spark, "path string, text string"), most)


def read_documents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``(path, text)``: one record per file below a folder, without carriage returns and its final newline."""
    read = lambda: spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n\z", "").alias("text"))
    return _capped(_existing(read, spark, "path string, text string"), most)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"path": b.column(0), "text": pa.array([x.as_py().decode("utf-8", "ignore") for x in b.column(1)], pa.string())})


def read_raw(spark: SparkSession, path: str, encoding: str = "utf-8", ignore_errors: bool = False) -> DataFrame:
    """``(path, text)``: whole files as they are; bytes that don't decode become replacement characters, or vanish (``ignore_errors``)."""
    raw = _existing(lambda: spark.read.format("binaryFile").load(path).select("path", "content"), spark, "path string, content binary")
    return raw.mapInArrow(_decode, "path string, text string") if ignore_errors else raw.select("path", F.decode("content", encoding).alias("text"))


def read_csv_field(spark: SparkSession, path: str, index: int = 9, most: int | None = None) -> DataFrame:
    """``(path, text)``: the field of this number (from 0) of lines parted at every comma, header included; lines with fewer fields are left out."""
    rows = read_lines(spark, path).select("path", F.get(F.split("text", ","), F.lit(index)).alias("text")).filter("text is not null")
    return _capped(rows, most)


def read_csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(path, text)``: a column of CSV files with header and quoting."""
    return spark.read.option("header", True).csv(path).select(F.col("_metadata.file_path").alias("path"), F.col(column).alias("text")).filter("text is not null")


def stats_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: lines without trailing carriage returns; empty ones are left out."""
    read = lambda: spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r+\z", "").alias("text"))
    return _existing(read, spark, "path string, text string").filter("text <> ''")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """``(pattern)``: the non-empty lines of a query file, trailing carriage returns taken off."""
    return stats_lines(spark, path).select(F.col("text").alias("pattern"))


def records(df: DataFrame, least: int = 0) -> DataFrame:
    """``(rec_id, text)`` with ids given once and kept in a table (so they can't change on a re-run); texts below ``least`` characters are left out."""
    return written(df.filter(F.length("text") >= least).select(F.monotonically_increasing_id().alias("rec_id"), "text"))


# -- results ----------------------------------------------------------------------------------------------------


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary file (CSV with header); its blank cells are nulls."""
    return spark.read.schema(SUMMARY).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def read_regex_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per-pattern files (tab separated, with header) and the file each row is from."""
    return spark.read.schema(REGEX_STATS).option("header", True).option("sep", "\t").csv(path).select("*", F.col("_metadata.file_path").alias("path"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a CSV without header."""
    return spark.read.schema("key string, value string").csv(path)


def peak_memory(texts: DataFrame) -> DataFrame:
    """``(path, max_resident_kb)`` of time reports ``(path, text)``; reports without the figure are left out."""
    found = F.regexp_extract("text", r"Maximum resident set size \(kbytes\): *([0-9]+)", 1)
    return texts.select("path", F.when(found != "", found.cast("long")).alias("max_resident_kb")).filter("max_resident_kb is not null")


# -- corpora in other forms -------------------------------------------------------------------------------------


def web_pages(pages: DataFrame, patterns: list[str], share: float = 0.002, most_per_pattern: int = 10_000, most: int | None = 700_000, seed: int = 0) -> DataFrame:
    """HTML pages ``(rec_id, content_type, text)`` that match a pattern, and a share of the others.

    A page counts for the first pattern it matches; beyond ``most_per_pattern``
    pages (in the order of a hash) a pattern is saturated and its pages are
    treated as the others.  The caps are those of the extraction.
    """
    from gramforge.functions.regex import to_java
    from pyspark.sql import Window

    html = pages.filter(F.col("content_type").contains("text/html"))
    first = F.coalesce(*(F.when(F.col("text").rlike(to_java(p)), n) for n, p in enumerate(patterns))) if patterns else F.lit(None).cast("int")
    drawn = F.pmod(F.xxhash64("rec_id", F.lit(seed)), F.lit(1_000_000))
    marked = html.select("rec_id", "text", first.alias("pattern_no"), drawn.alias("drawn"))
    matching = marked.filter("pattern_no is not null").withColumn("place", F.row_number().over(Window.partitionBy("pattern_no").orderBy("drawn", "rec_id")))
    kept = matching.filter(F.col("place") <= most_per_pattern).unionByName(matching.filter((F.col("place") > most_per_pattern) & (F.col("drawn") < share * 1_000_000)))
    rest = marked.filter((F.col("pattern_no").isNull()) & (F.col("drawn") < share * 1_000_000)).withColumn("place", F.lit(None).cast("int"))
    out = kept.unionByName(rest).select("rec_id", "text", "pattern_no")
    return out if most is None else out.limit(most)


def publications(texts: DataFrame) -> DataFrame:
    """``(rec_id, no, title, authors)`` of records in the tag format ``#*`` title, ``#@`` authors: each title with the authors' line that follows it; titles without authors are left out."""
    entry = F.regexp_extract_all("text", F.lit(r"(?m)^(#\*[^\r\n]*\r?\n(?:(?!#[*@])[^\n]*\n)*#@[^\r\n]*)"), F.lit(1))
    rows = texts.select("rec_id", F.posexplode(entry).alias("no", "entry"))
    parts = rows.select("rec_id", "no", F.regexp_extract("entry", r"^#\*([^\r\n]*)", 1).alias("title"), F.regexp_extract("entry", r"(?m)^#@([^\r\n]*)", 1).alias("authors"))
    return parts.filter("trim(authors) <> ''")


def last_names(authors: DataFrame, column: str = "authors") -> DataFrame:
    """``(last_name)``: the last word of each name of a comma separated list."""
    names = authors.select(F.explode(F.split(column, ",")).alias("name"))
    return names.select(F.element_at(F.split("name", " "), -1).alias("last_name"))


def name_queries(names: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """``(pattern)``: for (``n`` drawn) last names the pattern of a list with another name before it."""
    chosen = names if n is None else sample(names, ["last_name"], n, seed)
    return chosen.select(F.format_string("([^,]+) %s", "last_name").alias("pattern"))


def distinct_sequences(df: DataFrame, column: str = "text") -> DataFrame:
    """The different non-empty sequences of collected pages of results."""
    return df.select(column).filter(F.col(column) != "").distinct()


# -- workloads --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Workload:
    """A corpus ``(rec_id, text)``, its queries ``(pattern)``, and the separate queries to match with, if any."""

    corpus: DataFrame
    queries: DataFrame
    test_queries: DataFrame | None = None

    @property
    def matched(self) -> DataFrame:
        return self.queries if self.test_queries is None else self.test_queries


# The kinds of workload by number and how their corpus is stored.
KINDS = {0: "lines", 1: "csv_field", 2: "directory", 3: "raw", 4: "directory", 5: "lines", 6: "documents"}


def read_workload(spark: SparkSession, kind: int, queries: str, corpus: str, test_queries: str | None = None, most: int | None = None) -> Workload:
    """The workload of a kind: own files (0), accident reports (1), database logs (2), web pages (3), protein sequences (4), tagged records (5), mails (6).

    Raises if the queries or the corpus are empty.
    """
    if kind not in KINDS:
        raise ValueError(f"no kind of workload {kind}")
    how = KINDS[kind]
    if how == "csv_field":
        texts = read_csv_field(spark, corpus, most=most)
    elif how == "raw":
        texts = _capped(read_raw(spark, corpus), most)
    elif how == "documents":
        texts = read_documents(spark, corpus, most)
    else:
        texts = read_lines(spark, corpus, most, recursive=how == "directory")
    loaded = Workload(records(texts), read_patterns(spark, queries), read_patterns(spark, test_queries) if test_queries else None)
    if not loaded.corpus.limit(1).count() or not loaded.queries.limit(1).count():
        raise ValueError("a workload needs queries and a corpus")
    return loaded
