"""Queries of the file readers and sinks: tables are written by a sink and read back by its reader; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions import grams
from gramforge.operators import corpus_stats
from gramforge.operators.selectors import free
from gramforge.plans.cut import own_folder
from gramforge.queries_search import _DOCS, _free
from gramforge.sources import readers, sinks
from gramforge.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/files-{uuid.uuid4().hex}"


def _text_files(spark: SparkSession, d: str, name: str, column: str) -> str:
    path = _folder(spark)
    table(spark, d, name).filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.text(path)
    return path


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def files_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line reader: every line of the documents as a record."""
    return _counted(readers.read_lines(spark, _text_files(spark, d, "documents", "text"), recursive=True))


def files_stats_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without trailing carriage returns and empty ones."""
    return _counted(readers.stats_lines(spark, _text_files(spark, d, "documents", "text")))


def files_csv_field(spark: SparkSession, d: str) -> DataFrame:
    """The tenth field of naively parted lines."""
    return _counted(readers.read_csv_field(spark, _text_files(spark, d, "result_lines", "line"), 9))


def files_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines with ids given once: as many ids as lines of three characters or more."""
    found = readers.records(readers.read_lines(spark, _text_files(spark, d, "documents", "text")), 3)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_id").alias("n_ids"))


def files_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Query file: written one pattern per line, read back."""
    path = _folder(spark)
    sinks.write_texts(table(spark, d, "queries").filter("pattern is not null"), path, "pattern")
    return readers.read_patterns(spark, path)


def files_workload(spark: SparkSession, d: str) -> DataFrame:
    """A workload of own files: sizes of its corpus and query set."""
    path = _folder(spark)
    sinks.write_texts(table(spark, d, "queries").filter("pattern is not null"), path, "pattern")
    w = readers.read_workload(spark, 0, path, _text_files(spark, d, "part", "p_name"))
    return spark.createDataFrame([(w.corpus.count(), w.queries.count())], "n_records long, n_queries long")


def files_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary file in two appends."""
    runs, path = table(spark, d, "summary").filter("name is not null").distinct(), _folder(spark)
    for part in ("mail", "road"):
        sinks.append_summary(runs.filter(F.col("workload") == part), path)
    return readers.read_summary(spark, path).select("name", "num_threads", "gram_size", "selectivity", "num_keys", "index_size")


def files_regex_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tab separated per-pattern rows."""
    path = _folder(spark)
    rows = table(spark, d, "regex_stats").select("regex", F.col("time_s").alias("time"), F.col("match_count").alias("count"), "num_after_filter").filter("regex is not null")
    sinks.write_regex_stats(rows, path)
    return readers.read_regex_stats(spark, path).groupBy("regex").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("matches"), F.sum("num_after_filter").alias("candidates"))


def files_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys one per line, line breaks escaped."""
    path = _folder(spark)
    sinks.write_keys(free.free_keys(grams.corpus(table(spark, d, "documents"), "doc_id", "text"), 0.1, 2), path)
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "gram")


def files_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Dataset statistics as JSON, read back."""
    path = _folder(spark)
    sinks.write_stats(table(spark, d, "dataset_stats").filter("stats_id is not null").select("stats_id", "dataset_name", "total_lines", "alphabet_size").distinct(), path, as_json=True)
    return spark.read.schema("stats_id long, dataset_name string, total_lines long, alphabet_size long").json(path)


def files_literals(spark: SparkSession, d: str) -> DataFrame:
    """Literal analysis as CSV, two copies concatenated."""
    path = _folder(spark)
    sinks.write_literals(corpus_stats.literal_rows(table(spark, d, "queries"), mode="compat"), path)
    return sinks.concatenated_csv(spark, [path, path]).select("regex", F.col("num_literals").cast("int").alias("num_literals"))


def files_printed_index(spark: SparkSession, d: str) -> DataFrame:
    """Index with the sizes of its lists."""
    return sinks.printed_index(grams.exploded(grams.corpus(table(spark, d, "part"), "p_partkey", "p_name"), [2]))


# Time reports.
REPORTS = [("a", "Command being timed: x\n\tMaximum resident set size (kbytes): 123456\n"), ("b", "nothing"), ("c", "Maximum resident set size (kbytes): 7")]


def files_peak_memory(spark: SparkSession, d: str) -> DataFrame:
    return readers.peak_memory(spark.createDataFrame(REPORTS, "path string, text string"))


def files_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Key and value file without header, from the figures of the parts."""
    path = _folder(spark)
    table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).write.csv(path)
    return readers.read_key_values(spark, path).select("key", F.col("value").cast("long").alias("value"))


QUERIES = {f.__name__: f for f in (
    files_lines, files_stats_lines, files_csv_field, files_records, files_patterns, files_workload, files_summary, files_regex_stats, files_keys, files_dataset_stats, files_literals, files_printed_index,
    files_peak_memory, files_key_values,
)}

_LINES = "(SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"

SQL = {
    "files_keys": f"WITH {_free(_DOCS, 0.1)} SELECT replace(replace(replace(gram, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') AS gram FROM keys WHERE length(gram) <= 2",
    "files_lines": f"SELECT replace(line, chr(13), '') AS text, count(*) AS n FROM {_LINES} GROUP BY ALL",
    "files_stats_lines": f"SELECT rtrim(line, chr(13)) AS text, count(*) AS n FROM {_LINES} WHERE rtrim(line, chr(13)) <> '' GROUP BY ALL",
    "files_csv_field": "SELECT string_split(x, ',')[10] AS text, count(*) AS n FROM (SELECT replace(unnest(string_split(line, chr(10))), chr(13), '') AS x FROM result_lines WHERE line IS NOT NULL) WHERE len(string_split(x, ',')) >= 10 GROUP BY ALL",
    "files_records": f"SELECT count(*) AS n, count(*) AS n_ids FROM {_LINES} WHERE length(replace(line, chr(13), '')) >= 3",
    "files_patterns": "SELECT pattern FROM queries WHERE pattern IS NOT NULL",
    "files_workload": "SELECT (SELECT count(*) FROM part WHERE p_name IS NOT NULL) AS n_records, (SELECT count(*) FROM queries WHERE pattern IS NOT NULL) AS n_queries",
    "files_summary": "SELECT name, num_threads, gram_size, selectivity, num_keys, index_size FROM (SELECT DISTINCT * FROM summary) WHERE name IS NOT NULL AND workload IN ('mail', 'road')",
    "files_regex_stats": "SELECT regex, count(*) AS n, sum(match_count)::BIGINT AS matches, sum(num_after_filter)::BIGINT AS candidates FROM regex_stats WHERE regex IS NOT NULL GROUP BY regex",
    "files_dataset_stats": "SELECT DISTINCT stats_id, dataset_name, total_lines, alphabet_size FROM dataset_stats WHERE stats_id IS NOT NULL",
    "files_printed_index": "SELECT gram, count(*) AS df FROM (SELECT unnest(list_distinct(list_transform(list_zip(c[1:len(c) - 1], c[2:]), lambda x: x[1] || x[2]))) AS gram FROM (SELECT string_split(p_name, '') AS c FROM part WHERE length(p_name) >= 2)) GROUP BY gram",
    "files_literals": """WITH l AS (SELECT pattern, list_filter(string_split(regexp_replace(regexp_replace(pattern, '\\([^()]*\\)[*+?]?', chr(1), 'g'), '\\([^()]*\\)[*+?]?', chr(1), 'g'), chr(1)), lambda x: x <> '') AS lits FROM queries)
 SELECT pattern AS regex, len(lits)::INT AS num_literals FROM l, range(0, 2)""",
    "files_peak_memory": "SELECT * FROM (VALUES ('a', 123456), ('c', 7)) AS v(path, max_resident_kb)",
    "files_key_values": "SELECT p_type AS key, count(*) AS value FROM part GROUP BY p_type",
}
