"""Queries of the corpus and result analytics and of the generators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions import grams
from gramforge.operators import corpus_stats, results
from gramforge.operators.match import scan_counts
from gramforge.operators.selectors.trigram import sample
from gramforge.sources import generators, readers
from gramforge.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return grams.corpus(table(spark, d, "documents"), "doc_id", "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return grams.lines(_docs(spark, d))


# -- corpus -----------------------------------------------------------------------------------------------------


def corpus_stats_documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.length_stats(_docs(spark, d))


def corpus_stats_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.length_stats(_lines(spark, d).filter("text <> ''"))


def corpus_spread(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.spread_stats(_docs(spark, d)).select(*(F.round(c, 4).alias(c) for c in ("mean", "std", "median")))


def corpus_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.alphabet_size(_docs(spark, d))


def corpus_top_chars(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.top_chars(_docs(spark, d))


def corpus_average(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.average_and_alphabet(_lines(spark, d), 3).withColumn("avg_length", F.round("avg_length", 6))


def trigram_extremes(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.extremes(corpus_stats.trigram_records(_docs(spark, d)), "df", "gram")


def _literals(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.literal_rows(table(spark, d, "queries"), mode="compat")


def literal_rows(spark: SparkSession, d: str) -> DataFrame:
    return _literals(spark, d).withColumn("literals", F.concat_ws(";", "literals"))


def literal_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.literal_summary(_literals(spark, d))


def literal_histograms(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats.literal_histograms(_literals(spark, d))


# -- results ----------------------------------------------------------------------------------------------------

_CONFIG = ["name", "num_threads", "gram_size", "selectivity", "key_upper_bound", "num_queries", "selection_time", "build_time", "overall_index_time", "num_keys", "index_size"]


def _filled(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "summary").drop("overall_time").distinct()
    return results.with_times(results.filled(runs, ["run_id"], ["repeat_no", "run_at"], _CONFIG))


def summary_filled(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("run_id", "repeat_no", "name", "num_keys", "index_size", F.round("overall_match_time", 9).alias("overall_match_time"), F.round("overall_time", 9).alias("overall_time"))


def summary_trimmed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with four rows or more, fastest and slowest taken off."""
    many = _filled(spark, d).join(_filled(spark, d).groupBy("run_id").count().filter("count > 2").select("run_id"), "run_id")
    return results.without_extreme_runs(many, ["run_id"], "overall_time", ["repeat_no"]).select("run_id", "repeat_no")


def summary_minimum(spark: SparkSession, d: str) -> DataFrame:
    return results.group_minimum(_filled(spark, d), ["workload", "name"], ["num_keys", "index_size", "overall_match_time"])


def summary_mean(spark: SparkSession, d: str) -> DataFrame:
    found = results.group_mean(_filled(spark, d), ["workload", "name"], ["num_keys", "match_time"])
    return found.select("workload", "name", *(F.round(c, 6).alias(c) for c in ("num_keys", "match_time")))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).filter("name is not null").withColumn("method", results.method_of(F.col("name")))


def method_summary(spark: SparkSession, d: str) -> DataFrame:
    found = results.group_summary(_methods(spark, d), "method", ["overall_index_time", "match_time"])
    return found.select("method", *(F.round(c, 5).alias(c) for c in found.columns if c != "method"))


def best_methods(spark: SparkSession, d: str) -> DataFrame:
    return results.best_groups(_methods(spark, d), "method", ["num_keys"], ["overall_index_time", "match_time", "build_time"]).withColumn("value", F.round("value", 5))


def trimmed_match_time(spark: SparkSession, d: str) -> DataFrame:
    found = results.trimmed_mean(_filled(spark, d), ["run_id"], "match_time")
    return found.select("run_id", "n", F.round("mean", 6).alias("mean"), F.round("trimmed_mean", 6).alias("trimmed_mean"))


def smallest_gram_size(spark: SparkSession, d: str) -> DataFrame:
    return results.first_of_group(_methods(spark, d), ["workload", "method"], ["gram_size", "run_id", "repeat_no"]).select("workload", "method", "run_id", "gram_size")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regex_stats").filter("match_count >= 0 and num_after_filter >= 0").dropDuplicates(["stat_id"])


def _joined(spark: SparkSession, d: str) -> DataFrame:
    first = _filled(spark, d).filter("repeat_no = 0").dropDuplicates(["run_id"])
    return results.joined_stats(first, _stats(spark, d), ["run_id"])


def runs_with_precision(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("run_id", "sum_matches", "sum_after_filter", F.round("precision", 9).alias("precision"))


def best_within_limits(spark: SparkSession, d: str) -> DataFrame:
    runs = _joined(spark, d).filter("name is not null and precision is not null").withColumn("method", results.method_of(F.col("name")))
    return results.best_within_limits(runs, [150, 500, 1000, 2000, 5000], "method", "num_keys", [F.desc("precision"), "overall_time", "run_id"]).select("key_limit", "method", "run_id")


def best_cells(spark: SparkSession, d: str) -> DataFrame:
    runs = _joined(spark, d).filter("precision is not null").select("run_id", "workload", "index_size", "precision")
    return results.marked_best(runs, ["workload"], ["index_size"], ["precision"]).filter("index_size_best or precision_best").select("run_id", "index_size_best", "precision_best")


def key_differences(spark: SparkSession, d: str) -> DataFrame:
    sizes = _methods(spark, d).select("method", "num_keys").distinct()
    found = results.differences(sizes, ["method"], ["num_keys"], "num_keys")
    return found.withColumn("relative_difference", F.round("relative_difference", 6))


def key_histogram(spark: SparkSession, d: str) -> DataFrame:
    return results.equal_width_histogram(_filled(spark, d).filter("num_keys >= 0"), "num_keys", 10).select("bin", "n")


def key_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return results.equal_width_histogram(_filled(spark, d).filter("num_keys >= 0"), "num_keys", 10, logarithmic=True).select("bin", "n")


def key_equal_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.equal_count_edges(_filled(spark, d).filter("num_keys >= 0"), "num_keys", 20).withColumn("edge", F.round("edge", 6))


def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per match of each pattern's rows, as an error in proportion to the matches."""
    return _stats(spark, d).select("stat_id", F.round(results.relative_error(F.col("num_after_filter"), F.col("match_count")), 6).alias("prop_error"), F.round(results.precision(F.col("match_count"), F.col("num_after_filter"), zero_as_one=True), 9).alias("precision"))


def pattern_selectivities(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return results.selectivities(scan_counts(docs, ["Subject: ", "the (.*)of", "[0-9]{4}"]), docs.count()).select("pattern", F.round("selectivity", 9).alias("selectivity"))


def results_concatenated(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "summary").distinct()
    a, b = runs.filter("workload = 'mail'").select("run_id", "repeat_no", "match_time"), runs.filter("workload = 'road'").select("run_id", "repeat_no", "num_keys")
    return results.concatenated(a, b)


# Folder names of runs.
FOLDERS = ["synthetic2_1000_50_0.1_FREE_presuf_x", "synthetic2_1000_50_0.1_BEST", "synthetic2_10_q_0.1_FREE_a", "other_1_2_0.3_FREE", "synthetic_1_2", "synthetic3_5000_200_0.05_LPMS_d"]


def parsed_configs(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in FOLDERS], "name string")
    return names.select(results.parsed_config(F.col("name")).alias("c")).filter("c is not null").select("c.*")


def run_names_filtered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regex_stats").filter(F.col("run_name").contains("presuf") & (F.col("num_after_filter") <= 1000) & F.col("time_s").between(0.001, 0.01)).groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))


# -- other corpora and generators -------------------------------------------------------------------------------


def csv_field(spark: SparkSession, d: str) -> DataFrame:
    """The tenth field of the exported lines, as the plain reader parts them."""
    return table(spark, d, "result_lines").filter("line is not null").select("file_id", "line_no", F.get(F.split("line", ","), F.lit(9)).alias("field")).filter("field is not null").distinct()


def _publications(spark: SparkSession, d: str) -> DataFrame:
    return readers.publications(_docs(spark, d).filter(F.col("text").contains("#*")))


def publications(spark: SparkSession, d: str) -> DataFrame:
    return _publications(spark, d).select("rec_id", "title", "authors")


def name_queries(spark: SparkSession, d: str) -> DataFrame:
    return readers.name_queries(readers.last_names(_publications(spark, d))).distinct()


def name_query_sample(spark: SparkSession, d: str) -> DataFrame:
    return readers.name_queries(readers.last_names(_publications(spark, d)).distinct(), 20, seed=3)


def web_page_sample(spark: SparkSession, d: str) -> DataFrame:
    pages = _docs(spark, d).withColumn("content_type", F.when(F.col("text").contains("<"), "text/html").otherwise("text/plain"))
    return readers.web_pages(pages, ["<p>(.*)the", "href="], share=0.1, most_per_pattern=50).select("rec_id", "pattern_no")


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return readers.distinct_sequences(_docs(spark, d)).select(F.length("text").cast("long").alias("n_chars")).groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))


def document_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample(_docs(spark, d).select("rec_id"), ["rec_id"], 100, seed=1)


def synthetic_fixed(spark: SparkSession, d: str) -> DataFrame:
    return generators.fixed_length_strings(spark, 200)


def synthetic_geometric(spark: SparkSession, d: str) -> DataFrame:
    return generators.geometric_strings(spark, 200, 8)


def synthetic_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return generators.trigram_strings(spark, 200)


def synthetic_gap_queries(spark: SparkSession, d: str) -> DataFrame:
    strings = generators.geometric_strings(spark, 200, 8)
    both = generators.gap_queries(strings, 20, 2) + generators.gap_queries(strings, 20, 3) + generators.key_queries(20)
    return spark.createDataFrame([(p,) for p in both], "pattern string")


def synthetic_selectivity_queries(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = generators.generate(spark, "small", 4, 1000, 5, 0.2)
    return queries


def synthetic_configurations(spark: SparkSession, d: str) -> DataFrame:
    return generators.configurations(spark, "small")


QUERIES = {f.__name__: f for f in (
    corpus_stats_documents, corpus_stats_lines, corpus_spread, corpus_alphabet, corpus_top_chars, corpus_average, trigram_extremes, literal_rows, literal_summary, literal_histograms, summary_filled,
    summary_trimmed_runs, summary_minimum, summary_mean, method_summary, best_methods, trimmed_match_time, smallest_gram_size, runs_with_precision, best_within_limits, best_cells, key_differences, key_histogram,
    key_log_histogram, key_equal_counts, prediction_errors, pattern_selectivities, results_concatenated, parsed_configs, run_names_filtered, csv_field, publications, name_queries, name_query_sample,
    web_page_sample, distinct_texts, document_sample, synthetic_fixed, synthetic_geometric, synthetic_trigrams, synthetic_gap_queries, synthetic_selectivity_queries, synthetic_configurations,
)}

# -- SQL --------------------------------------------------------------------------------------------------------

_D = "(SELECT doc_id AS rec_id, text FROM documents WHERE text IS NOT NULL)"
_L = "(SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS text FROM documents WHERE text IS NOT NULL)"
_CHARS = f"(SELECT unnest(string_split(text, '')) AS char FROM {_D} WHERE text <> '')"


def _length_stats(corpus: str) -> str:
    at = lambda p, q: f"max(len) FILTER (i = n * {p} // {q})"
    return f"""WITH o AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM {corpus})
 SELECT count(*) AS total_lines, sum(len)::BIGINT AS total_characters, avg(len) AS avg_line_length, min(len) AS min_line_length, max(len) AS max_line_length, {at(1, 2)} AS median_line_length,
 {at(25, 100)} AS p25, {at(75, 100)} AS p75, {at(90, 100)} AS p90, {at(95, 100)} AS p95 FROM o"""


_FILL = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, -1) AS {c}" for c in _CONFIG if c != "name")
_FILLED = f"""f AS (SELECT *, compile_time + match_time AS overall_match_time, overall_index_time + compile_time + match_time AS overall_time FROM (
 SELECT run_id, repeat_no, run_at, workload, compile_time, match_time, last_value(name IGNORE NULLS) OVER w AS name, {_FILL} FROM (SELECT DISTINCT * EXCLUDE (overall_time) FROM summary) WINDOW w AS (PARTITION BY run_id ORDER BY repeat_no, run_at ROWS UNBOUNDED PRECEDING)))"""
_METHODS = _FILLED + ", m AS (SELECT *, split_part(name, '-', 1) AS method FROM f WHERE name IS NOT NULL)"
_STATS = "s AS (SELECT stat_id, any_value(run_id) AS run_id, any_value(match_count) AS match_count, any_value(num_after_filter) AS num_after_filter FROM regex_stats WHERE match_count >= 0 AND num_after_filter >= 0 GROUP BY stat_id)"
_JOINED = (
    _FILLED
    + f""", {_STATS}, z AS (SELECT run_id, sum(match_count)::BIGINT AS sum_matches, sum(num_after_filter)::BIGINT AS sum_after_filter FROM s GROUP BY run_id),
 j AS (SELECT f.*, sum_matches, sum_after_filter, sum_matches::DOUBLE / nullif(sum_after_filter, 0) AS precision FROM (SELECT DISTINCT ON (run_id) * FROM f WHERE repeat_no = 0) f LEFT JOIN z USING (run_id))"""
)
_LIT = """l AS (SELECT pattern AS regex, list_filter(string_split(regexp_replace(regexp_replace(pattern, '\\([^()]*\\)[*+?]?', chr(1), 'g'), '\\([^()]*\\)[*+?]?', chr(1), 'g'), chr(1)), lambda x: x <> '') AS lits FROM queries),
 r AS (SELECT regex, len(lits) AS num_literals, length(array_to_string(lits, '')) AS total_literal_chars, lits FROM l)"""
_PUBS = """t AS (SELECT rec_id, string_split(text, chr(10)) AS ls FROM (SELECT doc_id AS rec_id, replace(text, chr(13), '') AS text FROM documents WHERE contains(text, '#*'))), u AS (SELECT rec_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM t),
 v AS (SELECT rec_id, i, ls[i] AS line FROM u), k AS (SELECT rec_id, i, line, lead(line) OVER (PARTITION BY rec_id ORDER BY i) AS next FROM v WHERE starts_with(line, '#*') OR starts_with(line, '#@')),
 p AS (SELECT rec_id, line[3:] AS title, next[3:] AS authors FROM k WHERE starts_with(line, '#*') AND starts_with(next, '#@') AND trim(next[3:]) <> '')"""


def _histogram(x: str) -> str:
    return f"""WITH {_FILLED}, x AS (SELECT {x} AS x FROM f WHERE num_keys >= 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), b AS (SELECT least(floor((x - lo) / ((hi - lo) / 10)), 9)::INT AS bin FROM x, e)
 SELECT r.bin::INT AS bin, count(b.bin) AS n FROM range(0, 10) AS r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin"""


def _summary_columns(*names: str) -> str:
    return ", ".join(f"round({f}({c}), 5) AS {c}_{n}" for c in names for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


SQL = {
    "corpus_stats_documents": _length_stats(_D), "corpus_stats_lines": _length_stats(f"(SELECT text FROM {_L} WHERE text <> '')"),
    "corpus_spread": f"SELECT round(avg(length(text)), 4) AS mean, round(stddev_pop(length(text)), 4) AS std, round(quantile_cont(length(text), 0.5), 4) AS median FROM {_D}",
    "corpus_alphabet": f"SELECT count(DISTINCT char) AS alphabet_size FROM {_CHARS}",
    "corpus_top_chars": f"SELECT char, count(*) AS n FROM {_CHARS} GROUP BY char ORDER BY n DESC, char LIMIT 10",
    "corpus_average": f"WITH t AS (SELECT regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+$', '') AS x FROM {_L}), u AS (SELECT x FROM t WHERE length(x) >= 3) SELECT count(*) AS n, round(avg(length(x)), 6) AS avg_length, (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(x, '')) AS c FROM u)) AS alphabet_size FROM u",
    "trigram_extremes": f"""WITH g AS (SELECT gram, count(*) AS df FROM (SELECT rec_id, unnest(list_distinct(list_transform(list_zip(c[1:len(c) - 2], c[2:len(c) - 1], c[3:]), lambda x: x[1] || x[2] || x[3]))) AS gram FROM (SELECT rec_id, string_split(text, '') AS c FROM {_D} WHERE length(text) >= 3)) GROUP BY gram)
 (SELECT *, 'top' AS "end" FROM g ORDER BY df DESC, gram LIMIT 10) UNION ALL (SELECT *, 'bottom' FROM g ORDER BY df, gram LIMIT 10)""",
    "literal_rows": f"WITH {_LIT} SELECT regex, num_literals, total_literal_chars, coalesce(total_literal_chars / nullif(num_literals, 0), 0) AS avg_literal_length, array_to_string(lits, ';') AS literals FROM r",
    "literal_summary": f"WITH {_LIT} SELECT count(*) AS total_regexes, sum(num_literals)::BIGINT AS total_literals, sum(total_literal_chars)::BIGINT AS total_literal_chars, sum(num_literals) / count(*) AS avg_literals_per_regex, sum(total_literal_chars) / count(*) AS avg_literal_chars_per_regex, sum(total_literal_chars) / sum(num_literals) AS avg_literal_length FROM r",
    "literal_histograms": f"WITH {_LIT} SELECT 'literals' AS kind, num_literals::INT AS bin, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'chars', (total_literal_chars // 10 * 10)::INT, count(*) FROM r GROUP BY ALL",
    "summary_filled": f"WITH {_FILLED} SELECT run_id, repeat_no, name, num_keys, index_size, round(overall_match_time, 9) AS overall_match_time, round(overall_index_time + overall_match_time, 9) AS overall_time FROM f",
    "summary_trimmed_runs": f"""WITH {_FILLED}, o AS (SELECT run_id, repeat_no, row_number() OVER (PARTITION BY run_id ORDER BY overall_index_time + overall_match_time, repeat_no) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM f) SELECT run_id, repeat_no FROM o WHERE n > 2 AND p > 1 AND p < n""",
    "summary_minimum": f"WITH {_FILLED} SELECT workload, name, min(num_keys) AS num_keys, min(index_size) AS index_size, min(overall_match_time) AS overall_match_time FROM f GROUP BY ALL",
    "summary_mean": f"WITH {_FILLED} SELECT workload, name, round(avg(num_keys), 6) AS num_keys, round(avg(match_time), 6) AS match_time FROM f GROUP BY ALL",
    "method_summary": f"WITH {_METHODS} SELECT method, {_summary_columns('overall_index_time', 'match_time')} FROM m GROUP BY method",
    "best_methods": f"""WITH {_METHODS}, a AS (SELECT method, avg(num_keys) AS k, avg(overall_index_time) FILTER (overall_index_time > 0) AS o, avg(match_time) FILTER (match_time > 0) AS t, avg(build_time) FILTER (build_time > 0) AS b FROM m GROUP BY method)
 SELECT 'num_keys' AS metric, arg_max(method, k) AS best, round(max(k), 5) AS value FROM a UNION ALL SELECT 'overall_index_time', arg_min(method, o), round(min(o), 5) FROM a UNION ALL SELECT 'match_time', arg_min(method, t), round(min(t), 5) FROM a UNION ALL SELECT 'build_time', arg_min(method, b), round(min(b), 5) FROM a""",
    "trimmed_match_time": f"WITH {_FILLED} SELECT run_id, count(match_time) AS n, round(avg(match_time), 6) AS mean, round(CASE WHEN count(match_time) > 3 THEN (sum(match_time) - min(match_time) - max(match_time)) / (count(match_time) - 2) ELSE avg(match_time) END, 6) AS trimmed_mean FROM f GROUP BY run_id",
    "smallest_gram_size": f"WITH {_METHODS} SELECT workload, method, run_id, gram_size FROM m QUALIFY row_number() OVER (PARTITION BY workload, method ORDER BY gram_size, run_id, repeat_no) = 1",
    "runs_with_precision": f"WITH {_JOINED} SELECT run_id, sum_matches, sum_after_filter, round(precision, 9) AS precision FROM j",
    "best_within_limits": f"WITH {_JOINED} SELECT key_limit, split_part(name, '-', 1) AS method, run_id FROM j, (VALUES (150), (500), (1000), (2000), (5000)) AS v(key_limit) WHERE num_keys <= key_limit AND name IS NOT NULL AND precision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key_limit, split_part(name, '-', 1) ORDER BY precision DESC, overall_index_time + overall_match_time, run_id) = 1",
    "best_cells": f"WITH {_JOINED}, b AS (SELECT run_id, index_size = min(index_size) OVER (PARTITION BY workload) AS index_size_best, precision = max(precision) OVER (PARTITION BY workload) AS precision_best FROM j WHERE precision IS NOT NULL) SELECT * FROM b WHERE index_size_best OR precision_best",
    "key_differences": f"WITH {_METHODS}, k AS (SELECT DISTINCT method, num_keys FROM m), x AS (SELECT *, lead(num_keys) OVER (PARTITION BY method ORDER BY num_keys) - num_keys AS difference FROM k) SELECT *, round(difference::DOUBLE / nullif(num_keys, 0), 6) AS relative_difference FROM x WHERE difference IS NOT NULL",
    "key_histogram": _histogram("num_keys::DOUBLE"), "key_log_histogram": _histogram("log10(num_keys + 1)"),
    "key_equal_counts": f"""WITH {_FILLED}, x AS (SELECT num_keys::DOUBLE AS v, row_number() OVER (ORDER BY num_keys) - 1 AS i, count(*) OVER () AS n FROM f WHERE num_keys >= 0), p AS (SELECT e AS edge_no, least(e * n / 20.0, n - 1) AS place, n FROM range(0, 21) AS r(e), (SELECT max(n) AS n FROM x))
 SELECT edge_no::INT AS edge_no, round(a.v + (b.v - a.v) * (place - floor(place)), 6) AS edge FROM p JOIN x a ON a.i = floor(place) JOIN x b ON b.i = least(floor(place) + 1, p.n - 1)""",
    "prediction_errors": f"WITH {_STATS} SELECT stat_id, round(abs(num_after_filter - match_count)::DOUBLE / nullif(match_count, 0), 6) AS prop_error, round(match_count::DOUBLE / CASE WHEN num_after_filter = 0 THEN 1 ELSE num_after_filter END, 9) AS precision FROM s",
    "pattern_selectivities": f"SELECT pattern, round(count(*) FILTER (regexp_matches(text, pattern))::DOUBLE / count(*), 9) AS selectivity FROM {_D} CROSS JOIN (VALUES ('Subject: '), ('the (.*)of'), ('[0-9]{{4}}')) AS q(pattern) GROUP BY pattern",
    "results_concatenated": "SELECT run_id, repeat_no, match_time, NULL::BIGINT AS num_keys FROM (SELECT DISTINCT * FROM summary) WHERE workload = 'mail' UNION ALL SELECT run_id, repeat_no, NULL, num_keys FROM (SELECT DISTINCT * FROM summary) WHERE workload = 'road'",
    "parsed_configs": "WITH n AS (SELECT name, string_split(name, '_') AS p FROM (VALUES " + ", ".join(f"('{x}')" for x in FOLDERS) + ") AS v(name)) SELECT try_cast(p[2] AS INT) AS dataset_size, try_cast(p[3] AS INT) AS query_size, try_cast(p[4] AS DOUBLE) AS selectivity, p[5] AS method_name, array_to_string(p[6:], '_') AS suffix, name AS folder_name FROM n WHERE starts_with(name, 'synthetic') AND len(p) >= 5 AND try_cast(p[2] AS INT) IS NOT NULL AND try_cast(p[3] AS INT) IS NOT NULL AND try_cast(p[4] AS DOUBLE) IS NOT NULL",
    "run_names_filtered": "SELECT run_name, count(*) AS n FROM regex_stats WHERE contains(run_name, 'presuf') AND num_after_filter <= 1000 AND time_s BETWEEN 0.001 AND 0.01 GROUP BY run_name",
    "csv_field": "SELECT DISTINCT file_id, line_no, string_split(line, ',')[10] AS field FROM result_lines WHERE len(string_split(line, ',')) >= 10",
    "publications": f"WITH {_PUBS} SELECT rec_id, title, authors FROM p",
    "name_queries": f"WITH {_PUBS}, n AS (SELECT unnest(string_split(authors, ',')) AS name FROM p) SELECT DISTINCT '([^,]+) ' || string_split(name, ' ')[-1] AS pattern FROM n",
    "distinct_texts": "SELECT n_chars, count(*) AS n FROM (SELECT DISTINCT text, length(text) AS n_chars FROM documents WHERE text <> '') GROUP BY n_chars",
    "synthetic_configurations": "SELECT a::INT AS alphabet_size, d::INT AS dataset_size, q::INT AS query_set_size, s::DOUBLE AS target_selectivity, 'a' || a || '_d' || d || '_q' || q || '_s' || s AS identifier FROM (VALUES (4), (8), (16)) AS x(a), (VALUES (1000), (5000), (10000)) AS y(d), (VALUES (50), (100), (200)) AS z(q), (VALUES ('0.01'), ('0.05'), ('0.1'), ('0.2')) AS w(s)",
}
