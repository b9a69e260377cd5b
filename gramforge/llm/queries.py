"""Queries of the operators for training text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.llm import frequent, leaks, packing, quantiles, readability, term_counts
from gramforge.plans.cut import written
from gramforge.sources.tables import table


# -- problem 2: percentiles -------------------------------------------------------------------------------------


def _filter_sketch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "regex_stats").select("stat_id", "run_name", "num_after_filter").filter("num_after_filter >= 0").distinct()
    return quantiles.sketch(rows, "num_after_filter", F.col("run_name"), F.col("num_after_filter"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset_stats").select("stats_id", "dataset_name", "line_lengths").dropDuplicates(["stats_id"])
    return rows.select("dataset_name", F.explode("line_lengths").alias("v"))


def _length_sketch(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.sketch(_lengths(spark, d), "line_lengths", F.col("dataset_name"), F.col("v"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_filter_sketch(spark, d).unionByName(_length_sketch(spark, d)), [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = quantiles.percentiles(_filter_sketch(spark, d).unionByName(_length_sketch(spark, d)), [0.5, 0.95])
    wide = found.groupBy("field_name", "group_key").agg(F.max(F.expr("case when probability = 0.5 then value end")).alias("median"), F.max(F.expr("case when probability = 0.95 then value end")).alias("p95"))
    return wide.filter("group_key is not null and p95 >= 20 * median").select("field_name", "group_key")


def p2_percentiles_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile is within its stated error of the exact ranks."""
    rows = table(spark, d, "regex_stats").select("stat_id", "run_name", "num_after_filter").filter("num_after_filter >= 0").distinct()
    exact = rows.select(F.lit("num_after_filter").alias("field_name"), F.col("run_name").alias("group_key"), F.col("num_after_filter").alias("value"))
    exact = exact.unionByName(_lengths(spark, d).select(F.lit("line_lengths").alias("field_name"), F.col("dataset_name").alias("group_key"), F.col("v").alias("value")))
    return quantiles.within_error(p2_percentiles(spark, d), exact)


def p2_without_last_month(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single months are kept, merged, and the last month is deleted again; the counts and errors are those of what is left."""
    rows = table(spark, d, "regex_stats").select("stat_id", "run_name", "num_after_filter", F.date_format("recorded_at", "yyyy-MM").alias("month")).filter("num_after_filter >= 0 and month is not null").distinct()
    last = rows.agg(F.max("month")).first()[0]
    months = written(quantiles.sketch(rows, "num_after_filter", F.concat_ws("|", "month", "run_name"), F.col("num_after_filter")).filter("group_key is not null"))
    named = months.select("field_name", F.regexp_extract("group_key", r"^[^|]*\|(.*)$", 1).alias("group_key"), F.substring("group_key", 1, 7).alias("month"), "cell", "n")
    deleted = quantiles.sketch(rows.filter(F.col("month") == last), "num_after_filter", F.col("run_name"), F.col("num_after_filter"), F.lit(-1))
    left = quantiles.merged(named.filter("group_key <> ''").drop("month"), deleted.filter("group_key is not null"))
    kept = rows.filter(F.col("month") < last).select(F.lit("num_after_filter").alias("field_name"), F.col("run_name").alias("group_key"), F.col("num_after_filter").alias("value"))
    found = quantiles.percentiles(left, [0.5, 0.95])
    return quantiles.within_error(found, kept).join(found.select("field_name", "group_key", "probability", "n"), ["field_name", "group_key", "probability"])


# -- problem 3: most frequent items -----------------------------------------------------------------------------


def _ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").select("node_id", "ngram").filter("ngram is not null").distinct()


def _chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_stats").select("stats_id", "char_frequency").dropDuplicates(["stats_id"]).select(F.explode("char_frequency").alias("char", "n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ngrams = frequent.frequent(_ngrams(spark, d), F.col("ngram"), None, 200)
    chars = frequent.frequent(_chars(spark, d), F.col("char"), F.col("n"), 60)
    return ngrams.select(F.lit("ngram").alias("field_name"), "item").unionByName(chars.select(F.lit("char").alias("field_name"), "item"))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    ngrams = frequent.top(_ngrams(spark, d), F.col("ngram"), None, 100)
    chars = frequent.top(_chars(spark, d), F.col("char"), F.col("n"), 100)
    return ngrams.select(F.lit("ngram").alias("field_name"), "item", "n").unionByName(chars.select(F.lit("char").alias("field_name"), "item", "n"))


# -- problem 5: frequency of every term -------------------------------------------------------------------------


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = term_counts.term_counts(table(spark, d, "graph_nodes"), F.col("ngram"), F.col("document_ids"))
    return term_counts.marked(counts, table(spark, d, "documents").count()).withColumnRenamed("term", "ngram")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).filter("df_mark is not null").select("ngram", "df_mark")


# -- problem 6: packing -----------------------------------------------------------------------------------------


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), F.col("doc_id"), packing.text_size(F.col("text")), table(spark, d, "pack_sizes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter("n_pieces > 1 and piece_no = 0").select("capacity_id", F.col("item_id").alias("doc_id"))


def p6_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).groupBy("capacity_id", "bin_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_size").alias("used"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).groupBy("capacity_id").agg(F.count_distinct("item_id").alias("n_docs"), F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_size").alias("n_tokens"))


# -- problem 7: leaked evaluation texts -------------------------------------------------------------------------


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("item_id", "doc_id").distinct()


# -- problem 8: reading level -----------------------------------------------------------------------------------


def _levels(spark: SparkSession, d: str, carry: str | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    return readability.reading_levels(docs, readability.fit_limits(docs, table(spark, d, "reading_labels")), carry)


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("is_prose").select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("regexp_extract(source, '^[a-z]+', 0)").alias("kind")
    return _levels(spark, d, "source").groupBy(kind, "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("grade").alias("avg_grade"))


QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_percentiles_hold, p2_without_last_month, p3_found, p3_top, p5_found, p5_terms, p6_found, p6_bins, p6_totals, p7_found, p7_leaks, p8_found, p8_levels, p8_profile)}

_COUNTS = """WITH tokens AS (SELECT ngram, unnest(document_ids) AS id FROM graph_nodes WHERE ngram IS NOT NULL),
 found AS (SELECT ngram, count(*) AS occurrences, count(DISTINCT id) AS n_records FROM tokens WHERE id >= 0 GROUP BY ngram),
 terms AS (SELECT g.ngram, coalesce(f.occurrences, 0)::BIGINT AS occurrences, coalesce(f.n_records, 0)::BIGINT AS n_records
           FROM (SELECT DISTINCT ngram FROM graph_nodes WHERE ngram IS NOT NULL) g LEFT JOIN found f ON f.ngram = g.ngram),
 marked AS (SELECT *, n_records::DOUBLE / (SELECT count(*) FROM documents) AS selectivity,
            CASE WHEN n_records BETWEEN 1 AND 2 THEN 'rare' WHEN n_records * 10 > (SELECT count(*) FROM documents) THEN 'common' END AS df_mark FROM terms)"""

_VALUES = """v AS (SELECT 'num_after_filter' AS field_name, run_name AS group_key, num_after_filter AS x FROM (SELECT DISTINCT stat_id, run_name, num_after_filter FROM regex_stats)
 UNION ALL SELECT 'line_lengths', dataset_name, unnest(line_lengths) FROM (SELECT DISTINCT stats_id, dataset_name, line_lengths FROM dataset_stats))"""

SQL = {
    "p2_percentiles_hold": f"WITH {_VALUES} SELECT DISTINCT field_name, group_key, probability, true AS within FROM v, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) AS p(probability) WHERE x >= 0 AND group_key IS NOT NULL",
    "p2_without_last_month": """WITH v AS (SELECT DISTINCT stat_id, run_name, num_after_filter, strftime(recorded_at, '%Y-%m') AS month FROM regex_stats WHERE num_after_filter >= 0 AND recorded_at IS NOT NULL AND run_name IS NOT NULL)
 SELECT 'num_after_filter' AS field_name, run_name AS group_key, probability, true AS within, count(*) AS n FROM v, (VALUES (0.5), (0.95)) AS p(probability) WHERE month < (SELECT max(month) FROM v) GROUP BY ALL""",
    "p3_top": """WITH g AS (SELECT ngram AS item, count(*) AS n FROM (SELECT DISTINCT node_id, ngram FROM graph_nodes WHERE ngram IS NOT NULL) GROUP BY 1), s AS (SELECT stats_id, any_value(char_frequency) AS m FROM dataset_stats GROUP BY stats_id),
 e AS (SELECT unnest(map_entries(m)) AS kv FROM s), c AS (SELECT kv.key AS item, sum(kv.value)::BIGINT AS n FROM e WHERE kv.value > 0 GROUP BY 1)
 (SELECT 'ngram' AS field_name, item, n FROM g ORDER BY n DESC, item LIMIT 100) UNION ALL (SELECT 'char', item, n FROM c ORDER BY n DESC, item LIMIT 100)""",
    "p2_found": """WITH v AS (SELECT 'num_after_filter' AS field_name, run_name AS group_key, num_after_filter AS x FROM (SELECT DISTINCT stat_id, run_name, num_after_filter FROM regex_stats)
 UNION ALL SELECT 'line_lengths', dataset_name, unnest(line_lengths) FROM (SELECT DISTINCT stats_id, dataset_name, line_lengths FROM dataset_stats))
 SELECT field_name, group_key FROM v WHERE x >= 0 AND group_key IS NOT NULL GROUP BY ALL HAVING quantile_disc(x, 0.95) >= 20 * quantile_disc(x, 0.5)""",
    "p3_found": """WITH g AS (SELECT DISTINCT node_id, ngram FROM graph_nodes WHERE ngram IS NOT NULL),
 s AS (SELECT stats_id, any_value(char_frequency) AS m FROM dataset_stats GROUP BY stats_id),
 e AS (SELECT unnest(map_entries(m)) AS kv FROM s), c AS (SELECT kv.key AS item, sum(kv.value) AS n FROM e GROUP BY 1)
 SELECT 'ngram' AS field_name, ngram AS item FROM g GROUP BY ngram HAVING count(*) * 200 >= (SELECT count(*) FROM g)
 UNION ALL SELECT 'char', item FROM c WHERE n * 60 >= (SELECT sum(n) FROM c)""",
    "p5_terms": _COUNTS + " SELECT ngram, occurrences, n_records, selectivity, df_mark FROM marked",
    "p5_found": _COUNTS + " SELECT ngram, df_mark FROM marked WHERE df_mark IS NOT NULL",
    "p6_found": "SELECT capacity_id, doc_id FROM documents CROSS JOIN pack_sizes WHERE octet_length(encode(text)) + 1 > capacity",
    "p6_totals": """WITH s AS (SELECT capacity_id, capacity, doc_id, octet_length(encode(text)) + 1 AS n FROM documents CROSS JOIN pack_sizes WHERE text IS NOT NULL)
 SELECT capacity_id, count(DISTINCT doc_id) AS n_docs, sum((n + capacity - 1) // capacity)::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens FROM s GROUP BY capacity_id""",
}
