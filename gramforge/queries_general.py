"""Queries of the general operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators import heavy_keys, schema_drift
from gramforge.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.dominant_keys(table(spark, d, "postings"), "gram", "rec_id", 50).select(F.col("key").alias("gram"))


def p1_gram_totals(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.per_key(table(spark, d, "postings"), "gram", "rec_id").select(F.col("key").alias("gram"), "occurrences", F.col("distinct_secondary").alias("n_records"), F.col("first_secondary").alias("first_rec"), F.col("last_secondary").alias("last_rec"))


def p1_record_totals(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.per_key(table(spark, d, "postings"), "rec_id", "gram").select(F.col("key").alias("rec_id"), "occurrences", F.col("distinct_secondary").alias("n_grams"))


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, d, "result_lines")
    known = schema_drift.catalog(table(spark, d, "result_files"), lines)
    return known, lines, schema_drift.schemas(known, lines)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(*_drift(spark, d)).select("file_id", "field_name", "change_kind")


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    known, _, fields = _drift(spark, d)
    return schema_drift.versions(known, fields)


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    known, lines, fields = _drift(spark, d)
    return schema_drift.unified(known, lines, fields, schema_drift.changes(known, lines, fields))


# The fields of the wide table with their types and defaults.
WIDE = {"name": ("text", "unknown"), "overall_time": ("decimal", None), "num_after_filter": ("integer", "-1"), "match_time": ("decimal", None), "num_keys": ("integer", None)}


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.wide(p4_unified(spark, d), WIDE)


def p4_rejects(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "result_lines")
    return schema_drift.rejects(schema_drift.catalog(table(spark, d, "result_files"), lines), lines)


QUERIES = {f.__name__: f for f in (p1_found, p1_gram_totals, p1_record_totals, p4_found, p4_versions, p4_unified, p4_wide, p4_rejects)}

# The files parsed by SQL's own functions: cells by a pattern, JSON members by its tree.
_CHANGES = r"""WITH f AS (SELECT DISTINCT file_id, series, seq, lower(file_format) AS fmt FROM result_files),
 l AS (SELECT DISTINCT file_id, line_no, rtrim(line, chr(13) || chr(10)) AS line FROM result_lines WHERE line IS NOT NULL),
 r AS (SELECT file_id, line_no, CASE WHEN fmt = 'tsv' THEN regexp_extract_all(line || chr(9), '("(?:[^"]|"")*"|[^\t]*)\t', 1) ELSE regexp_extract_all(line || ',', '("(?:[^"]|"")*"|[^,]*),', 1) END AS raw FROM l JOIN f USING (file_id) WHERE fmt <> 'jsonl'),
 u AS (SELECT file_id, line_no, list_transform(raw, lambda x: CASE WHEN x LIKE '"%"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS cells FROM r),
 h AS (SELECT file_id, min(cells) AS names FROM u WHERE line_no = 1 GROUP BY file_id),
 n AS (SELECT file_id, line_no, names, CASE WHEN line_no > 1 THEN cells ELSE [] END AS cells, unnest(range(1, len(names) + 1)) AS k FROM u JOIN h USING (file_id)),
 c1 AS (SELECT file_id, line_no, names[k] AS field, cells[k] AS value, false AS quoted, cells[list_position(names, 'cfg')] AS cfg FROM n),
 j AS (SELECT file_id, line_no, line FROM l JOIN f USING (file_id) WHERE fmt = 'jsonl' AND json_valid(line) AND json_type(line) = 'OBJECT'),
 c2 AS (SELECT file_id, line_no, replace(t.fullkey[3:], '"', '') AS field, CASE WHEN t.type <> 'NULL' THEN t.atom ->> '$' END AS value, t.type IN ('VARCHAR', 'BOOLEAN') AS quoted, line ->> '$.cfg' AS cfg FROM j, json_tree(line) AS t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND NOT contains(t.fullkey, '[')),
 c AS (SELECT file_id, line_no, field, CASE WHEN trim(value) <> '' THEN value END AS value, quoted, cfg FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) WHERE field <> 'cfg'),
 k AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN quoted THEN 3 WHEN regexp_full_match(trim(value), '[+-]?[0-9]+') THEN 1 WHEN regexp_full_match(trim(value), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 2 ELSE 3 END AS rank FROM c),
 s AS (SELECT file_id, field, max(rank) AS rank FROM k GROUP BY ALL),
 v AS (SELECT file_id, cfg, field, arg_min(value, line_no) AS value FROM k WHERE value IS NOT NULL GROUP BY ALL),
 w AS (SELECT a.file_id AS old_id, b.file_id AS new_id FROM f a JOIN f b ON a.series = b.series AND b.seq = a.seq + 1),
 o AS (SELECT new_id AS id, old_id, field, rank FROM w JOIN s ON s.file_id = old_id), e AS (SELECT new_id AS id, old_id, field, rank FROM w JOIN s ON s.file_id = new_id),
 gone AS (SELECT * FROM o ANTI JOIN e USING (id, field)), come AS (SELECT * FROM e ANTI JOIN o USING (id, field)),
 x AS (SELECT come.id, gone.field AS old_name, come.field, bool_and(coalesce(try_cast(trim(a.value) AS DOUBLE) = try_cast(trim(b.value) AS DOUBLE), a.value = b.value)) AS same
  FROM come JOIN gone ON gone.id = come.id AND gone.old_id = come.old_id JOIN v a ON a.file_id = gone.old_id AND a.field = gone.field JOIN v b ON b.file_id = come.id AND b.field = come.field AND b.cfg = a.cfg GROUP BY ALL HAVING same)
 SELECT DISTINCT id AS file_id, field AS field_name, CASE WHEN field IN (SELECT x.field FROM x WHERE x.id = come.id) THEN 'renamed' ELSE 'added' END AS change_kind FROM come
 UNION ALL SELECT DISTINCT id, field, 'removed' FROM gone WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = gone.id AND x.old_name = gone.field)
 UNION ALL SELECT DISTINCT o.id, o.field, 'retyped' FROM o JOIN e ON o.id = e.id AND o.field = e.field WHERE o.rank <> e.rank"""

SQL = {
    "p4_found": _CHANGES,
    "p1_found": "SELECT gram FROM postings WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) * 50 >= (SELECT count(*) FROM postings)",
    "p1_gram_totals": "SELECT gram, count(*) AS occurrences, count(DISTINCT rec_id) AS n_records, min(rec_id) AS first_rec, max(rec_id) AS last_rec FROM postings GROUP BY gram",
    "p1_record_totals": "SELECT rec_id, count(*) AS occurrences, count(DISTINCT gram) AS n_grams FROM postings GROUP BY rec_id",
}
