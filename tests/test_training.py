"""The general operators for training data: heavy keys and drifting schemas, against brute force and by their edge cases."""

import random

from gramforge.operators import heavy_keys, schema_drift


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- heavy keys -------------------------------------------------------------------------------------------------


def test_per_key_against_brute_force(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None, rng.randint(0, 500)]), 0, 0) for _ in range(3000)]
    df = spark.createDataFrame(data, "key string, secondary long, occurrences int, n int")
    truth = {}
    for k, s, *_ in data:
        truth.setdefault(k, []).append(s)
    want = sorted(((k, len(v), len({x for x in v if x is not None}), min(x for x in v if x is not None), max(x for x in v if x is not None)) for k, v in truth.items()), key=str)
    assert rows(heavy_keys.per_key(df, "key", "secondary", 5)) == want
    assert [r.key for r in heavy_keys.dominant_keys(df, "key", "secondary", 3).collect()] == ["hot"]


def test_heavy_keys_on_empty_and_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 40 + [("a", None)], "k string, s long")
    assert rows(heavy_keys.per_key(df, "k", "s")) == [("a", 41, 1, 1, 1)]
    assert rows(heavy_keys.per_key(df.limit(0), "k", "s")) == [] == rows(heavy_keys.dominant_keys(df.limit(0), "k", "s", 2))


# -- schema drift -----------------------------------------------------------------------------------------------

FILES = "file_id long, series string, seq int, kind string, file_format string, note string"
LINES = "file_id long, line_no int, line string"


def drift(spark, files, texts):
    f = spark.createDataFrame([(i, s, q, "stats", fmt, "x") for i, s, q, fmt in files], FILES)
    x = spark.createDataFrame([(i, n, t) for i, lines in texts.items() for n, t in enumerate(lines, 1)], LINES)
    x = x.unionAll(x.limit(3)).orderBy("line")
    known = schema_drift.catalog(f.unionAll(f.limit(1)), x)
    fields = schema_drift.schemas(known, x)
    return known, x, fields, schema_drift.changes(known, x, fields)


def kinds(change):
    return {(r.file_id, r.field_name, r.change_kind) for r in change.collect()}


def test_changes_of_every_kind(spark):
    files = [(1, "s", 1, "csv"), (2, "s", 2, "tsv"), (3, "s", 3, "jsonl"), (9, "t", 5, "csv")]
    texts = {
        1: ["cfg,overall_time,n,gone,same\r", "c1,1.50,1,x,5", "c2,2,2,y,5", "c2,,,,"],
        2: ["cfg\ttotal\tn\tnew\tsame", "c1\t1.5\t1.0\tz\t5", "c2\t2.0\t2\tw\t6", "c3\t9\t9\tw\t6"],
        3: ['{"cfg": "c1", "total": "1.5", "n": 1.0, "deep": {"er": 7}, "same": null}', '{"cfg": "c2", "total": 2, "n": 2, "same": 6}'],
        9: ["cfg,a", "c1,1"],
    }
    _, _, _, change = drift(spark, files, texts)
    assert kinds(change) == {(2, "total", "renamed"), (2, "n", "retyped"), (2, "gone", "removed"), (2, "new", "added"), (3, "total", "retyped"), (3, "new", "removed"), (3, "deep.er", "added")}
    assert {(r.old_name, r.old_type, r.new_type) for r in change.filter("change_kind = 'renamed'").collect()} == {("overall_time", None, "decimal")}


def test_long_integers_and_number_like_texts_are_told_apart(spark):
    files = [(1, "s", 1, "csv"), (2, "s", 2, "csv")]
    _, _, _, change = drift(spark, files, {1: ["cfg,a,b", "c1,9007199254740993,7d"], 2: ["cfg,x,y", "c1,9007199254740992,7f"]})
    assert kinds(change) == {(2, "a", "removed"), (2, "b", "removed"), (2, "x", "added"), (2, "y", "added")}
    _, _, _, change = drift(spark, files, {1: ["cfg,a", "c1,1000"], 2: ["cfg,x", "c1,1e3"]})
    assert kinds(change) == {(2, "x", "renamed")}


def test_everything_unread_is_reported(spark):
    files = [(1, "s", 1, "csv"), (2, "s", 2, "jsonl"), (3, "s", 3, "csv")]
    known, lines, *_ = drift(spark, files, {1: ["cfg,a", "c1,1,2,3"], 2: ["{broken", "[1]"], 7: ["stray"]})
    more = lines.unionAll(spark.createDataFrame([(1, 5, None), (3, 2, "c,1")], LINES))
    assert rows(schema_drift.rejects(known, more)) == sorted([(1, 2, "cells beyond the header", "2,3"), (1, 5, "null line", None), (2, 1, "no JSON", "{broken"), (2, 2, "no JSON object", "[1]"), (3, 2, "no header", "c,1"), (7, 1, "no such file", "stray")], key=str)


def test_versions_lineage_and_the_wide_table(spark):
    files = [(i, "s", i, "csv") for i in range(1, 5)]
    texts = {1: ["cfg,a", "c1,1"], 2: ["cfg,b", "c1,1"], 3: ["cfg,c", "c1,1", "c2,x"], 4: ["cfg,c", "c1,", "c2,5"]}
    known, lines, fields, change = drift(spark, files, texts)
    assert [r.version for r in schema_drift.versions(known, fields).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert {(r.field, r.from_seq, r.root) for r in schema_drift.lineage(known, change).collect()} == {("b", 2, "a"), ("c", 3, "a")}
    table = schema_drift.unified(known, lines, fields, change)
    assert {r.field for r in table.collect()} == {"a"} and {r.value_type for r in table.collect()} == {"text"}
    wide = schema_drift.wide(table, {"a": ("integer", "-1"), "z": ("text", "none")})
    assert {(r.file_id, r.cfg, int(r.a), r.z) for r in wide.collect()} == {(1, "c1", 1, "none"), (2, "c1", 1, "none"), (3, "c1", 1, "none"), (3, "c2", -1, "none"), (4, "c1", -1, "none"), (4, "c2", 5, "none")}


def test_large_catalogs_are_joined_by_blocks_of_lines(spark, monkeypatch):
    monkeypatch.setattr(schema_drift, "BLOCK", 50)
    files = [(1, "s", 1, "csv"), (2, "s", 2, "csv")]
    texts = {1: ["cfg,a"] + [f"c{i},{i}" for i in range(200)], 2: ["cfg,b"] + [f"c{i},{i}.0" for i in range(200)]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        known, lines, fields, change = drift(spark, files, texts)
        plan = schema_drift._located(lines, known, ["header"])._jdf.queryExecution().toString()
        assert "Broadcast" not in plan and "block" in plan and known.agg({"last_block": "max"}).first()[0] == 4
        assert kinds(change) == {(2, "b", "renamed")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark):
    f, x = spark.createDataFrame([], FILES), spark.createDataFrame([], LINES)
    known = schema_drift.catalog(f, x)
    fields = schema_drift.schemas(known, x)
    assert schema_drift.changes(known, x, fields).count() == 0 == schema_drift.versions(known, fields).count()
