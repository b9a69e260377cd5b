"""Statistics, result analytics, readers, sinks and generators against small cases worked out by hand or by Python."""

import re
import statistics

import pytest

from gramforge.functions import grams
from gramforge.operators import corpus_stats, results
from gramforge.sources import generators, readers, sinks


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "rec_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


TEXTS = ["", "a", "bb", "ccc", "añ😀", "bb"]


def test_grams(spark):
    c = corpus(spark, ["abab", "é😀", "x", ""])
    assert rows(grams.exploded(c, [2])) == [(0, "ab"), (0, "ba"), (1, "é😀")]
    assert rows(grams.exploded(c, [2], distinct=False)) == [(0, "ab"), (0, "ab"), (0, "ba"), (1, "é😀")]
    assert len(grams.exploded(c, [1, 2]).collect()) == 2 + 2 + 2 + 1 + 1


def test_lines(spark):
    found = rows(grams.lines(corpus(spark, ["a\r\nb\n", "c"])))
    assert found == [(0, "a"), (1, "b"), (1 << 24, "c"), (2, "")]


def test_corpus_is_what_has_a_text(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6)], "id long, text string, rec_id int")
    assert rows(grams.corpus(df, "id", "text")) == [(2, "")]


def test_length_stats(spark):
    r = corpus_stats.length_stats(corpus(spark, TEXTS)).first()
    n = sorted(map(len, TEXTS))
    assert (r.total_lines, r.total_characters, r.min_line_length, r.max_line_length) == (6, sum(n), 0, 3)
    assert (r.median_line_length, r.p25, r.p75, r.p90, r.p95) == (n[3], n[6 * 25 // 100], n[6 * 75 // 100], n[6 * 90 // 100], n[6 * 95 // 100])
    empty = corpus_stats.length_stats(corpus(spark, ["a"]).limit(0)).first()
    assert (empty.total_lines, empty.total_characters, empty.avg_line_length, empty.median_line_length) == (0, 0, None, None)


def test_spread_and_alphabet(spark):
    r = corpus_stats.spread_stats(corpus(spark, TEXTS)).first()
    n = list(map(len, TEXTS))
    assert abs(r.mean - statistics.mean(n)) < 1e-9 and abs(r.std - statistics.pstdev(n)) < 1e-9 and r.median == statistics.median(n)
    assert corpus_stats.alphabet_size(corpus(spark, TEXTS)).first()[0] == len(set("".join(TEXTS)))
    assert [tuple(x) for x in corpus_stats.top_chars(corpus(spark, TEXTS), 2).collect()] == [("b", 4), ("c", 3)]
    r = corpus_stats.average_and_alphabet(corpus(spark, ["abc  ", "ab   ", "abcd\t"]), 3).first()
    assert tuple(r) == (2, 3.5, 4)


def test_literal_statistics(spark):
    queries = spark.createDataFrame([("At (.+)Exit (.+)",), ("foo|bar",), (None,), ("ab*",)], "pattern string")
    found = corpus_stats.literal_rows(queries)
    assert {(r.regex, r.num_literals, r.total_literal_chars, r.avg_literal_length) for r in found.collect()} == {("At (.+)Exit (.+)", 2, 8, 4.0), ("foo|bar", 1, 6, 6.0), (None, 0, 0, 0.0), ("ab*", 0, 0, 0.0)}
    s = corpus_stats.literal_summary(found).first()
    assert (s.total_regexes, s.total_literals, s.avg_literals_per_regex) == (4, 3, 0.75)
    assert set(rows(corpus_stats.literal_histograms(found))) == {("literals", 0, 2), ("literals", 1, 1), ("literals", 2, 1), ("chars", 0, 4)}
    assert corpus_stats.literal_summary(found.limit(0)).first().avg_literal_length == 0.0


def runs(spark, data):
    return spark.createDataFrame(data, "run int, rep int, name string, x double, y double")


def test_filling_and_trimming(spark):
    df = runs(spark, [(1, 0, "A-1", 1.0, 5.0), (1, 1, None, None, 4.0), (1, 2, None, 3.0, 6.0), (2, 0, None, None, 1.0), (2, 1, "B", 2.0, 2.0), (2, 2, None, None, 3.0)])
    filled = results.filled(df, ["run"], ["rep"], ["name", "x"])
    assert rows(filled.select("run", "rep", "name", "x")) == [(1, 0, "A-1", 1.0), (1, 1, "A-1", 1.0), (1, 2, "A-1", 3.0), (2, 0, None, -1.0), (2, 1, "B", 2.0), (2, 2, "B", 2.0)]
    assert rows(results.without_extreme_runs(df, ["run"], "y", ["rep"]).select("run", "rep")) == [(1, 0), (2, 1)]
    few = df.filter("rep < 2")
    assert rows(results.without_extreme_runs(few, ["run"], "y", ["rep"])) == rows(few)
    assert rows(results.without_extreme_runs(df.limit(0), ["run"], "y", ["rep"])) == []
    assert rows(results.trimmed_mean(spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 100.0)] + [(2, 1.0), (2, 3.0)], "g int, v double"), ["g"], "v")) == [(1, 4, 26.75, 3.0), (2, 2, 2.0, 2.0)]


def test_groups(spark):
    df = runs(spark, [(1, 0, "A", 1.0, 5.0), (1, 1, "A", 3.0, 0.0), (2, 0, "B", 2.0, 1.0), (2, 1, "B", 2.0, None)])
    assert rows(results.group_minimum(df, ["name"], ["x", "y"])) == [("A", 1.0, 0.0), ("B", 2.0, 1.0)]
    assert rows(results.group_mean(df, ["name"], ["x"])) == [("A", 2.0), ("B", 2.0)]
    assert rows(results.best_groups(df, "name", ["x"], ["y"])) == [("x", "A", 2.0), ("y", "B", 1.0)]
    s = results.group_summary(df, "name", ["x"]).filter("name = 'A'").first()
    assert (s.x_mean, round(s.x_std, 6), s.x_min, s.x_max) == (2.0, round(statistics.stdev([1, 3]), 6), 1.0, 3.0)
    assert rows(results.first_of_group(df, ["name"], ["x", "rep"]).select("name", "rep")) == [("A", 0), ("B", 0)]
    assert rows(results.best_within_limits(df, [1, 2, 3], "name", "x", ["y", "rep"]).select("key_limit", "name", "rep")) == [(1, "A", 0), (2, "A", 0), (2, "B", 1), (3, "A", 1), (3, "B", 1)]
    assert rows(results.marked_best(df, ["name"], ["x"], ["y"]).select("name", "rep", "x_best", "y_best"))[:2] == [("A", 0, True, True), ("A", 1, False, False)]
    assert rows(results.differences(df, ["name"], ["rep"], "x").select("name", "difference", "relative_difference")) == [("A", 2.0, 2.0), ("B", 0.0, 0.0)]
    assert results.concatenated(df.select("run"), df.select("name")).columns == ["run", "name"]


def test_joined_stats_and_scalars(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(1,), (2,), (3,)], "run_id long")
    s = spark.createDataFrame([(1, 2, 4), (1, 1, 2), (2, 0, 0)], "run_id long, match_count long, num_after_filter long")
    assert rows(results.joined_stats(r, s, ["run_id"])) == [(1, 3, 6, 0.5), (2, 0, 0, None), (3, None, None, None)]
    one = spark.createDataFrame([("LPMS-RANDOM", 0, 0)], "n string, a int, b int")
    assert tuple(one.select(results.method_of(F.col("n")), results.precision(F.col("a"), F.col("b"), True), results.relative_error(F.col("a"), F.col("b")), results.within_tolerance(F.lit(0.105), 0.1)).first()) == ("LPMS", 0.0, None, True)


def test_histograms(spark):
    import numpy as np

    x = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    df = spark.createDataFrame([(v,) for v in x], "v long")
    for log in (False, True):
        data = np.log10(np.array(x) + 1) if log else np.array(x)
        assert [r.n for r in results.equal_width_histogram(df, "v", 4, log).orderBy("bin").collect()] == np.histogram(data, 4)[0].tolist()
    edges = np.interp(np.linspace(0, len(x), 5), np.arange(len(x)), np.sort(x))
    assert np.allclose([r.edge for r in results.equal_count_edges(df, "v", 4).orderBy("edge_no").collect()], edges)
    assert results.equal_width_histogram(df.limit(0), "v").count() == 0 == results.equal_count_edges(df.limit(0), "v").count()
    assert [r.n for r in results.equal_width_histogram(df.filter("v = 1"), "v", 2).orderBy("bin").collect()] == [0, 2]
    assert [r.bin for r in results.binned(df, "v", [1, 5, 20]).orderBy("v").collect()] == [0, 0, 0, 0, 1, 1, 1, None, None, None]


# -- files ------------------------------------------------------------------------------------------------------


def test_line_and_document_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(b"x\r\n\r\ny\n")
    (tmp_path / "two.txt").write_bytes(b"z\xff\n")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(readers.read_lines(spark, str(tmp_path / "a" / "one.txt"))) == ["", "x", "y"]
    assert len(texts(readers.read_lines(spark, str(tmp_path), recursive=True))) == 4
    assert texts(readers.read_documents(spark, str(tmp_path)))[0] == "x\n\ny"
    assert texts(readers.read_raw(spark, str(tmp_path / "a"))) == ["x\r\n\r\ny\n"]
    assert texts(readers.read_raw(spark, str(tmp_path / "two.txt"), ignore_errors=True)) == ["z\n"]
    assert texts(readers.stats_lines(spark, str(tmp_path / "a"))) == ["x", "y"]
    assert texts(readers.read_lines(spark, str(tmp_path / "none"))) == [] and readers.read_lines(spark, str(tmp_path / "a"), most=1).count() == 1
    assert [r.pattern for r in readers.read_patterns(spark, str(tmp_path / "a")).collect()] == ["x", "y"]


def test_workloads(spark, tmp_path):
    (tmp_path / "q").write_text("ab\n\ncd\r\n")
    (tmp_path / "d").write_text("a,b,c,d,e,f,g,h,i,j,k\nshort\n1,2,3,4,5,6,7,8,9,abc\n")
    own = readers.read_workload(spark, 0, str(tmp_path / "q"), str(tmp_path / "d"), str(tmp_path / "q"))
    assert own.corpus.count() == 3 and own.matched.count() == 2
    assert {r.text for r in readers.read_workload(spark, 1, str(tmp_path / "q"), str(tmp_path / "d")).corpus.collect()} == {"j", "abc"}
    with pytest.raises(ValueError):
        readers.read_workload(spark, 9, "", "")
    with pytest.raises(ValueError):
        readers.read_workload(spark, 0, str(tmp_path / "q"), str(tmp_path / "none"))


def test_result_files_round_trip(spark, tmp_path):
    summary = spark.createDataFrame([("FREE", 1, 2, 0.1, 5, 6, 0.5, -1.0, 0.5, 7, 8, 0.1, 0.2)], readers.SUMMARY)
    for _ in range(2):
        sinks.append_summary(summary, str(tmp_path / "s"))
    assert rows(readers.read_summary(spark, str(tmp_path / "s"))) == rows(summary) * 2
    stats = spark.createDataFrame([('a"(\\d)|b', 0.5, 3, 4), ("x y", 0.1, 0, 9)], readers.REGEX_STATS)
    sinks.write_regex_stats(stats, str(tmp_path / "r"))
    assert rows(readers.read_regex_stats(spark, str(tmp_path / "r")).drop("path")) == rows(stats)
    keys = spark.createDataFrame([("b",), ("a\n",), ("a\\",)], "gram string")
    sinks.write_keys(keys, str(tmp_path / "k"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "k")).collect()) == ["a\\\\", "a\\n", "b"]
    sinks.write_literals(corpus_stats.literal_rows(spark.createDataFrame([("At (.+)Exit",)], "pattern string")), str(tmp_path / "l"))
    assert sinks.concatenated_csv(spark, [str(tmp_path / "l")] * 2).select("literals").collect()[0][0] == "At ;Exit"
    sinks.write_stats(corpus_stats.length_stats(corpus(spark, TEXTS)), str(tmp_path / "j"), as_json=True)
    assert spark.read.json(str(tmp_path / "j")).first().total_lines == 6
    sinks.write_texts(corpus(spark, ["a", "b"]), str(tmp_path / "t"))
    assert readers.read_lines(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "kv").write_text("total,5\n")
    assert rows(readers.read_key_values(spark, str(tmp_path / "kv"))) == [("total", "5")]
    index = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "gram string, rec_id long")
    assert [tuple(r) for r in sinks.printed_index(index).collect()] == [("a", 2), ("b", 1)] and sinks.printed_index(index, True).first().rec_ids == [1, 2]
    best = results.marked_best(spark.createDataFrame([("A", 1), ("B", 2)], "m string, x int").withColumn("g", __import__("pyspark").sql.functions.lit(1)), ["g"], ["x"], [])
    assert sorted(r.value for r in sinks.latex_rows(best, ["m", "x"]).collect()) == ["A & \\textbf{1} \\\\", "B & 2 \\\\"]


def test_other_corpora(spark):
    reports = spark.createDataFrame([("p", "Command\n\tMaximum resident set size (kbytes): 1234\n"), ("q", "none")], "path string, text string")
    assert rows(readers.peak_memory(reports)) == [("p", 1234)]
    pubs = corpus(spark, ["#*One\n#@Ann Lee,Bo Ray\n#t2000\n#*Two\n#@\n#*Three\r\n#cX\n#@Cy Dee\n", "no"])
    found = readers.publications(pubs)
    assert [(r.title, r.authors) for r in found.orderBy("no").collect()] == [("One", "Ann Lee,Bo Ray"), ("Three", "Cy Dee")]
    assert sorted(r.last_name for r in readers.last_names(found).collect()) == ["Dee", "Lee", "Ray"]
    assert readers.name_queries(readers.last_names(found), 2).count() == 2
    pages = spark.createDataFrame([(i, "text/html; x", "href") for i in range(30)] + [(99, "text/plain", "href"), (100, "text/html", "zz")], "rec_id long, content_type string, text string")
    kept = readers.web_pages(pages, ["href"], share=0.0, most_per_pattern=10)
    assert kept.count() == 10 and readers.web_pages(pages, ["href"], share=1.0, most_per_pattern=10).count() == 31
    assert rows(readers.distinct_sequences(corpus(spark, ["a", "a", "", "b"]))) == [("a",), ("b",)]


# -- generators -------------------------------------------------------------------------------------------------


def test_generators(spark):
    fixed = generators.fixed_length_strings(spark, 20, 30, "AB", seed=1)
    assert all(re.fullmatch("[AB]{30}", r.text) for r in fixed.collect())
    assert rows(fixed) == rows(generators.fixed_length_strings(spark, 20, 30, "AB", seed=1).repartition(3)) != rows(generators.fixed_length_strings(spark, 20, 30, "AB", seed=2))
    geo = generators.geometric_strings(spark, 300, 4)
    mean = statistics.mean(len(r.text) for r in geo.collect())
    assert 30 < mean < 50
    assert all(20 <= len(r.text) <= 200 for r in generators.normal_length_strings(spark, 50, 8, generators.CONFIGS["small"]["lengths"]).collect())
    assert all(len(r.text) % 3 == 0 for r in generators.trigram_strings(spark, 50, alphabet="ABC").collect())
    assert generators.sampled(geo, 0.1).count() == 30
    for slices in (2, 3):
        queries = generators.gap_queries(geo, 15, slices)
        texts = [r.text for r in geo.collect()]
        assert len(queries) == 15 and all(any(re.search(q, t) for t in texts) for q in queries)
    assert all(re.fullmatch(r"[A-Z]{3,8}\(\.\{[01],\d+\}\)[A-Z]{3,8}\(\.\{[01],\d+\}\)[A-Z]{3,8}", q) for q in generators.key_queries(10))
    aimed = generators.selectivity_queries(geo, "ABCD", 3, 0.2, attempts=10).collect()
    assert len(aimed) == 3 and all(r.hit == (abs(r.selectivity - 0.2) <= 0.06) for r in aimed)
    assert generators.configurations(spark, "small").count() == 108
