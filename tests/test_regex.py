"""The dialect: literals, validity, translation (against the engine that has it, by DuckDB), plans."""

import re

import duckdb
import pytest

from gramforge.functions import regex as rx
from gramforge.operators import match
from gramforge.plans import boolean

LITERALS = [
    ("At (.+)Exit (.+)", ["At ", "Exit "], ["At ", "Exit "]),
    (r"William(\s+[a-z]+\s+)Clinton", ["William", "Clinton"], ["William", "Clinton"]),
    ("foo|bar", ["foobar"], []),
    ("a.b", ["ab"], ["a", "b"]),
    (r"a\db", ["ab"], ["a", "b"]),
    ("ab*", [], ["a"]),
    (r"a\+b", [], ["a+b"]),
    ("ab{0,2}c", ["ab", "c"], ["a", "c"]),
    (r"Subject(\s*)\n", ["Subject", "\n"], ["Subject", "\n"]),
    (r"(\d+(\.\d+)?)\%", ["%"], ["%"]),
    ("[^)]x", [], ["x"]),
    ("abc(de", ["abc"], []),
    (r"(\*)foo", [], ["foo"]),
    (r"a\\b", ["a\\b"], ["a\\b"]),
    (r"x\rz", ["xrz"], ["x\rz"]),
    ("(?i)abc", ["abc"], []),
    ("a(?i)b 1", ["a", "b 1"], ["a", " 1"]),
    ("*a", [], []),
    ("", [], []),
]


@pytest.mark.parametrize("pattern, compat, sound", LITERALS)
def test_literals(pattern, compat, sound):
    assert rx.literals(pattern, "compat") == compat and rx.literals(pattern) == sound


TEXTS = ["", "a", "ab", "AB", "aB", "abbb", "aaab", "x123", "abababab c", "a\n", "a\r", "x\x0by", "x[y", "a&&b", "a{,2}b", "αβγ", "éa", "12 ab", "foo.bar", "a-b", "ab\ncd", "KK", "ſ s", "abc d", "(ab(ab", "bbbb", "q" * 30]
PATTERNS = [
    "a$", "a.", r"\s", "x[[]y", "[a&&b]&", "a{,2}b", "a{2}", "x[0-9]{3}", "(ab){4} c", "a(?i)b", "(?i)a(?-i:b)", "(?i)(?-i)a", r"\Qab\E*", r"\Q(ab\E{2}", "[[:^digit:]]", r"[\pL]", r"\p{Greek}", r"\P{Greek}", r"[^\p{L}]", "(?s)b.c", "(?m)^cd", "(?m)b$",
    r"\bab\b", r"\Bb", r"(?i)k", r"(?i)S", "(?U)a+b", "a|b*", "(a|b)*c", "[a-c-]", "[]a]", "[^]a]", r"\x41", r"\x{e9}", r"\101", r"[\d\s]b", r"[^\D]", "b{2,}$", "^a{3}b", "a??b", "(?P<n>a)b", "(?:ab)+", "()", "a||b", r"\.b", r"[\W]", "[[:alpha:]][[:space:]]",
]
INVALID = ["a(?=b)", r"(a)\1", "x{1001}", "a**", "a+*", "a{2}{3}", "(a{100}){100}", "(", ")", "[", "[z-a]", r"\p{Foo}", r"\q", "(?<!a)b", "*", "+a", "a{3,2}", "[[:foo:]]", r"\8", "(?<n>a)b", "\\"]


def test_translations_against_the_dialect_itself(spark):
    con = duckdb.connect()
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "rec_id long, text string")
    expected = {p: [con.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS] for p in PATTERNS}
    import regex

    from pyspark.sql import functions as F

    columns = [F.col("text").rlike(rx.to_java(p)).alias(f"c{n}") for n, p in enumerate(PATTERNS)]
    rows = texts.select("rec_id", *columns).orderBy("rec_id").collect()
    for n, p in enumerate(PATTERNS):
        assert [r[f"c{n}"] for r in rows] == expected[p], p
        if not re.search(r"\\[pP]", p):
            assert [regex.search(rx.to_python(p), t) is not None for t in TEXTS] == expected[p], p


@pytest.mark.parametrize("pattern", INVALID)
def test_invalid_patterns_match_nothing(pattern):
    with pytest.raises(duckdb.Error):
        duckdb.sql("select regexp_matches('a', $p)", params={"p": pattern}).fetchall()
    assert not rx.is_valid(pattern) and rx.sound_literals(pattern) == [] and boolean.plan(pattern) == boolean.ALL


def test_no_pattern_kills_a_job(spark):
    texts = spark.createDataFrame([(0, "ab"), (1, "αβ")], "rec_id long, text string")
    for some in (INVALID[:10], INVALID + PATTERNS):
        counts = {r.pattern: r.match_count for r in match.scan_counts(texts, some).collect()}
        assert all(counts[p] == 0 for p in some if p in INVALID)


def test_deep_patterns_are_known_and_survive_long_texts(spark):
    assert rx.is_deep("x(a|bc)*d") and not rx.is_deep("(a|b)*c") and not rx.is_deep("x[ab]*d")
    texts = spark.createDataFrame([(0, "x" + "abc" * 20_000 + "d"), (1, "x" + "abc" * 20_000)], "rec_id long, text string")
    assert [r.match_count for r in match.scan_counts(texts, ["x(a|bc)*d"]).collect()] == [1]


def test_all_patterns_of_the_query_table_are_translated():
    rows = duckdb.sql("select distinct pattern from '/root/testdata/sf0.001/queries.parquet'").fetchall() if __import__("os").path.exists("/root/testdata/sf0.001/queries.parquet") else []
    assert all(rx.is_valid(p) and rx.to_java(p) and rx.to_python(p) for (p,) in rows)


@pytest.mark.parametrize(
    "pattern, shown",
    [
        ("(Bill|William)(.*)Clinton", "AND(OR('Bill', 'William'), 'Clinton')"),
        ("ab(c(d|e)+)?f", "AND('ab', 'f')"),
        ("a((b|c)d)e", "AND('a', OR('b', 'c'), 'd', 'e')"),
        ("x|[yz]", "NULL"),
        ("(ab){2}", "'ab'"),
        ("(?i)ab", "NULL"),
        ("(", "NULL"),
    ],
)
def test_plans(pattern, shown):
    assert boolean.shown(boolean.plan(pattern)) == shown


def test_rewriting_by_keys():
    keys = {"Will": None, "liam": None, "Clint": None, "nton": None}
    plan = boolean.rewritten(boolean.plan("(Bill|William)(.*)Clinton"), lambda x: [k for k in keys if k in x])
    assert boolean.shown(plan) == "AND('Clint', 'nton')"
    assert sorted(boolean.clauses(("and", (("or", (("key", "a"), ("key", "b"))), ("key", "c"))))) == [("a", "c"), ("b", "c")]
    wide = ("and", tuple(("or", tuple(("key", f"{i}{j}") for j in range(9))) for i in range(4)))
    assert len(boolean.clauses(boolean.bounded(wide))) == 9


def test_helpers():
    assert rx.remove_escapes(r"a\.b\\") == "a.b"
    assert rx.is_special("") and rx.is_special("a.b") and rx.is_special(r"a\d") and not rx.is_special(r"a\.b")
    assert [rx.prosite_to_regex(m) for m in ("[AC]-x-V-x(4)-{ED}.", "<A-x-[ST](2)-x(0,1)-V", "K-x(2)-[RL]>", "A-[GS>]")] == ["[AC].V.{4}[^ED]", "^A.[ST]{2}.{0,1}V", "K.{2}[RL]$", r"A([GS]|\z)"]


def test_group_names_are_used_once():
    assert rx.is_valid("(?P<a>x)(?P<b>y)") and not rx.is_valid("(?P<n>a)(?P<n>b)")
