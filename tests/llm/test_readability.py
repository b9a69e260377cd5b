import time

import pytest

from gramforge.llm import readability as r

EASY = "The cat sat on the mat. It was a big red cat. The dog ran to it and they did play. Then they had some food."
HARD = "Notwithstanding the considerable heterogeneity of the underlying population, the investigators demonstrated that the proposed methodology consistently outperformed alternative approximations. However, the generalisability of these observations remains substantially constrained by the unavailability of representative longitudinal information. Consequently, subsequent investigations should systematically characterise the responsible mechanisms."


def levels(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x for x in r.reading_levels(df, **kw).collect()}


def test_harder_prose_has_a_higher_level(spark):
    found = levels(spark, [EASY, HARD])
    assert found[0].is_prose and found[1].is_prose and found[0].reading_level == 1 and found[1].reading_level == 4


def test_what_is_no_english_prose(spark):
    texts = [None, "", "   ", "ERROR ferry=3f node=7\nWARN dock=1 retry=2\n" * 5, "MKTAYIAKQRQISFVKSHFSRQ" * 20, "Der Hund lief schnell nach Hause. Die Katze schlief auf dem Dach. Danach war es still im Dorf.", "Road closed at Exit 5. Lane 2 blocked. Expect delays."]
    found = levels(spark, texts)
    assert not any(x.is_prose for x in found.values()) and found[0].grade is None and found[0].sentences == 0


def test_markup_and_headers_do_not_count(spark):
    found = levels(spark, [EASY, f"<html><script>var the = 1;</script><body><p>{EASY}</p><!-- {HARD} --></body></html>", f"From: a@b.c\nSubject: the hard one\n\n{EASY}"])
    assert len({(x.sentences, x.words) for x in found.values()}) == 1


@pytest.mark.parametrize("word, n", [("cat", 1), ("make", 1), ("table", 2), ("happy", 2), ("wanted", 2), ("jumped", 1), ("nation", 2), ("beautiful", 3), ("well-known", 2), ("a", 1)])
def test_syllables(word, n):
    assert r.syllables(word) == n


@pytest.mark.parametrize("piece", ["The cat sat on a mat near the e.g. dog ", "a. ", "<script ", "<!-- ", "aaaa", "....", "      ", "\n \n", "((((", "<p ", "&amp;", "[1", "wrote: ", "> > "])
def test_time_grows_in_proportion(piece):
    def seconds(n):
        text = piece * (n // len(piece))
        best = 9.0
        for _ in range(2):
            start = time.perf_counter()
            r.measure(text)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = seconds(100_000), seconds(800_000)
    assert large < 0.3 or large < 24 * small, (small, large)


def test_limits_are_fitted(spark):
    docs = spark.createDataFrame([(i, EASY) for i in range(6)] + [(i, HARD) for i in range(6, 12)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(6)] + [(i, 1, 3) for i in range(6, 12)] + [(i, 1, 3) for i in range(6, 12)] + [(0, 2, None), (500, 1, 2)], "doc_id long, rater int, reading_level int")
    a, b, c = r.fit_limits(docs, labels)
    easy, hard = (levels(spark, [t])[0].grade for t in (EASY, HARD))
    assert easy < a < hard and easy < b < hard
    assert r.fit_limits(docs.limit(0), labels.limit(0)) == r.DEFAULT_LIMITS


def test_a_column_is_carried_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, EASY, "mail"), (1, EASY, None)], "doc_id long, text string, grade string")
    found = r.reading_levels(df.withColumnRenamed("grade", "source"), carry="source")
    assert {x.source for x in found.collect()} == {"mail", None}
    assert r.reading_levels(df.limit(0)).count() == 0
