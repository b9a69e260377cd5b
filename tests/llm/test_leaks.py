"""Recall and precision of the leak search on planted cases, and its edge cases."""

import random

import pytest

from gramforge.llm import leaks

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vu") for b in ("ban", "der", "fin", "gor", "hul", "jam") for c in ("a", "el", "ix", "os", "um")]
ORDER = "Read the notice and answer in one line."


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def sentences(words):
    return " ".join(" ".join(words[i : i + 8]).capitalize() + "." for i in range(0, len(words), 8))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    own = {i: passage(rng, 48) for i in range(12)}
    items = [(i, f"{ORDER} {sentences(w)}", 1) for i, w in own.items()]
    docs, truth = [], set()

    def plant(words, item=None):
        filler = lambda: passage(rng, rng.randint(20, 120))
        doc = len(docs) + 1000
        docs.append((doc, f"{sentences(filler())} {words if isinstance(words, str) else sentences(words)} {sentences(filler())}", "x"))
        if item is not None:
            truth.add((item, doc))

    for i, w in own.items():
        plant(w, i)
        plant(w[:24], i)
        plant([x if k % 9 else "changed" for k, x in enumerate(w)], i)
        plant([x if k % 2 == 0 else rng.choice(["other", "word", "here"]) + str(k) for k, x in enumerate(w)], i)  # every second word replaced
        plant(w[:24] + passage(rng, 6) + w[24:], i)
        plant("<p>" + sentences(w).replace(" ", "&nbsp;", 3).upper() + "</p>", i)
        plant(w[:6])
        plant(ORDER)
        plant(rng.sample(w, len(w))[:20])
    for _ in range(40):
        plant(passage(rng, 40))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, cosine string"), spark.createDataFrame(items, "item_id long, text string, doc_id int"))
    return {(r.item_id, r.doc_id) for r in found.collect()}, truth, own


def test_planted_leaks_are_found(planted):
    found, truth, _ = planted
    assert len(found & truth) / len(truth) >= 0.97
    assert len(found & truth) / len(found) >= 0.97


def test_three_items_over_one_passage_keep_it():
    rng = random.Random(1)
    shared = sentences(passage(rng, 40))
    items = [(i, f"{shared} Question {w}?") for i, w in enumerate(("one", "two", "three"))]
    assert all(len(w) > 40 for w in leaks.own_passages(items).values())


def test_standing_instructions_are_taken_off_and_reported():
    rng = random.Random(2)
    items = [(i, f"{ORDER} {sentences(passage(rng, 30))}") for i in range(9)] + [(99, ORDER), (100, None), (101, "")]
    assert leaks.standing_sentences([t for _, t in items]) == {ORDER: 10}
    own = leaks.own_passages(items)
    assert all("notice" not in own[i] for i in range(9)) and len(own[99]) == 8 and 100 not in own


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "alpha beta gamma delta epsilon zeta eta theta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "word")], "item_id long, text string")
    assert [(r.item_id, r.doc_id) for r in leaks.leaks(docs, items).collect()] == [(1, None)]
    assert leaks.leaks(docs.limit(0), items).count() == 0 == leaks.leaks(docs, items.limit(0)).count()


def test_subsequences_against_dynamic_programming():
    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common_words(np.array(a), np.array(b)) == table[-1][-1]
