import random
from collections import Counter

from pyspark.sql import functions as F

from gramforge.llm import frequent, term_counts


def test_frequent_items_against_exact_counts(spark):
    rng = random.Random(2)
    data = [int(rng.paretovariate(0.7)) for _ in range(20_000)]
    df = spark.createDataFrame([(str(x), 1) for x in data], "item string, n long")
    exact = Counter(map(str, data))
    top = [(r.item, r.n) for r in frequent.top(df, F.col("item"), None, 20).collect()]
    assert top == sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:20]
    found = {r.item for r in frequent.frequent(df, F.col("item"), F.col("n"), 50).collect()}
    assert found == {x for x, n in exact.items() if n * 50 >= len(data)}


def test_frequent_edge_cases(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), (None, 9), ("c", None), ("d", -4), ("e", 0)], "total string, weight long")
    assert [(r.item, r.n) for r in frequent.top(df, F.col("total"), F.col("weight"), 5).collect()] == [("a", 3), ("b", 3)]
    assert frequent.top(df.limit(0), F.col("total"), None, 5).count() == 0 == frequent.frequent(df.limit(0), F.col("total")).count()


def test_sketch_never_estimates_below(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sketch, seen = frequent.CountMin(), Counter()
    for _ in range(30):
        items = np.unique(rng.integers(0, 1 << 40, 4000))
        weights = rng.integers(1, 9, len(items))
        estimate = sketch.add(items, weights)
        for x, w, e in zip(items.tolist(), weights.tolist(), estimate.tolist()):
            seen[x] += w
            assert e >= seen[x]


def test_term_counts_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "x", "y", None]), [rng.choice([7, 7, 7, None, -1, rng.randint(0, 50)]) for _ in range(rng.randint(0, 6))] if rng.random() < 0.9 else None, 1) for _ in range(3000)]
    df = spark.createDataFrame(data, "term string, record array<long>, n int")
    truth = {}
    for t, ids, _ in data:
        if t is not None:
            truth.setdefault(t, []).extend(x for x in ids or [] if x is not None and x >= 0)
    for shards in (None, 1, 7):
        found = {(r.term, r.occurrences, r.n_records) for r in term_counts.term_counts(df, F.col("term"), F.col("record"), shards).collect()}
        assert found == {(t, len(v), len(set(v))) for t, v in truth.items()}


def test_a_repeated_token_reaches_the_shuffle_once_per_bundle(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"term": ["t"] * 50_000, "record": [1] * 50_000, "n": [1] * 50_000})
    out = list(term_counts._combine(iter([batch] * 4)))
    assert sum(b.num_rows for b in out) == 1 and out[0].column("n").to_pylist() == [200_000]


def test_marks(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", list(range(12))), ("c", list(range(5))), ("d", []), ("e", None), (None, [1])], "t string, r array<long>")
    found = {r.term: (r.df_mark, r.n_records) for r in term_counts.marked(term_counts.term_counts(df, F.col("t"), F.col("r")), 100).collect()}
    assert found == {"a": ("rare", 2), "b": ("common", 12), "c": (None, 5), "d": (None, 0), "e": (None, 0)}
    empty = term_counts.term_counts(df.limit(0), F.col("t"), F.col("r"))
    assert term_counts.marked(empty, 0).count() == 0
