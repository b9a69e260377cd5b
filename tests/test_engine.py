"""The fixtures of the survey, and the master invariant: an indexed count equals the count of a full scan."""

import random
import re

import pytest

from gramforge import engine
from gramforge.functions import regex as rx
from gramforge.operators import match, postings
from gramforge.operators.selectors import best, common, free, lpms, vggraph, vgopt
from gramforge.plans import boolean
from gramforge.plans.cut import written


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "rec_id long, text string")


def grams(df):
    return {r.gram for r in df.collect()}


def lists(index):
    out = {}
    for r in index.postings().collect():
        out.setdefault(r.gram, set()).add(r.rec_id)
    return out


SIX = ["0.aaaaa", "1.bbbbb", "2.ccccc", "3.ddddd", "4.eeeee", "5.fffff"]
WORDS = ["an", "York", "Franc", "kane", "anc", "Yor", "Fran", "kan", "ane", "Yo", "Fra", "ka"]


def with_keys(keys):
    """Each key once, every proper substring of it ten times per occurrence."""
    rows = list(keys)
    for k in keys:
        rows += [k[i:j] for i in range(len(k)) for j in range(i + 1, len(k) + 1) if j - i < len(k) for _ in range(10)]
    return rows


def test_free_postings_when_everything_is_useful(spark):
    index = engine.build(corpus(spark, SIX), None, "FREE", c=1.0, upper_n=2)
    expected = {str(i): {i} for i in range(6)} | {"abcdef"[i]: {i} for i in range(6)} | {".": set(range(6))}
    assert lists(index) == expected


def test_free_is_prefix_free(spark):
    found = lists(engine.build(corpus(spark, SIX), None, "FREE", c=0.9, upper_n=2))
    assert "." not in found and all(found[f".{'abcdef'[i]}"] == {i} for i in range(6))
    assert not any(f"{i}." in found for i in range(6))


@pytest.mark.parametrize("presuf", ["sound", "compat"])
def test_presuf_drops_redundant_suffixes(spark, presuf):
    found = lists(engine.build(corpus(spark, SIX), None, "FREE", c=0.9, upper_n=2, presuf=presuf))
    assert not any(k.startswith(".") for k in found) and all(found["abcdef"[i]] == {i} for i in range(6))


def test_presuf_forms_differ_where_a_neighbour_stands_between(spark):
    keys = spark.createDataFrame([("a", 1), ("ba", 1), ("ca", 1)], "gram string, df long")
    assert grams(free.presuf_shell(keys)) == {"a", "ca"} and grams(free.without_suffixes(keys)) == {"a"}


def test_key_lookup(spark):
    texts = with_keys(["Will", "liam", "Clint", "nton"])
    index = engine.build(corpus(spark, texts), None, "FREE", c=9 / len(texts), upper_n=5)
    plans = index.plans(["Bill", "William", "Clinton"])
    assert {p: set(boolean.literals(x)) for p, x in plans.items()} == {"Bill": set(), "William": {"Will", "liam"}, "Clinton": {"Clint", "nton"}}
    literals = match.literal_table(spark, list(enumerate(["Bill", "William", "Clinton"])))
    rows = match.found_keys(index.keys, literals).collect()
    assert {(r.query_id, r.gram) for r in rows} == {(1, "Will"), (1, "liam"), (2, "Clint"), (2, "nton")}


def test_planned_pattern_leaves_one_candidate(spark):
    texts = with_keys(["Will", "liam", "Clint", "nton"])
    n = len(texts)
    texts += ["linto", "illi", "ton", "llia"] * 10 + ["William", "Bill.Clinton"]
    index = engine.build(corpus(spark, texts), None, "FREE", c=4 / (42 + n), upper_n=5)
    pattern = "(Bill|William)(.*)Clinton"
    assert [r.rec_id for r in index.candidates(pattern, trees=True).collect()] == [len(texts) - 1]
    assert index.plans([pattern], trees=True)[pattern][0] == "and"


def test_short_words_match_where_the_comments_say(spark):
    c = corpus(spark, WORDS)
    for method in ("BEST", "LPMS", "FREE", "TRIGRAM", "VGGRAPH", "NONE"):
        counts = {r.pattern: r.match_count for r in engine.build(c, ["ane", "ork", "ka"], method).match(["ane", "ork", "ka"]).collect()}
        assert counts == {"ane": 2, "ork": 1, "ka": 3}, method


def test_variable_length_grams_on_fruits(spark):
    c = corpus(spark, ["banana", "bandana", "cabana", "anagram"])
    patterns = ["ba(.*)a", "(.*)ana", "c(.*)a", "ana(.*)"]
    index = engine.build(c, patterns, "VGGRAPH", c=0.5, upper_n=3)
    assert {r.pattern: r.match_count for r in index.match(patterns).collect()} == {"ba(.*)a": 3, "(.*)ana": 4, "c(.*)a": 1, "ana(.*)": 4}


@pytest.mark.parametrize("most", [2, 5, 10, 20])
def test_key_bound(spark, most):
    texts = [f"At road {i} Exit {i % 3} between main street and lane {i * 7}" for i in range(10)]
    for method in ("FREE", "TRIGRAM", "VGGRAPH", "BEST", "LPMS", "VGGRAPH_OPT"):
        upper = {"upper_n": 2} if method == "VGGRAPH_OPT" else {}
        assert engine.select(corpus(spark, texts), ["At (.+)Exit (.+)", "street(.*)lane"], method, c=0.5, most=most, **upper).count() <= most, method


PATTERNS = [
    "abc", "a(b|c)d", "ab*c", "a+b", "x?yz", "(ab|cd)+e", "a.c", "[ab]c[^d]", "^ab", "cd$", "a{2,3}b", "(a|b)*c", "ab|cd", "(?i)ABC", "dd(.{0,3})aa", "", "(", "a**", "b(cd)?e", "(da|ad)(bc|cb)", r"\Aabc", r"[[:alpha:]]d",
]


@pytest.mark.parametrize("method", engine.METHODS)
@pytest.mark.parametrize("through", ["texts", "postings"])
@pytest.mark.parametrize("trees", [False, True])
def test_every_index_counts_like_a_full_scan(spark, method, through, trees):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", "abc", "abc", "é😀abc"]
    c = corpus(spark, texts)
    truth = {p: sum(re.search(rx.to_python(p), t) is not None for t in texts) if rx.is_valid(p) else 0 for p in PATTERNS}
    index = engine.build(c, PATTERNS, method, c=0.3, **({"upper_n": 2} if method == "VGGRAPH_OPT" else {}))
    rows = index.match(PATTERNS, through=through, trees=trees).collect()
    assert {r.pattern: r.match_count for r in rows} == truth
    assert all(r.match_count <= r.num_after_filter <= len(texts) for r in rows)
    by_text = {r.pattern: r.num_after_filter for r in index.match(PATTERNS, through="texts", trees=trees).collect()}
    assert {r.pattern: r.num_after_filter for r in rows} == by_text


def test_few_patterns_stay_in_the_jvm(spark):
    c = corpus(spark, ["abc", "abd", "xyz", ""])
    df = match.scan_counts(c, ["ab[cd]", "z$"], {"ab[cd]": ("key", "ab")})
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert {(r.pattern, r.num_after_filter, r.match_count) for r in df.collect()} == {("ab[cd]", 2, 2), ("z$", 4, 1)}
    many = match.scan_counts(c, ["ab[cd]", "z$"] + [f"q{i}" for i in range(30)], {"ab[cd]": ("key", "ab")})
    assert {(r.pattern, r.num_after_filter, r.match_count) for r in many.collect() if r.pattern[0] != "q"} == {("ab[cd]", 2, 2), ("z$", 4, 1)}


def test_repeated_and_null_queries(spark):
    queries = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "(")], "query_id int, pattern string")
    counts = match.scan_counts(corpus(spark, ["ab", "b"]), match.patterns_of(queries))
    assert {(r.query_id, r.match_count) for r in match.with_query_ids(queries, counts).collect()} == {(1, 1), (2, 1), (3, 0), (4, 0)}


@pytest.mark.parametrize("method", engine.METHODS)
def test_empty_corpus(spark, method):
    index = engine.build(spark.createDataFrame([], "rec_id long, text string"), ["abc"], method)
    assert index.keys.count() == 0
    assert [tuple(r) for r in index.match(["abc"]).collect()] == [("abc", 0, 0)]


def test_best_greedy_is_the_same_in_spark_and_on_the_driver(spark):
    rng = random.Random(3)
    c = corpus(spark, ["".join(rng.choice("abcd") for _ in range(12)) for _ in range(40)])
    patterns = ["abcd(.*)ba", "ddc", "cab(.+)dd", "bbad"]
    assert grams(best.best_keys(c, patterns, 0.5)) == grams(best.best_keys(c, patterns, 0.5, most_states=0)) != set()


def test_best_greedy_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(10)) for _ in range(30)]
    patterns = ["abca", "cc(.*)ab", "bac"]
    counts = best.gram_counts(corpus(spark, texts), match.query_literals(patterns))
    assert all(n == sum(t.startswith(g, i) for t in texts for i in range(len(t))) for g, n in counts.items())
    cand = best.candidates(counts, len(texts), 0.6)
    of = {q: {g for g in cand if any(g in x for x in lits)} for q, lits in enumerate(match.query_literals(patterns))}
    rc = [t for t in texts if any(g in t for g in cand)]
    uncovered = {(q, i) for q in of for i in range(len(rc))}
    chosen = []
    while True:
        gain = {g: sum(1 for q, i in uncovered if g in of[q] and g not in rc[i]) for g in cand}
        top = max(cand, key=lambda g: gain[g], default=None)
        if top is None or not gain[top]:
            break
        chosen.append(top)
        uncovered = {(q, i) for q, i in uncovered if not (top in of[q] and top not in rc[i])}
    assert grams(best.best_keys(corpus(spark, texts), patterns, 0.6)) == set(chosen)


def test_workload_reduction(spark):
    literals = [["abc"], ["abd"], ["xyz"], ["xyw"]]
    counts = best.gram_counts(corpus(spark, ["abcabd", "xyzxyw"]), literals)
    for measure in (1, 2, 3):
        d = best.distances(literals, counts, measure)
        assert (d == d.T).all() and (d.diagonal() == 0).all()
        assert sorted(map(sorted, best.k_medians(d, 2).values())) == [[0, 1], [2, 3]]
    assert best.reduced_size(400, 0.1) == 40 and best.reduced_size(50, 0.1) == 10 and best.reduced_size(4, 0.1) == 4
    c = corpus(spark, WORDS)
    assert best.best_keys(c, WORDS, 0.3, reduced_to=4).count() >= 1
    assert best.parallel_best_keys(c, WORDS, 4, 0.3).count() >= 1


def test_distance_table_equals_the_matrix(spark):
    literals = [["abc"], ["abd"], ["xyz"], []]
    counts = best.gram_counts(corpus(spark, ["abcabd", "xyz"]), literals)
    sets = spark.createDataFrame([(q, g) for q, x in enumerate(literals) for g in best.substrings_of(x)] + [(3, "q")], "query_id int, gram string")
    weights = spark.createDataFrame(sorted((counts | {"q": 0}).items()), "gram string, weight long")
    for r in best.distance_table(sets, weights).collect():
        for m, value in ((1, r.d1), (2, r.d2), (3, r.d3)):
            assert abs(best.distances(literals, counts, m)[r.q1, r.q2] - value) < 1e-9


def test_linear_program():
    import numpy as np

    # x = 1 fulfils all rows; both answers are checked against the vertex found by hand
    x = lpms.cover(np.array([1.0, 3.0]), np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([2.0, 1.0]))
    assert np.allclose(x, [1, 1])
    assert np.allclose(lpms.cover(np.array([5.0, 1.0]), np.array([[1.0, 1.0]]), np.array([4.0])), [0, 4])
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b, c = rng.integers(0, 4, (5, 7)).astype(float), rng.integers(0, 5, 5).astype(float), rng.integers(1, 9, 7).astype(float)
        x = lpms.cover(c, a, b)
        helped = a.any(axis=1)
        assert (x >= 0).all() and (a @ x >= b - 1e-7)[helped].all()


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_linear_program_of_counts_of_unlike_sizes(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    has = np.zeros((120, 150))
    for q in range(120):
        has[q, rng.zipf(1.3, 12) % 150] = 1
    n_records = rng.integers(1, 10, 150) * 10.0 ** rng.integers(0, 5, 150)
    n_queries = has.sum(axis=0)
    bounds = np.array([n_queries[own > 0].min() for own in has])
    x = lpms.cover(n_records * n_queries, has * n_records, bounds)
    # the least cost doesn't depend on the records, as a gram's cost and its use are both in proportion to them
    least = n_queries @ lpms.cover(n_queries, has, bounds)
    assert (has * n_records @ x >= bounds - 1e-9).all() and abs((n_records * n_queries) @ x - least) < 1e-6


@pytest.mark.parametrize("table, chars", [(1 << 22, 1 << 17), (0, 7)])
def test_record_counts_of_strings_of_all_lengths(monkeypatch, table, chars):
    monkeypatch.setattr(common._Trie, "TABLE", table)
    monkeypatch.setattr(common._Trie, "CHARS", chars)
    rng = random.Random(4)
    for alphabet in ("ab", "a\0b", "aé😀b"):
        texts = ["".join(rng.choice(alphabet + "z") for _ in range(rng.randint(0, 9))) for _ in range(12)]
        strings = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(12)}
        trie = common._Trie(strings)
        trie.add(texts)
        found = {x: n for own, counts in zip(trie.prefixes, trie.counts) for x, n in zip(own, counts[1:])}
        assert {x: found[x] for x in strings} == {x: sum(x in t for t in texts) for x in strings}


@pytest.mark.parametrize("options", [{"rounding": "deterministic"}, {"rounding": "random"}, {"scope": "queries"}, {"drop_last": True}])
def test_lpms_is_sound(spark, options):
    words = ["an", "York", "Franc", "kane"]
    index = engine.build(corpus(spark, words), words, "LPMS", **options)
    assert {r.pattern: r.match_count for r in index.match(words).collect()} == {"an": sum("an" in w for w in words), "York": 1, "Franc": 1, "kane": 1}


def test_lpms_index_goes_through_the_texts_once_for_all_levels(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(lpms, "string_counts", lambda c, strings, per_record: passes.append(set(strings)) or common.string_counts(c, strings, per_record=per_record))
    words = ["an", "York", "Franc", "kane"]
    index = engine.build(corpus(spark, words), words, "LPMS", scope="queries")
    assert {r.pattern: r.match_count for r in index.match(words).collect()} == {"an": sum("an" in w for w in words), "York": 1, "Franc": 1, "kane": 1}
    assert len(passes) == 1 and {"n", "ork", "Franc"} <= passes[0]
    few = sorted(index.keys.collect())
    monkeypatch.setattr(lpms, "STRINGS_A_PASS", 0)
    assert sorted(engine.build(corpus(spark, words), words, "LPMS", scope="queries").keys.collect()) == few and len(passes) > 2


def test_cover_takes_the_cheapest_grams():
    assert vggraph.greedy_cover(["quick", "fox"], {"qu": 1, "ui": 5, "ick": 3, "ox": 2, "fox": 3}) == ["qu", "fox", "ick"]
    assert vggraph.greedy_cover([], {"a": 1}) == [] and vggraph.greedy_cover(["abc"], {}) == []


def test_frequency_quantile(spark):
    sizes = [1, 1, 2, 3, 3, 3, 8, 9, 9, 10]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "gram string, df long")
    assert vggraph.frequency_quantile(df, 0.8) == sorted(sizes)[8] and vggraph.frequency_quantile(df.limit(0)) == 10


def test_until_selective_leaves_only_the_longest_frequent(spark):
    c = corpus(spark, ["quickfox", "quickdog", "quickcat", "lazydog"])
    found = {r.gram: r.df for r in vggraph.until_selective(c, 1, 4).collect()}
    assert all(n <= 1 or len(g) == 4 for g, n in found.items()) and "quic" in found


def test_graph_edges_and_coverage_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(25)]
    c = corpus(spark, texts)
    rows = vgopt.vertices(c, 2)
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.gram, set()).add(r.rec_id)
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.1}
    edges = vgopt.jaccard_edges(rows)
    assert {(r.g1, r.g2) for r in edges.collect()} == truth
    nodes = vgopt.centrality(rows, edges, len(texts)).collect()
    for late in (100, 3):
        order = sorted((n for n in nodes if n.selectivity <= 0.4), key=lambda n: (-n.centrality / (n.selectivity + 1e-10), n.gram))
        covered, chosen = set(), set()
        for n in order:
            new = sets[n.gram] - covered
            if new and (len(chosen) < late or len(new) > 1):
                chosen.add(n.gram)
                covered |= sets[n.gram]
            if len(covered) >= 0.9 * len(texts):
                break
        found = vgopt.covering_keys(rows, vgopt.centrality(rows, edges, len(texts)), len(texts), 0.4, late_after=late)
        assert grams(found) == chosen, late
    assert vgopt.coverage(rows, found, len(texts)) > 0


def _sequential_keys(sets, nodes, n, c, late, enough=0.9):
    order = sorted((x for x in nodes if x.selectivity <= c), key=lambda x: (-x.centrality / (x.selectivity + 1e-10), x.gram))
    covered, chosen = set(), set()
    for x in order:
        if len(covered) >= enough * n:
            break
        new = sets[x.gram] - covered
        if len(new) >= (1 if len(chosen) < late else 2):
            chosen.add(x.gram)
            covered |= new
    return chosen


@pytest.mark.parametrize("pairs", [0, 20, 1_000_000])
def test_late_keys_add_two_records_whatever_the_size(spark, monkeypatch, pairs):
    monkeypatch.setattr(vgopt, "MOST_PAIRS", pairs)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(40)]
    rows = vgopt.vertices(corpus(spark, texts), 2)
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.gram, set()).add(r.rec_id)
    nodes = vgopt.centrality(rows, vgopt.jaccard_edges(rows), len(texts))
    found = vgopt.covering_keys(rows, nodes, len(texts), 0.1, enough=1.0, late_after=2)
    expected = _sequential_keys(sets, nodes.collect(), len(texts), 0.1, 2, 1.0)
    assert grams(found) == expected and {r.gram: r.df for r in found.collect()} == {g: len(sets[g]) for g in expected}
    # with one record enough, other keys are chosen
    assert expected != _sequential_keys(sets, nodes.collect(), len(texts), 0.1, 1000, 1.0)


@pytest.fixture
def small_file(spark, tmp_path):
    """A file that is far smaller than its grams; the limit of broadcasts lies between them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    corpus(spark, texts).coalesce(1).write.parquet(str(tmp_path / "texts"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark.read.parquet(str(tmp_path / "texts")), len(texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_keys_broadcast_nothing(small_file, monkeypatch):
    plans, covering = [], vgopt.covering_keys
    monkeypatch.setattr(vgopt, "written", lambda df: plans.append(_plan(df)) or written(df), raising=False)
    monkeypatch.setattr(vgopt, "covering_keys", lambda rows, nodes, *more: plans.append(_plan(nodes)) or covering(rows, nodes, *more))
    plans.append(_plan(vgopt.vgopt_keys(small_file[0], 0.3, 2)))
    assert not any("Broadcast" in p for p in plans)


def test_centrality_broadcasts_nothing_and_counts_a_record_once(spark, small_file):
    texts, n = small_file
    rows = vgopt.vertices(texts, 2)
    nodes = vgopt.centrality(rows, vgopt.jaccard_edges(rows), n)
    assert "Broadcast" not in _plan(nodes)
    twice = rows.union(rows)
    assert sorted(vgopt.centrality(twice, vgopt.jaccard_edges(twice), n).collect()) == sorted(nodes.collect())


def test_edges_broadcast_nothing_and_take_records_without_id(spark, small_file):
    assert "Broadcast" not in _plan(vgopt.jaccard_edges(vgopt.vertices(small_file[0], 2)))
    # a record without id has grams but shares none
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("b", 2), ("a", None), ("b", None)], "gram string, rec_id long")
    assert [tuple(r) for r in vgopt.jaccard_edges(rows).collect()] == [("a", "b", 1 / 4)]


def test_list_operations(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 70000), ("b", 2), ("b", 3)], "gram string, rec_id long")
    ids = lambda df: sorted(r.rec_id for r in df.collect())
    assert ids(postings.lookup(rows, "a")) == [1, 2, 70000] and ids(postings.lookup(rows, "zz")) == []
    assert ids(postings.in_all(rows, ["a", "b", "a"])) == [2] and ids(postings.in_any(rows, ["a", "b"])) == [1, 2, 3, 70000]
    assert ids(postings.in_all(rows, ["a", "zz"])) == [] and ids(postings.in_all(rows, [])) == [1, 2, 3, 70000] and ids(postings.in_any(rows, [])) == []
    assert ids(postings.in_first_only(rows, "a", "b")) == [1, 70000] and ids(postings.in_one_only(rows, "a", "b")) == [1, 3, 70000]
    assert ids(postings.is_member(rows.select("rec_id").distinct(), rows, "b")) == [2, 3]
    assert {(r.gram, r.block_no, tuple(r.rec_ids)) for r in postings.packed(rows).collect()} == {("a", 0, (1, 2)), ("a", 1, (70000,)), ("b", 0, (2, 3))}
    assert [r.gram for r in postings.seek(rows.select("gram").distinct(), "aa").collect()] == ["b"]
    size = postings.index_size(postings.document_frequency(rows)).first()
    assert tuple(size) == (2, 5, 2 * 2 + 2 * 48 + 8 * 5)


def test_summary_row(spark):
    from gramforge.sources.readers import SUMMARY

    row = engine.build(corpus(spark, SIX), None, "FREE", c=0.9, upper_n=2).summary(num_queries=3)
    assert row.columns == SUMMARY.fieldNames() and row.first().num_keys == 18
