"""Query substrings chosen by greatest benefit for query and record pairs (BEST).

Candidates are substrings of the queries' literals that occur at most ``c`` times
the number of records, and no prefix of which is a candidate already.  A pair
of query and record is covered if some chosen gram of the query is missing from
the record; a gram's benefit is the number of uncovered pairs it covers.

Whether a pair is covered depends only on which of its query's candidates the
record contains.  So records are aggregated once by ``(query, candidates
contained)`` in Spark, and the greedy loop runs on these counts, whose number
doesn't grow with the records once every combination has been seen.  Up to
``MOST_STATES`` of them are handled on the driver, more in Spark.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.operators.match import query_literals
from gramforge.operators.postings import postings
from gramforge.operators.selectors.common import key_table, string_counts, substrings_of
from gramforge.plans.cut import checkpointed, written

MOST_STATES = 2_000_000


def gram_counts(corpus: DataFrame, literals: list[list[str]]) -> dict[str, int]:
    """Occurrences (overlapping ones, too) of every substring of the literals, 0 included."""
    return string_counts(corpus, substrings_of(x for lits in literals for x in lits), per_record=False)


def candidates(counts: dict[str, int], n_records: int, c: float) -> list[str]:
    """The rare substrings without a rare prefix, in order.  A count never grows with the gram, so the prefix one shorter decides."""
    most = int(c * n_records)
    return sorted(g for g, n in counts.items() if n <= most and (len(g) == 1 or counts[g[:-1]] > most))


def relations(grams: list[str], literals: list[list[str]]) -> list[tuple[int, str]]:
    """``(query, gram)``: which candidates each query's literals contain."""
    known, lengths = set(grams), {len(g) for g in grams}
    return [(q, g) for q, lits in enumerate(literals) for g in sorted(substrings_of(lits, lengths) & known)]


def states(rows: DataFrame, qg: list[tuple[int, int, str]]) -> DataFrame:
    """``(query, held array<int>, n)``: the records by the candidates of a query that they contain (at least one)."""
    wanted = rows.sparkSession.createDataFrame(qg, "query int, gram_no int, gram string")
    held = rows.join(wanted, "gram").groupBy("query", "rec_id").agg(F.array_sort(F.collect_set("gram_no")).alias("held"))
    return held.groupBy("query", "held").agg(F.count(F.lit(1)).alias("n"))


def _greedy_on_driver(state: list[tuple[int, frozenset[int], int]], of_query: dict[int, list[int]], n_rc: int, most: int | None) -> list[int]:
    uncovered: dict[int, dict[frozenset, int]] = defaultdict(dict)
    for q, held, n in state:
        uncovered[q][held] = n
    for q in of_query:
        rest = n_rc - sum(uncovered[q].values())
        if rest:
            uncovered[q][frozenset()] = rest
    queries_of: dict[int, list[int]] = defaultdict(list)
    for q, grams in of_query.items():
        for g in grams:
            queries_of[g].append(q)
    share = {(q, g): sum(n for h, n in uncovered[q].items() if g not in h) for q, grams in of_query.items() for g in grams}
    benefit = np.zeros(max(queries_of, default=-1) + 1, np.int64)
    for (_, g), n in share.items():
        benefit[g] += n
    chosen: list[int] = []
    while len(benefit) and (most is None or len(chosen) < most):
        best = int(benefit.argmax())
        if benefit[best] <= 0:
            break
        chosen.append(best)
        for q in queries_of[best]:
            uncovered[q] = {h: n for h, n in uncovered[q].items() if best in h}
            for g in of_query[q]:
                now = sum(n for h, n in uncovered[q].items() if g not in h)
                benefit[g] += now - share[q, g]
                share[q, g] = now
    return chosen


def _greedy_in_spark(state: DataFrame, of_query: dict[int, list[int]], n_rc: int, most: int | None) -> list[int]:
    spark = state.sparkSession
    sizes = spark.createDataFrame([(q, g) for q, g in of_query.items()], "query int, grams array<int>")
    rest = sizes.select("query").join(state.groupBy("query").agg(F.sum("n").alias("m")), "query", "left").select("query", F.array().cast("array<int>").alias("held"), (F.lit(n_rc) - F.coalesce("m", F.lit(0))).alias("n"))
    left = checkpointed(state.unionByName(rest.filter("n > 0")))
    chosen: list[int] = []
    while most is None or len(chosen) < most:
        missing = left.join(sizes, "query").select(F.explode(F.array_except("grams", "held")).alias("gram"), "n")
        best = missing.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(1).collect()
        if not best:
            break
        chosen.append(best[0].gram)
        own = sizes.filter(F.array_contains("grams", best[0].gram)).select("query", F.lit(1).alias("own"))
        left = checkpointed(left.join(own, "query", "left").filter(F.col("own").isNull() | F.array_contains("held", best[0].gram)).drop("own"))
    return chosen


def best_keys(corpus: DataFrame, patterns: list[str], c: float = 0.1, most: int | None = None, reduced_to: int | None = None, distance: int = 2, mode: str = "sound", seed: int = 0, most_states: int = MOST_STATES) -> DataFrame:
    """``(gram, df)``: the chosen keys; ties go to the first gram in order.

    ``reduced_to`` lets only that many representative queries (k-medians of the
    chosen ``distance``) take part in the choice.
    """
    literals = query_literals(patterns, mode)
    counts = gram_counts(corpus, literals)
    if reduced_to is not None and reduced_to < len(literals):
        literals = reduced(literals, counts, reduced_to, distance, seed)
        counts = {g: counts[g] for g in substrings_of(x for lits in literals for x in lits)}
    grams = candidates(counts, corpus.count(), c)
    number = {g: k for k, g in enumerate(grams)}
    qg = [(q, number[g], g) for q, g in relations(grams, literals)]
    if not qg:
        return key_table(corpus.sparkSession, {})
    rows = written(postings(corpus, key_table(corpus.sparkSession, dict.fromkeys(grams, 0))))
    n_rc = rows.select("rec_id").distinct().count()
    of_query: dict[int, list[int]] = defaultdict(list)
    for q, k, _ in qg:
        of_query[q].append(k)
    found = written(states(rows, qg))
    if found.count() <= most_states:
        chosen = _greedy_on_driver([(r.query, frozenset(r.held), r.n) for r in found.toLocalIterator()], of_query, n_rc, most)
    else:
        chosen = _greedy_in_spark(found, of_query, n_rc, most)
    keys = corpus.sparkSession.createDataFrame([(grams[k],) for k in chosen], "gram string")
    return keys.join(rows, "gram", "left").groupBy("gram").agg(F.count("rec_id").alias("df"))


# -- workload reduction -----------------------------------------------------------------------------------------


def reduced_size(n_queries: int, fraction: float) -> int:
    """How many queries a fraction stands for: ten at least, and no more than there are."""
    return min(max(int(fraction * n_queries), 10), n_queries)


def distances(literals: list[list[str]], counts: dict[str, int], measure: int = 2) -> np.ndarray:
    """Pairwise distances of queries over the weighted sets of all their substrings.

    The weight of what two queries don't share, divided by one more than the
    weight of what they share (1), of what the second one has (2), or by
    nothing (3).  The lower triangle mirrors the upper one.
    """
    sets = [substrings_of(lits) for lits in literals]
    grams = {g: k for k, g in enumerate(sorted(set().union(*sets)))} if sets else {}
    weight = np.array([counts[g] for g in grams], float)
    member = np.zeros((len(sets), len(grams)), bool)
    for q, s in enumerate(sets):
        member[q, [grams[g] for g in s]] = True
    shared = (member * weight) @ member.T if len(grams) else np.zeros((len(sets), len(sets)))
    own = member @ weight if len(grams) else np.zeros(len(sets))
    apart = own[:, None] + own[None, :] - 2 * shared
    d = apart / (1 + shared) if measure == 1 else apart / (1 + own[None, :]) if measure == 2 else apart
    upper = np.triu(d)
    return upper + np.triu(d, 1).T


def distance_table(sets: DataFrame, weights: DataFrame) -> DataFrame:
    """``(q1, q2, d1, d2, d3)`` for ``q1 <= q2`` of ``sets(query_id, gram)`` and ``weights(gram, weight)``, relationally.

    All pairs of a query set are the result itself; what they share comes from
    a join on the gram.
    """
    weighted = sets.distinct().join(weights, "gram")
    own = sets.select("query_id").distinct().join(weighted.groupBy("query_id").agg(F.sum("weight").alias("w")), "query_id", "left").select("query_id", F.coalesce("w", F.lit(0)).cast("double").alias("w"))
    a = weighted.select(F.col("query_id").alias("q1"), "gram", "weight")
    b = weighted.select(F.col("query_id").alias("q2"), "gram")
    shared = a.join(b, "gram").filter("q1 <= q2").groupBy("q1", "q2").agg(F.sum("weight").cast("double").alias("s"))
    pairs = own.select(F.col("query_id").alias("q1"), F.col("w").alias("w1")).crossJoin(own.select(F.col("query_id").alias("q2"), F.col("w").alias("w2"))).filter("q1 <= q2")
    full = pairs.join(shared, ["q1", "q2"], "left").withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("apart", F.expr("w1 + w2 - 2 * s"))
    return full.selectExpr("q1", "q2", "apart / (1 + s) as d1", "apart / (1 + w2) as d2", "apart as d3")


def k_medians(d: np.ndarray, k: int, rounds: int = 100, seed: int = 0) -> dict[int, list[int]]:
    """Medoid query -> members.  The seed draws the first medoids and refills clusters that became empty; ties go to the first."""
    n = len(d)
    k = min(k, n)
    rng = np.random.default_rng(seed)
    medoids = sorted(rng.choice(n, k, replace=False).tolist())
    clusters: dict[int, list[int]] = {}
    for _ in range(rounds):
        nearest = d[:, medoids].argmin(axis=1) if k else np.zeros(0, int)
        members = [np.flatnonzero(nearest == m).tolist() for m in range(k)]
        clusters = {m: own for m, own in zip(medoids, members) if own}
        new = [own[int(d[np.ix_(own, own)].sum(axis=1).argmin())] for own in members if own]
        free = sorted(set(range(n)) - set(new))
        while len(new) < k and free:
            new.append(free.pop(int(rng.integers(len(free)))))
        if sorted(new) == medoids:
            break
        medoids = sorted(new)
    return clusters


def reduced(literals: list[list[str]], counts: dict[str, int], k: int, measure: int = 2, seed: int = 0) -> list[list[str]]:
    """The literals of ``k`` representative queries."""
    return [literals[q] for q in sorted(k_medians(distances(literals, counts, measure), k, seed=seed))]


def parallel_best_keys(corpus: DataFrame, patterns: list[str], jobs: int, c: float = 0.1, most: int | None = None, distance: int = 2, mode: str = "sound", seed: int = 0) -> DataFrame:
    """Keys chosen for clusters of queries independently and united; each cluster counts only the records its own candidates are in."""
    literals = query_literals(patterns, mode)
    groups = [[q] for q in range(len(patterns))] if jobs >= len(patterns) else list(k_medians(distances(literals, gram_counts(corpus, literals), distance), jobs, seed=seed).values())
    out = None
    for group in groups:
        keys = best_keys(corpus, [patterns[q] for q in group], c, most, mode=mode)
        out = keys if out is None else out.unionByName(keys)
    return key_table(corpus.sparkSession, {}) if out is None else out.dropDuplicates(["gram"])
