"""How many records contain a match of each regular expression, with or without an index.

A query set is a parameter: its patterns are read to the driver (at most
``MOST_QUERIES``), parsed there, and all are evaluated in one pass over the texts:

* the keys (or literals) that every match must contain are tested first, so
  that the regular expression runs on candidates only;
* up to ``FEW_PATTERNS`` patterns become column expressions (``contains`` and
  ``rlike``) that stay in the JVM.  More of them, or one that could exhaust the
  stack of Java's matcher, run on Arrow batches: one automaton finds the
  strings of all patterns while it goes through a text once, whereas
  expressions would go through it once per pattern;
* a record gives one small code per candidate or match, and the codes are
  counted where they arise, so next to nothing is shuffled.

Equal patterns are evaluated once; invalid and null ones match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.functions import regex as rx
from gramforge.functions.grams import substrings
from gramforge.plans import boolean

MOST_QUERIES = 100_000
FEW_PATTERNS = 24

COUNTS = "pattern string, num_after_filter long, match_count long"


def patterns_of(queries: DataFrame, column: str = "pattern") -> list[str]:
    """The different non-null patterns of a query set in order; raises if it is no query set but a table of more than ``MOST_QUERIES``."""
    found = [r[0] for r in queries.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_QUERIES + 1).collect()]
    if len(found) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} different patterns: match them in blocks")
    return sorted(found)


def query_literals(patterns: list[str], mode: str = "sound") -> list[list[str]]:
    """The literals of each pattern."""
    return [rx.literals(p, mode) for p in patterns]


# -- keys of literals -------------------------------------------------------------------------------------------


def keys_in(literal: str, keys: set[str], lengths: list[int], shortest: bool = True) -> list[str]:
    """The keys that begin at each position of a literal, in order: the shortest one, or all of them."""
    found: dict[str, None] = {}
    for i in range(len(literal)):
        for k in lengths:
            if i + k <= len(literal) and literal[i : i + k] in keys:
                found[literal[i : i + k]] = None
                if shortest:
                    break
    return list(found)


def keys_among(keys: DataFrame, literals: list[str]) -> set[str]:
    """The keys of a (large) key table that occur in some literals.

    The substrings of the literals are joined to the keys; only keys that are
    such substrings come to the driver, bounded by the query set's characters.
    """
    spark, distinct = keys.sparkSession, sorted({x for x in literals if x})
    longest = keys.agg(F.max(F.length("gram"))).first()[0]
    if not distinct or longest is None:
        return set()
    most = min(longest, max(map(len, distinct)))
    wanted = spark.createDataFrame([(x,) for x in distinct], "literal string").select(F.explode(F.array_distinct(substrings(F.col("literal"), most))).alias("gram")).distinct()
    return {r.gram for r in keys.select("gram").join(wanted, "gram", "left_semi").toLocalIterator()}


def found_keys(keys: DataFrame, literals: DataFrame, shortest: bool = True) -> DataFrame:
    """``(query_id, gram)``: the keys found in ``literals(query_id, lit_no, literal)``, relationally, for literals of any number.

    At each position of a literal the shortest key counts, or (``shortest``
    false) every key.
    """
    longest = keys.agg(F.max(F.length("gram"))).first()[0] or 0
    at = literals.select("query_id", "lit_no", F.posexplode(F.split("literal", "")).alias("pos", "_"), "literal").filter("pos < length(literal)")
    pieces = at.select("query_id", "lit_no", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("literal") - F.col("pos")))).alias("k"), "literal")
    pieces = pieces.select("query_id", "lit_no", "pos", "k", F.expr("substring(literal, pos + 1, k)").alias("gram"))
    hits = pieces.join(keys.select("gram"), "gram")
    if shortest:
        hits = hits.groupBy("query_id", "lit_no", "pos").agg(F.min_by("gram", "k").alias("gram"))
    return hits.select("query_id", "gram").distinct()


def literal_table(spark, queries: list[tuple[int, str]], mode: str = "sound") -> DataFrame:
    """``(query_id, lit_no, literal)`` of numbered patterns."""
    rows = [(q, n, x) for q, p in queries for n, x in enumerate(rx.literals(p, mode))]
    return spark.createDataFrame(rows, "query_id int, lit_no int, literal string")


def and_plans(patterns: list[str], keys: set[str], mode: str = "sound") -> dict[str, tuple]:
    """The plan of each pattern as the AND of the keys of its literals; unrestricted if it has none."""
    lengths = sorted({len(k) for k in keys})
    return {p: boolean.conjunction(("key", k) for x in rx.literals(p, mode) for k in keys_in(x, keys, lengths)) for p in patterns}


def tree_plans(patterns: list[str], keys: set[str]) -> dict[str, tuple]:
    """The AND/OR plan of each pattern over the keys, choices included."""
    lengths = sorted({len(k) for k in keys})
    return {p: boolean.bounded(boolean.rewritten(boolean.plan(p), lambda x: keys_in(x, keys, lengths))) for p in patterns}


# -- one pass over the texts ------------------------------------------------------------------------------------


class Finder:
    """Which of many strings a text contains: one automaton for all of them where it is installed, else one search each."""

    def __init__(self, strings: set[str]) -> None:
        self.strings = strings
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for x in strings:
            self.automaton.add_word(x, x)
        if strings:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> set[str]:
        if self.automaton is None:
            return {x for x in self.strings if x in text}
        return {x for _, x in self.automaton.iter(text)} if self.strings else set()


def _holds(plan: tuple, has: set[str]) -> bool:
    if plan[0] in ("lit", "key"):
        return plan[1] in has
    return (all if plan[0] == "and" else any)(_holds(p, has) for p in plan[1]) if plan[0] in ("and", "or") else True


def _arrow_codes(jobs: list[tuple[int, str, tuple, tuple]], chosen: bool):
    """Codes of ``(number, expression, plan, what every match contains)``: ``2 * number`` for a candidate, one more for a match, -1 for a text.

    ``chosen``: the batches say in ``queries`` which patterns have the text as a candidate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = Finder({x for _, _, plan, need in jobs for x in boolean.literals(need) + ([] if chosen else boolean.literals(plan))})
        searches: dict[int, object] = {}  # compiled when a text first gets that far
        compiled = {n: (p, plan, need) for n, p, plan, need in jobs}
        # patterns by the rarest kind of evidence: those that need some string are only looked at when it is there
        by_string: dict[str, list[int]] = {}
        always: list[int] = []
        for n, (_, plan, need) in compiled.items():
            first = plan if plan != boolean.ALL else need
            strings = boolean.literals(first)
            if first == boolean.ALL:
                always.append(n)
            elif first[0] == "or":
                for x in strings:
                    by_string.setdefault(x, []).append(n)
            else:
                only = first if first[0] != "and" else max((p for p in first[1]), key=lambda p: (p[0] != "or", len(p[1])))
                for x in boolean.literals(only):
                    by_string.setdefault(x, []).append(n)
        for batch in batches:
            counts: dict[int, int] = {-1: batch.num_rows}
            queries = batch.column("queries").to_pylist() if chosen else None
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                has = find(text)
                numbers = queries[i] if chosen else [*always, *{n for x in has for n in by_string.get(x, ())}]
                for n in numbers:
                    expression, plan, need = compiled[n]
                    if chosen or _holds(plan, has):
                        found = _holds(need, has)
                        if found:
                            search = searches.get(n)
                            if search is None:
                                search = searches[n] = regex.compile(expression, regex.V0).search
                            found = search(text) is not None
                        code = 2 * n + found
                        if code % 2 or plan != boolean.ALL:
                            counts[code] = counts.get(code, 0) + 1
            yield pa.RecordBatch.from_pydict({"code": pa.array(list(counts), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _matches(pattern: str) -> Column:
    """Whether the text has a match: first what every match contains, then the expression itself."""
    need = boolean.plan(pattern)
    found = F.col("text").rlike(rx.to_java(pattern))
    return boolean.condition(need, lambda g: F.col("text").contains(F.lit(g))) & found if need != boolean.ALL else found


def _codes(texts: DataFrame, numbered: list[tuple[int, str]], plans: dict[str, tuple]) -> DataFrame:
    """``(code, n)`` of all patterns on ``texts(text)`` or ``texts(text, queries)``; -1 counts the texts."""
    chosen = "queries" in texts.columns
    if len(numbered) <= FEW_PATTERNS and not any(rx.is_deep(p) for _, p in numbered):
        columns = [F.lit(-1)]
        for n, p in numbered:
            candidate = F.array_contains("queries", n) if chosen else boolean.condition(plans[p], lambda g: F.col("text").contains(F.lit(g)))
            columns.append(F.when(_matches(p), 2 * n + 1) if plans[p] == boolean.ALL else F.when(candidate, F.when(_matches(p), 2 * n + 1).otherwise(2 * n)))
        return texts.select(F.explode(F.array_compact(F.array(*columns))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    jobs = [(n, rx.to_python(p), plans[p], boolean.plan(p)) for n, p in numbered]
    return texts.mapInArrow(_arrow_codes(jobs, chosen), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _counted(codes: DataFrame, records: DataFrame | None, numbered: list[tuple[int, str]], plans: dict[str, tuple], invalid: list[str]) -> DataFrame:
    """``COUNTS`` of codes; ``records`` (code -1 only) gives the size of the corpus for patterns without restriction."""
    spark = codes.sparkSession
    rows = [(n, p, -1 if plans[p] == boolean.ALL else None) for n, p in numbered] + [(None, p, -1) for p in invalid]
    queries = spark.createDataFrame(rows, "no int, pattern string, whole int")
    halves = codes.filter("code >= 0").groupBy(F.floor(F.col("code") / 2).cast("int").alias("no")).agg(F.sum("n").alias("candidates"), F.sum(F.expr("if(code % 2 = 1, n, 0)")).alias("matches"))
    whole = (records if records is not None else codes).filter("code = -1").groupBy(F.col("code").alias("whole")).agg(F.sum("n").alias("size"))
    joined = queries.join(halves, "no", "left").join(whole, "whole", "left")
    n_after = F.when(F.col("whole").isNull(), F.coalesce("candidates", F.lit(0))).otherwise(F.coalesce("size", F.lit(0)))
    return joined.select("pattern", n_after.cast("long").alias("num_after_filter"), F.coalesce("matches", F.lit(0)).cast("long").alias("match_count"))


def _numbered(patterns: list[str]) -> tuple[list[tuple[int, str]], list[str]]:
    distinct = list(dict.fromkeys(patterns))
    return [(n, p) for n, p in enumerate(distinct) if rx.is_valid(p)], [p for p in distinct if not rx.is_valid(p)]


def scan_counts(corpus: DataFrame, patterns: list[str], plans: dict[str, tuple] | None = None) -> DataFrame:
    """``(pattern, num_after_filter, match_count)`` in one pass over ``corpus(rec_id, text)``.

    ``plans`` restricts patterns to candidate records; the keys of a plan are
    tested on the text itself, which selects the same records as their posting
    lists do, without an index.  Without a plan every record is a candidate.
    """
    numbered, invalid = _numbered(patterns)
    plans = {p: (plans or {}).get(p, boolean.ALL) for _, p in numbered}
    codes = _codes(corpus.select("text"), numbered, plans)
    return _counted(codes, None, numbered, plans, invalid)


# -- through posting lists --------------------------------------------------------------------------------------


def candidates(rows: DataFrame, plans: dict[int, tuple]) -> DataFrame:
    """``(rec_id, no)``: the records whose posting rows fulfil the plan of query ``no``.

    Relational division: a plan is an OR of clauses, a clause an AND of keys,
    and a record fulfils a clause if it has as many of its keys as there are.
    Only the postings of the plans' keys are read, and they are grouped by
    record and clause, so the size of a single list doesn't matter.
    """
    clauses = [(q, keys) for q, p in plans.items() if p != boolean.ALL for keys in boolean.clauses(p)]
    wanted = rows.sparkSession.createDataFrame([(k, c, len(keys)) for c, (_, keys) in enumerate(clauses) for k in keys], "gram string, clause int, n_keys int")
    owners = rows.sparkSession.createDataFrame([(c, q) for c, (q, _) in enumerate(clauses)], "clause int, no int")
    full = rows.join(wanted, "gram").groupBy("rec_id", "clause", "n_keys").agg(F.count(F.lit(1)).alias("n")).filter("n = n_keys")
    return full.join(owners, "clause").select("rec_id", "no").distinct()


def index_counts(corpus: DataFrame, rows: DataFrame, patterns: list[str], plans: dict[str, tuple]) -> DataFrame:
    """The same counts through ``postings(gram, rec_id)``: candidates from the lists, then only their texts are read and verified.

    Patterns that the index doesn't help go through :func:`scan_counts`.
    """
    numbered, invalid = _numbered(patterns)
    helped = [(n, p) for n, p in numbered if plans.get(p, boolean.ALL) != boolean.ALL]
    others = [p for _, p in numbered if plans.get(p, boolean.ALL) == boolean.ALL] + invalid
    out = None
    if helped:
        found = candidates(rows, {n: plans[p] for n, p in helped})
        texts = corpus.join(found.groupBy("rec_id").agg(F.collect_set("no").alias("queries")), "rec_id").select("text", "queries")
        own = {p: plans[p] for _, p in helped}
        codes = _codes(texts, helped, own)
        out = _counted(codes, None, helped, own, [])
    if others or not helped:
        rest = scan_counts(corpus, others)
        out = rest if out is None else out.unionByName(rest)
    return out


def candidate_counts(rows: DataFrame, patterns: list[str], plans: dict[str, tuple]) -> DataFrame:
    """``(pattern, num_candidates)`` of the patterns that the lists help, without reading a text."""
    numbered = [(n, p) for n, p in _numbered(patterns)[0] if plans[p] != boolean.ALL]
    found = candidates(rows, {n: plans[p] for n, p in numbered}).groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame(numbered, "no int, pattern string")
    return names.join(found, "no", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("num_candidates"))


def with_query_ids(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """``(query_id, pattern, num_after_filter, match_count)`` for every query, equal patterns and null ones included."""
    return queries.select("query_id", "pattern").join(counts, "pattern", "left").select("query_id", "pattern", F.coalesce("num_after_filter", F.lit(0)).alias("num_after_filter"), F.coalesce("match_count", F.lit(0)).alias("match_count"))
