"""Queries of the search engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge import engine
from gramforge.functions import grams, regex
from gramforge.operators import match, postings
from gramforge.operators.selectors import best, free, lpms, trigram, vggraph, vgopt
from gramforge.plans import boolean
from gramforge.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return grams.corpus(table(spark, d, "documents"), "doc_id", "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return grams.lines(_docs(spark, d))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return grams.corpus(table(spark, d, "part"), "p_partkey", "p_name")


def _patterns(spark: SparkSession, d: str) -> list[str]:
    return match.patterns_of(table(spark, d, "queries"))


def _with_precision(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", F.try_divide(F.col("match_count").cast("double"), "num_after_filter"))


# -- matching ---------------------------------------------------------------------------------------------------


def match_all_documents(spark: SparkSession, d: str) -> DataFrame:
    """Full scan: every pattern over every document."""
    queries = table(spark, d, "queries")
    return match.with_query_ids(queries, match.scan_counts(_docs(spark, d), match.patterns_of(queries))).select("query_id", "match_count")


def match_all_lines(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(_lines(spark, d), _patterns(spark, d)).select("pattern", "match_count")


def match_one_pattern(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(_docs(spark, d), ["(ERROR|WARN)(.+)(=|/)([0-9a-f]+)"])


# Patterns that the two engines read differently unless they are translated.
DIALECT = [r"a\.$", r"\s\S+\z", r"[[]", r"(?i)subject: .*a(?-i:b)", r"[[:^digit:]]{3}[[:digit:]]{2}", r"[\pL]{12}", r"\p{Greek}", r"x{,2}", r"a&&b", r"\Q(a\E+", r"(?s)From.*Subject", r"(?m)^To: ", r"\bthe\b.\bof\b", r"[^\x00-\x7f]é", r"a{2}e|o{2}k$"]


def match_dialect(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(_docs(spark, d), DIALECT).select("pattern", "match_count")


def match_part_names(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(_parts(spark, d), PART_PATTERNS).select("pattern", "match_count")


PART_PATTERNS = ["^[a-z]+ ", "(re|ho)d?", "small(.*)bolt", "[xyz]", "gear", "(.)(.)l{2}", "old ring"]


def match_event_props(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(grams.corpus(table(spark, d, "events"), "event_id", "props"), ['"k": ?[0-9]*7', "[13579]}$", "(a|b|c)+"]).select("pattern", "match_count")


def filtered_by_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Trigram index: candidates, matches, precision; the keys are tested while the texts are read."""
    return _with_precision(engine.build(_docs(spark, d), None, "TRIGRAM").match(_patterns(spark, d)))


def filtered_by_posting_lists(spark: SparkSession, d: str) -> DataFrame:
    """The same through posting lists."""
    return _with_precision(engine.build(_docs(spark, d), None, "TRIGRAM").match(_patterns(spark, d), through="postings"))


def filtered_by_free(spark: SparkSession, d: str) -> DataFrame:
    return _with_precision(engine.build(_docs(spark, d), None, "FREE", c=0.1, upper_n=3).match(_patterns(spark, d)))


def filtered_by_free_presuf(spark: SparkSession, d: str) -> DataFrame:
    return engine.build(_docs(spark, d), None, "FREE", c=0.1, upper_n=4, presuf="sound").match(_patterns(spark, d)).select("pattern", "match_count")


def filtered_by_best(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    return engine.build(_docs(spark, d), patterns, "BEST", c=0.1).match(patterns).select("pattern", "match_count")


def filtered_by_lpms(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    return engine.build(_docs(spark, d), patterns, "LPMS", scope="queries").match(patterns).select("pattern", "match_count")


def filtered_by_vggraph(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    return engine.build(_docs(spark, d), patterns, "VGGRAPH", c=0.1, upper_n=4).match(patterns, trees=True).select("pattern", "match_count")


# Patterns whose choices only an AND/OR plan can use, and their plans over the keys.
CHOICES = "(Subject|From)(.*)(price|water)"
CHOICE_KEYS = ["Sub", "Fro", "pri", "wat"]


def planned_choices(spark: SparkSession, d: str) -> DataFrame:
    index = engine.manual(_docs(spark, d), CHOICE_KEYS)
    return index.match([CHOICES], through="postings", trees=True)


# -- grams and lists --------------------------------------------------------------------------------------------


def gram_frequency_1(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_frequency(grams.exploded(_docs(spark, d), [1]))


def gram_frequency_2(spark: SparkSession, d: str) -> DataFrame:
    return postings.document_frequency(grams.exploded(_docs(spark, d), [2]))


def trigram_frequency(spark: SparkSession, d: str) -> DataFrame:
    return trigram.trigram_keys(_docs(spark, d))


def trigram_sample(spark: SparkSession, d: str) -> DataFrame:
    return trigram.trigram_keys(_docs(spark, d), 500, seed=7)


def free_keys(spark: SparkSession, d: str) -> DataFrame:
    return free.free_keys(_docs(spark, d), 0.1, 3)


def free_keys_of_lines(spark: SparkSession, d: str) -> DataFrame:
    return free.free_keys(_lines(spark, d), 0.05, 3)


def free_keys_bounded(spark: SparkSession, d: str) -> DataFrame:
    return free.free_keys(_docs(spark, d), 0.1, 3, most=200)


def free_presuf(spark: SparkSession, d: str) -> DataFrame:
    return free.without_suffixes(free.free_keys(_docs(spark, d), 0.1, 3))


def free_presuf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return free.presuf_shell(free.free_keys(_docs(spark, d), 0.1, 3))


def free_index_size(spark: SparkSession, d: str) -> DataFrame:
    return engine.build(_docs(spark, d), None, "FREE", c=0.1, upper_n=3).size()


def _part_postings(spark: SparkSession, d: str) -> DataFrame:
    return grams.exploded(_parts(spark, d), [2])


def part_postings(spark: SparkSession, d: str) -> DataFrame:
    return _part_postings(spark, d)


def postings_packed(spark: SparkSession, d: str) -> DataFrame:
    return postings.packed(_part_postings(spark, d), 500).select("gram", "block_no", "n", F.array_join(F.transform("rec_ids", lambda x: x.cast("string")), ",").alias("ids"))


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    return postings.lookup(_part_postings(spark, d), "ed")


def postings_and(spark: SparkSession, d: str) -> DataFrame:
    return postings.in_all(_part_postings(spark, d), ["ed", "bo"])


def postings_or(spark: SparkSession, d: str) -> DataFrame:
    return postings.in_any(_part_postings(spark, d), ["ed", "bo", "zz"])


def postings_minus(spark: SparkSession, d: str) -> DataFrame:
    return postings.in_first_only(_part_postings(spark, d), "ed", "bo")


def postings_xor(spark: SparkSession, d: str) -> DataFrame:
    return postings.in_one_only(_part_postings(spark, d), "ed", "bo")


def postings_member(spark: SparkSession, d: str) -> DataFrame:
    return postings.is_member(_parts(spark, d), _part_postings(spark, d), "re").select("rec_id")


def key_seek(spark: SparkSession, d: str) -> DataFrame:
    return postings.seek(_part_postings(spark, d).select("gram").distinct(), "m", 25)


def key_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """The raw feed's own table as an index: lists of ``postings``, records and size of each gram."""
    rows = table(spark, d, "postings").filter("gram is not null").select("gram", "rec_id").distinct()
    return postings.document_frequency(rows).select("gram", "df", postings.size_model(F.octet_length("gram"), F.col("df")).cast("long").alias("bytes"))


def found_keys(spark: SparkSession, d: str) -> DataFrame:
    """Shortest key at each position of the queries' literals, relationally, over the keys of the raw feed."""
    queries = [(r.query_id, r.pattern) for r in table(spark, d, "queries").collect()]
    keys = table(spark, d, "postings").filter("gram is not null and length(gram) >= 2").select("gram").distinct()
    return match.found_keys(keys, match.literal_table(spark, queries))


# -- selection by queries ---------------------------------------------------------------------------------------


def best_gram_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = best.gram_counts(_docs(spark, d), BEST_LITERALS)
    return spark.createDataFrame(sorted(counts.items()), "gram string, n long")


# Literals of three queries.
BEST_LITERALS = [["scanner", "equipment"], ["Subject: ", "answer"], ["ERROR"]]


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return spark.createDataFrame([(g,) for g in best.candidates(best.gram_counts(docs, BEST_LITERALS), docs.count(), 0.5)], "gram string")


def best_keys(spark: SparkSession, d: str) -> DataFrame:
    return best.best_keys(_docs(spark, d), _patterns(spark, d), 0.1)


def best_keys_reduced(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    return best.best_keys(_docs(spark, d), patterns, 0.1, most=100, reduced_to=best.reduced_size(len(patterns), 0.1))


def best_keys_of_clusters(spark: SparkSession, d: str) -> DataFrame:
    return best.parallel_best_keys(_parts(spark, d), PART_PATTERNS, 2, 0.2)


def best_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of part types over their trigrams, weighted by the trigrams' counts."""
    types = table(spark, d, "part").select(F.col("p_type").alias("text")).distinct().select(F.col("text").alias("query_id"), "text")
    sets = types.select("query_id", F.explode(grams.grams(F.col("text"), 3)).alias("gram"))
    weights = grams.exploded(grams.corpus(table(spark, d, "part"), "p_partkey", "p_type"), [3], distinct=False).groupBy("gram").agg(F.count(F.lit(1)).alias("weight"))
    found = best.distance_table(sets, weights)
    return found.select("q1", "q2", *(F.round(c, 6).alias(c) for c in ("d1", "d2", "d3")))


def lpms_keys(spark: SparkSession, d: str) -> DataFrame:
    return lpms.lpms_keys(_docs(spark, d), _patterns(spark, d), scope="queries")


def lpms_keys_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """With the threshold over all grams of each level."""
    return lpms.lpms_keys(_lines(spark, d), ["scanner(s?)( of | for )", "ERROR(.+)ferry", "Subject: (.*)answer"])


def vggraph_keys(spark: SparkSession, d: str) -> DataFrame:
    return vggraph.vggraph_keys(_docs(spark, d), _patterns(spark, d), 0.1, 4)


def vggraph_all_selectable(spark: SparkSession, d: str) -> DataFrame:
    return vggraph.vggraph_keys(_parts(spark, d), None, 0.02, 3)


def vggraph_until_selective(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return vggraph.until_selective(parts, int(0.05 * parts.count()), 4)


def vggraph_threshold(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(vggraph.threshold(_docs(spark, d), -1.0),)], "tau long")


def jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    return vgopt.jaccard_edges(vgopt.vertices(_parts(spark, d), 2), 0.1).select("g1", "g2", F.round("jaccard", 9).alias("jaccard"))


def graph_centrality(spark: SparkSession, d: str) -> DataFrame:
    sets, n = vgopt.gram_sets(vgopt.vertices(_parts(spark, d), 2)), _parts(spark, d).count()
    found = vgopt.centrality(sets, vgopt.jaccard_edges(sets), n)
    return found.select("gram", "df", "degree", *(F.round(c, 9).alias(c) for c in ("selectivity", "centrality")))


def vgopt_keys(spark: SparkSession, d: str) -> DataFrame:
    return vgopt.vgopt_keys(_parts(spark, d), 0.3, 2)


def graph_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the records that the rare bigrams cover, and whether it is enough."""
    rows, n = _part_postings(spark, d), _parts(spark, d).count()
    rare = postings.document_frequency(rows).filter(F.col("df") <= 0.05 * n)
    share = vgopt.coverage(rows, rare, n)
    return spark.createDataFrame([(round(share, 9), share >= 0.8)], "coverage double, sufficient boolean")


# -- rewriting --------------------------------------------------------------------------------------------------

# Motifs in the PROSITE notation.
MOTIFS = ["[AC]-x-V-x(4)-{ED}.", "<A-x-[ST](2)-x(0,1)-V", "K-x(2)-[RL]>", "W-P-Q-E-F-x(1,3)-A"]


def motif_patterns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m, regex.prosite_to_regex(m)) for m in MOTIFS], "motif string, pattern string")


def motif_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.scan_counts(_lines(spark, d), [regex.prosite_to_regex(m) for m in MOTIFS]).select("pattern", "match_count")


def pattern_plans(spark: SparkSession, d: str) -> DataFrame:
    """The plan of each pattern over its literals, as text."""
    return spark.createDataFrame([(p, boolean.shown(boolean.plan(p))) for p in _patterns(spark, d)], "pattern string, plan string")


QUERIES = {f.__name__: f for f in (
    match_all_documents, match_all_lines, match_one_pattern, match_dialect, match_part_names, match_event_props, filtered_by_trigrams, filtered_by_posting_lists, filtered_by_free, filtered_by_free_presuf,
    filtered_by_best, filtered_by_lpms, filtered_by_vggraph, planned_choices, gram_frequency_1, gram_frequency_2, trigram_frequency, trigram_sample, free_keys, free_keys_of_lines, free_keys_bounded, free_presuf,
    free_presuf_neighbours, free_index_size, part_postings, postings_packed, postings_lookup, postings_and, postings_or, postings_minus, postings_xor, postings_member, key_seek, key_table_rows, found_keys,
    best_gram_counts, best_candidates, best_keys, best_keys_reduced, best_keys_of_clusters, best_distances, lpms_keys, lpms_keys_of_lines, vggraph_keys, vggraph_all_selectable, vggraph_until_selective,
    vggraph_threshold, jaccard_edges, graph_centrality, vgopt_keys, graph_coverage, motif_patterns, motif_matches, pattern_plans,
)}


# -- SQL --------------------------------------------------------------------------------------------------------


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(patterns: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({_text(p)})" for p in patterns) + ") AS q(pattern)"


def _counts(corpus: str, patterns: str, columns: str = "pattern, count(*) FILTER (regexp_matches(text, pattern)) AS match_count") -> str:
    return f"SELECT {columns} FROM {corpus} CROSS JOIN {patterns} GROUP BY pattern"


_DOCS = "(SELECT doc_id AS rec_id, text FROM documents WHERE text IS NOT NULL)"
_LINES = "(SELECT (doc_id << 24) | (i - 1) AS rec_id, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))"
_PARTS = "(SELECT p_partkey AS rec_id, p_name AS text FROM part WHERE p_name IS NOT NULL)"


def _grams(corpus: str, k: int, distinct: bool = True) -> str:
    """``(rec_id, gram)`` of the k-grams: the characters side by side with those after them, so a text is gone through once."""
    made = f"list_transform(list_zip({', '.join(f'c[{i + 1}:len(c) - {k - 1 - i}]' for i in range(k))}), lambda x: {' || '.join(f'x[{i + 1}]' for i in range(k))})" if k > 1 else "c"
    return f"(SELECT rec_id, unnest({'list_distinct(' + made + ')' if distinct else made}) AS gram FROM (SELECT rec_id, string_split(text, '') AS c, text FROM {corpus}) WHERE len(c) >= {k} AND text <> '')"


def _df(corpus: str, k: int) -> str:
    return f"(SELECT gram, count(*) AS df FROM {_grams(corpus, k)} GROUP BY gram)"


def _free(corpus: str, c: float) -> str:
    """CTEs of the keys of up to three characters."""
    two = f"(SELECT * FROM {corpus} WHERE length(text) >= 2)"
    return f"""n AS (SELECT count(*)::DOUBLE AS n FROM {corpus}), l1 AS (SELECT * FROM {_df(two, 1)}), l2 AS (SELECT * FROM {_df(two, 2)}), l3 AS (SELECT * FROM {_df(corpus, 3)}),
 e1 AS (SELECT gram FROM l1, n WHERE df / n > {c}), k2 AS (SELECT l2.* FROM l2 JOIN e1 ON e1.gram = l2.gram[1:1]),
 e2 AS (SELECT gram FROM k2, n WHERE df / n > {c}), k3 AS (SELECT l3.* FROM l3 JOIN e2 ON e2.gram = l3.gram[1:2]),
 keys AS (SELECT gram, df FROM (SELECT * FROM l1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3), n WHERE df / n <= {c})"""


def _keep_in_all(grams: list[str]) -> str:
    return f"SELECT rec_id FROM {_grams(_PARTS, 2)} WHERE gram IN ({', '.join(map(_text, grams))})"


def _literal_table() -> str:
    """Literals of the queries' pattern families by the position of their groups: what stands outside brackets."""
    return """(SELECT query_id, unnest(string_split(regexp_replace(regexp_replace(pattern, '\\([^()]*\\)[*+?]?', chr(1), 'g'), '\\([^()]*\\)[*+?]?', chr(1), 'g'), chr(1))) AS literal FROM queries)"""


_BEST_GRAMS = "(SELECT DISTINCT w[i:j] AS gram FROM (VALUES " + ", ".join(f"({_text(x)})" for lits in BEST_LITERALS for x in lits) + ") AS v(w), range(1, 21) AS a(i), range(1, 21) AS b(j) WHERE i <= j AND j <= length(w))"
_BEST_COUNTS = f"(SELECT g.gram, coalesce(sum(n), 0)::BIGINT AS n FROM {_BEST_GRAMS} g LEFT JOIN (" + " UNION ALL ".join(f"SELECT gram, count(*) AS n FROM {_grams(_DOCS, k, False)} GROUP BY gram" for k in range(1, 10)) + ") c ON c.gram = g.gram GROUP BY g.gram)"
_PAIRS = f"""v AS (SELECT DISTINCT * FROM (SELECT * FROM {_grams(_PARTS, 1)} UNION ALL SELECT * FROM {_grams(_PARTS, 2)})), s AS (SELECT gram, count(*) AS df FROM v GROUP BY gram),
 b AS (SELECT x.gram AS g1, y.gram AS g2, count(*) AS shared FROM v x JOIN v y ON x.rec_id = y.rec_id AND x.gram < y.gram GROUP BY ALL),
 e AS (SELECT g1, g2, shared::DOUBLE / (s1.df + s2.df - shared) AS jaccard FROM b JOIN s s1 ON s1.gram = g1 JOIN s s2 ON s2.gram = g2 WHERE shared::DOUBLE / (s1.df + s2.df - shared) > 0.1)"""
_TYPES = f"""t AS (SELECT DISTINCT p_type AS query_id FROM part WHERE p_type IS NOT NULL), w AS (SELECT gram, count(*) AS weight FROM {_grams("(SELECT p_partkey AS rec_id, p_type AS text FROM part WHERE p_type IS NOT NULL)", 3, False)} GROUP BY gram),
 g AS (SELECT rec_id AS query_id, gram, weight FROM {_grams("(SELECT query_id AS rec_id, query_id AS text FROM t)", 3)} JOIN w USING (gram)),
 o AS (SELECT query_id, coalesce(sum(weight), 0)::DOUBLE AS w FROM t LEFT JOIN g USING (query_id) GROUP BY query_id),
 i AS (SELECT a.query_id AS q1, b.query_id AS q2, sum(a.weight)::DOUBLE AS s FROM g a JOIN g b ON a.gram = b.gram GROUP BY ALL),
 p AS (SELECT a.query_id AS q1, b.query_id AS q2, a.w AS w1, b.w AS w2, coalesce(s, 0) AS s FROM o a JOIN o b ON a.query_id <= b.query_id LEFT JOIN i ON i.q1 = a.query_id AND i.q2 = b.query_id)"""

_ALL_DOCS = _counts(_DOCS, "(SELECT DISTINCT pattern FROM queries WHERE pattern IS NOT NULL)")


def _filtered(known: str, postings: str) -> str:
    """CTEs from the keys of each query, ``known(query_id, gram)``, and their records, ``g(rec_id, gram)``, to the counts of each pattern."""
    return f"""known AS ({known}), g AS ({postings}), need AS (SELECT query_id, count(*) AS n FROM known GROUP BY query_id),
 cand AS (SELECT query_id, rec_id FROM known JOIN g USING (gram) JOIN need USING (query_id) GROUP BY query_id, rec_id, n HAVING count(*) = n),
 cc AS (SELECT query_id, count(*) AS c FROM cand GROUP BY query_id), m AS ({_counts(_DOCS, "(SELECT DISTINCT pattern FROM queries)")}),
 f AS (SELECT q.pattern, CASE WHEN need.n IS NULL THEN (SELECT count(*) FROM {_DOCS}) ELSE coalesce(c, 0) END::BIGINT AS num_after_filter, match_count
       FROM (SELECT min(query_id) AS query_id, pattern FROM queries GROUP BY pattern) q JOIN m ON m.pattern = q.pattern LEFT JOIN need ON need.query_id = q.query_id LEFT JOIN cc ON cc.query_id = q.query_id)
 SELECT *, CASE WHEN num_after_filter > 0 THEN match_count::DOUBLE / num_after_filter END AS precision FROM f"""


_TRIGRAM_CANDIDATES = f"""WITH lit AS (SELECT query_id, literal FROM {_literal_table()} WHERE length(literal) >= 3), t AS (SELECT DISTINCT rec_id, gram FROM {_grams(_DOCS, 3)}),
 pieces AS (SELECT DISTINCT query_id, literal[i:i + 2] AS gram FROM lit, range(1, 60) AS r(i) WHERE i <= length(literal) - 2),
 {_filtered("SELECT * FROM pieces WHERE gram IN (SELECT gram FROM t)", "SELECT * FROM t WHERE gram IN (SELECT gram FROM pieces)")}"""
_FREE_CANDIDATES = f"""WITH {_free(_DOCS, 0.1)}, lit AS (SELECT query_id, row_number() OVER () AS lit_no, literal FROM {_literal_table()}),
 hits AS (SELECT query_id, lit_no, i, arg_min(gram, length(gram)) AS gram FROM lit, range(1, 60) AS r(i) JOIN keys ON starts_with(literal[i:], gram) WHERE i <= length(literal) GROUP BY ALL),
 {_filtered("SELECT DISTINCT query_id, gram FROM hits", f"SELECT * FROM (SELECT * FROM {_grams(_DOCS, 1)} UNION ALL SELECT * FROM {_grams(_DOCS, 2)} UNION ALL SELECT * FROM {_grams(_DOCS, 3)}) WHERE gram IN (SELECT gram FROM hits)")}"""


def _motif(m: str) -> str:
    """PROSITE notation rewritten by SQL's own replacements."""
    s = f"rtrim({_text(m)}, '.')"
    for old, new in (("-", ""), ("x", "."), ("{", "[^"), ("}", "]"), ("(", "{"), (")", "}"), ("<", "^"), (">", "$")):
        s = f"replace({s}, '{old}', '{new}')"
    return s


SQL = {
    "match_all_documents": f"SELECT query_id, match_count FROM queries JOIN ({_ALL_DOCS}) USING (pattern)",
    "match_all_lines": _counts(_LINES, "(SELECT DISTINCT pattern FROM queries)"),
    "match_one_pattern": _counts(_DOCS, _values(["(ERROR|WARN)(.+)(=|/)([0-9a-f]+)"]), "pattern, count(*) AS num_after_filter, count(*) FILTER (regexp_matches(text, pattern)) AS match_count"),
    "match_dialect": " UNION ALL ".join(f"SELECT {_text(p)} AS pattern, count(*) FILTER (regexp_matches(text, {_text(p)})) AS match_count FROM {_DOCS}" for p in DIALECT),
    "match_part_names": _counts(_PARTS, _values(PART_PATTERNS)),
    "match_event_props": _counts("(SELECT props AS text FROM events WHERE props IS NOT NULL)", _values(['"k": ?[0-9]*7', "[13579]}$", "(a|b|c)+"])),
    "filtered_by_trigrams": _TRIGRAM_CANDIDATES,
    "filtered_by_posting_lists": _TRIGRAM_CANDIDATES,
    "filtered_by_free": _FREE_CANDIDATES,
    "filtered_by_free_presuf": _ALL_DOCS, "filtered_by_best": _ALL_DOCS, "filtered_by_lpms": _ALL_DOCS, "filtered_by_vggraph": _ALL_DOCS,
    "planned_choices": f"SELECT {_text(CHOICES)} AS pattern, count(*) FILTER ((contains(text, 'Sub') OR contains(text, 'Fro')) AND (contains(text, 'pri') OR contains(text, 'wat'))) AS num_after_filter, count(*) FILTER (regexp_matches(text, {_text(CHOICES)})) AS match_count FROM {_DOCS}",
    "gram_frequency_1": f"SELECT * FROM {_df(_DOCS, 1)}", "gram_frequency_2": f"SELECT * FROM {_df(_DOCS, 2)}", "trigram_frequency": f"SELECT * FROM {_df(_DOCS, 3)}",
    "free_keys": f"WITH {_free(_DOCS, 0.1)} SELECT * FROM keys",
    "free_keys_of_lines": f"WITH {_free(_LINES, 0.05)} SELECT * FROM keys",
    "free_keys_bounded": f"WITH {_free(_DOCS, 0.1)} SELECT * FROM keys ORDER BY length(gram), gram LIMIT 200",
    "free_presuf": f"WITH {_free(_DOCS, 0.1)} SELECT * FROM keys k WHERE NOT EXISTS (SELECT 1 FROM keys s WHERE length(s.gram) < length(k.gram) AND s.gram IN (k.gram[2:], k.gram[3:]))",
    "free_presuf_neighbours": f"WITH {_free(_DOCS, 0.1)}, r AS (SELECT gram, df, reverse(gram) AS rev, lag(reverse(gram)) OVER (ORDER BY reverse(gram)) AS before FROM keys) SELECT gram, df FROM r WHERE before IS NULL OR NOT starts_with(rev, before)",
    "free_index_size": f"WITH {_free(_DOCS, 0.1)}, p AS (SELECT gram, count(*) AS df FROM (SELECT * FROM {_grams(_DOCS, 1)} UNION ALL SELECT * FROM {_grams(_DOCS, 2)} UNION ALL SELECT * FROM {_grams(_DOCS, 3)}) WHERE gram IN (SELECT gram FROM keys) GROUP BY gram) SELECT count(*) AS num_keys, sum(df)::BIGINT AS num_postings, sum(2 * octet_length(encode(gram)) + 48 + 8 * df)::BIGINT AS index_size FROM p",
    "part_postings": f"SELECT rec_id, gram FROM {_grams(_PARTS, 2)}",
    "postings_packed": f"SELECT gram, rec_id // 500 AS block_no, count(*) AS n, string_agg(rec_id::VARCHAR, ',' ORDER BY rec_id) AS ids FROM {_grams(_PARTS, 2)} GROUP BY ALL",
    "postings_lookup": _keep_in_all(["an"]),
    "postings_and": f"{_keep_in_all(['ed'])} INTERSECT {_keep_in_all(['bo'])}",
    "postings_or": f"{_keep_in_all(['ed'])} UNION {_keep_in_all(['bo'])}",
    "postings_minus": f"{_keep_in_all(['ed'])} EXCEPT {_keep_in_all(['bo'])}",
    "postings_xor": f"(({_keep_in_all(['ed'])}) EXCEPT ({_keep_in_all(['bo'])})) UNION (({_keep_in_all(['bo'])}) EXCEPT ({_keep_in_all(['ed'])}))",
    "postings_member": "SELECT p_partkey AS rec_id FROM part WHERE contains(p_name, 're')",
    "key_seek": f"SELECT DISTINCT gram FROM {_grams(_PARTS, 2)} WHERE gram >= 'm' ORDER BY gram LIMIT 25",
    "key_table_rows": "SELECT gram, count(DISTINCT coalesce(rec_id, -1)) AS df, (2 * octet_length(encode(gram)) + 48 + 8 * count(DISTINCT coalesce(rec_id, -1)))::BIGINT AS bytes FROM postings WHERE gram IS NOT NULL GROUP BY gram",
    "found_keys": f"""WITH keys AS (SELECT DISTINCT gram FROM postings WHERE length(gram) >= 2), lit AS (SELECT query_id, row_number() OVER () AS lit_no, literal FROM {_literal_table()}),
 hits AS (SELECT query_id, lit_no, i, arg_min(gram, length(gram)) AS gram FROM lit, range(1, 60) AS r(i) JOIN keys ON starts_with(literal[i:], gram) WHERE i <= length(literal) GROUP BY ALL) SELECT DISTINCT query_id, gram FROM hits""",
    "best_gram_counts": f"SELECT * FROM {_BEST_COUNTS}",
    "best_candidates": f"WITH c AS (SELECT * FROM {_BEST_COUNTS}), t AS (SELECT floor(0.5 * count(*)) AS most FROM {_DOCS}) SELECT c.gram FROM c CROSS JOIN t LEFT JOIN c p ON p.gram = c.gram[1:length(c.gram) - 1] WHERE c.n <= most AND (length(c.gram) = 1 OR p.n > most)",
    "best_distances": f"WITH {_TYPES} SELECT q1, q2, round((w1 + w2 - 2 * s) / (1 + s), 6) AS d1, round((w1 + w2 - 2 * s) / (1 + w2), 6) AS d2, round(w1 + w2 - 2 * s, 6) AS d3 FROM p",
    "vggraph_all_selectable": f"WITH l AS (SELECT * FROM {_df(_PARTS, 2)} UNION ALL SELECT * FROM {_df(_PARTS, 3)}) SELECT * FROM l WHERE df <= floor(0.02 * (SELECT count(*) FROM {_PARTS}))",
    "vggraph_until_selective": f"""WITH t AS (SELECT floor(0.05 * count(*)) AS tau FROM {_PARTS}), l2 AS (SELECT * FROM {_df(_PARTS, 2)}), l3 AS (SELECT x.* FROM {_df(_PARTS, 3)} x JOIN l2 ON l2.gram = x.gram[1:2] WHERE l2.df > (SELECT tau FROM t)),
 l4 AS (SELECT x.* FROM {_df(_PARTS, 4)} x JOIN l3 ON l3.gram = x.gram[1:3] WHERE l3.df > (SELECT tau FROM t)) SELECT l.* FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l3) l, t WHERE df <= tau UNION ALL SELECT * FROM l4""",
    "vggraph_threshold": f"WITH s AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS i, count(*) OVER () AS n FROM {_df(_DOCS, 2)}) SELECT df::BIGINT AS tau FROM s WHERE i = floor(n * 0.8)",
    "jaccard_edges": f"WITH {_PAIRS} SELECT g1, g2, round(jaccard, 9) AS jaccard FROM e",
    "graph_centrality": f"WITH {_PAIRS}, n AS (SELECT count(*)::DOUBLE AS n FROM {_PARTS}), dg AS (SELECT gram, count(*) AS degree FROM (SELECT g1 AS gram FROM e UNION ALL SELECT g2 FROM e) GROUP BY gram) SELECT s.gram, df, coalesce(degree, 0) AS degree, round(df / n, 9) AS selectivity, round(coalesce(degree, 0) * (1 - df / n), 9) AS centrality FROM s CROSS JOIN n LEFT JOIN dg ON dg.gram = s.gram",
    "graph_coverage": f"WITH p AS (SELECT * FROM {_grams(_PARTS, 2)}), n AS (SELECT count(*)::DOUBLE AS n FROM {_PARTS}), r AS (SELECT gram FROM p GROUP BY gram HAVING count(*) <= 0.05 * (SELECT n FROM n)), c AS (SELECT count(DISTINCT rec_id) / (SELECT n FROM n) AS s FROM p WHERE gram IN (SELECT gram FROM r)) SELECT round(s, 9) AS coverage, s >= 0.8 AS sufficient FROM c",
    "motif_patterns": " UNION ALL ".join(f"SELECT {_text(m)} AS motif, {_motif(m)} AS pattern" for m in MOTIFS),
    "motif_matches": _counts(_LINES, "(" + " UNION ALL ".join(f"SELECT {_motif(m)} AS pattern" for m in MOTIFS) + ")"),
}
