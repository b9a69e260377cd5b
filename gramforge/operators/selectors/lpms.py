"""Keys by a covering linear program per level (LPMS).

At level k the variables are the k-grams of the queries whose prefix wasn't
chosen; costs are ``records / k * queries`` and each query asks for a weighted
sum of its grams of at least ``b``.  Grams that no query has cost nothing and
help nothing, so the program never needs them; of the corpus it needs the
records of the queries' grams and, for the rounding threshold, the least and
greatest record count of a level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.grams import exploded
from gramforge.operators.match import query_literals
from gramforge.operators.postings import document_frequency
from gramforge.operators.selectors.common import key_table, string_counts, substrings_of

STRINGS_A_PASS = 200_000


def cover(costs: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``x >= 0`` that minimises ``costs @ x`` with ``rows @ x >= bounds`` (all numbers >= 0).

    The dual, max ``bounds @ y`` with ``rows.T @ y <= costs``, starts feasible
    at 0: a simplex tableau (least index, so it never cycles) ends with ``x`` in
    the last row.  Only the columns outside the basis are kept, and each
    variable is scaled by its greatest entry: entries of very unlike sizes would
    let rounding decide, and the least index might then cycle after all.  A row
    that no variable helps is left unfulfilled.
    """
    helped = rows.any(axis=1) & (bounds > 0)
    a, b = rows[helped].T.astype(float), bounds[helped].astype(float)
    n, m = a.shape
    scale = a.max(axis=1, initial=0)
    scale[scale == 0] = 1
    t = np.zeros((n + 1, m + 1))
    t[:n, :m], t[:n, -1], t[n, :m] = a / scale[:, None], costs / scale, -b
    basis, others = np.arange(m, m + n), np.arange(m)
    while len(enters := np.flatnonzero(t[n, :-1] < -1e-9)):
        j = enters[others[enters].argmin()]
        up = np.flatnonzero(t[:n, j] > 1e-9)
        if not len(up):
            break
        ratio = t[up, -1] / t[up, j]
        least = up[ratio <= ratio.min() + 1e-12]
        i = least[basis[least].argmin()]
        pivot, column = t[i, j], t[:, j].copy()
        t[:, j], column[i] = 0, 0
        t[i, j] = 1
        t[i] /= pivot
        touched = np.flatnonzero(column)
        t[touched] -= np.outer(column[touched], t[i])
        basis[i], others[j] = others[j], basis[i]
    x, slack = np.zeros(n), others >= m
    x[others[slack] - m] = t[n, :-1][slack]
    return np.maximum(x, 0) / scale


def _level_grams(literals: list[list[str]], k: int, extend: set[str] | None, drop_last: bool) -> list[set[str]]:
    """The k-grams of each query whose prefix may be extended."""
    last = 0 if drop_last and k > 1 else 1
    return [{g for x in lits for i in range(len(x) - k + last) if (g := x[i : i + k]) and (extend is None or g[:-1] in extend)} for lits in literals]


def _counts_from(corpus: DataFrame, literals: list[list[str]], k: int) -> dict[str, int]:
    """The records of the literals' k-grams, and in the same pass those of the next levels' as far as ``STRINGS_A_PASS`` goes."""
    own = {x for lits in literals for x in lits}
    strings = substrings_of(own, [k])
    for longer in range(k + 1, max(map(len, own)) + 1):
        more = substrings_of(own, [longer])
        if len(strings) + len(more) > STRINGS_A_PASS:
            break
        strings |= more
    return string_counts(corpus, strings, per_record=True)


def _extremes(corpus: DataFrame, k: int, chosen: set[str]) -> tuple[int, int]:
    """Least and greatest number of records of the k-grams of the corpus that extend no chosen gram."""
    df = document_frequency(exploded(corpus, [k]))
    for length in sorted({len(g) for g in chosen}):
        df = df.filter(~F.substring("gram", 1, length).isin(sorted(g for g in chosen if len(g) == length)))
    r = df.agg(F.min("df"), F.max("df")).first()
    return r[0] or 0, r[1] or 0


def lpms_keys(corpus: DataFrame, patterns: list[str], rounding: str = "deterministic", most: int | None = None, mode: str = "sound", drop_last: bool = False, scope: str = "corpus", seed: int = 0) -> DataFrame:
    """``(gram, df)``: the chosen keys.

    ``rounding``: ``deterministic`` keeps x above the threshold
    ``least / (greatest * most grams of a query)``, ``random`` keeps a gram with
    probability x (by the seed).  ``drop_last`` leaves out the last gram of each
    literal from level 2 on, as the classic implementation does.  ``scope``:
    the threshold's record counts are those of all grams of the level
    (``corpus``, one aggregation per level) or of the queries' ones (``queries``).
    """
    literals, rng = query_literals(patterns, mode), np.random.default_rng(seed)
    keys: dict[str, int] = {}
    n_records: dict[str, int] = {}
    extend: set[str] | None = None
    for k in range(1, max((len(x) for lits in literals for x in lits), default=0) + 1):
        of_query = _level_grams(literals, k, extend, drop_last)
        grams = sorted(set().union(*of_query))
        if not grams:
            break
        if grams[0] not in n_records:
            n_records = _counts_from(corpus, literals, k)
        present = [g for g in grams if n_records[g]]
        at = {g: j for j, g in enumerate(present)}
        n_queries = {g: sum(g in own for own in of_query) for g in grams}
        rows = np.zeros((len(of_query), len(present)))
        bounds = np.zeros(len(of_query))
        for q, own in enumerate(of_query):
            for g in own & at.keys():
                rows[q, at[g]] = n_records[g]
            # a gram that no record has asks for nothing
            bounds[q] = min((n_queries[g] if n_records[g] else 0 for g in own), default=0)
        # without the division by k, which all costs have in common, the numbers stay whole when cover scales them
        x = cover(np.array([float(n_records[g] * n_queries[g]) for g in present]), rows, bounds)
        if rounding == "deterministic":
            least, greatest = _extremes(corpus, k, set(keys)) if scope == "corpus" else (min(map(n_records.get, present), default=0), max(map(n_records.get, present), default=0))
            widest = max(map(len, of_query))
            kept = x > (least / (greatest * widest) if greatest * widest else 1)
        else:
            kept = rng.random(len(present)) < x
        for g, keep in zip(present, kept):
            if keep and (most is None or len(keys) < most):
                keys[g] = n_records[g]
        if most is not None and len(keys) >= most:
            break
        extend = {g for g in grams if g not in keys}
    return key_table(corpus.sparkSession, keys)
