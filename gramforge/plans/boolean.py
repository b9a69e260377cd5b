"""AND/OR plans of regular expressions over index keys.

A plan is a small tree: ``ALL`` (no restriction), ``("lit", text)``,
``("key", gram)``, ``("and", [plans])``, ``("or", [plans])``.  It is made from
the parsed pattern, so groups may nest and every quantifier is understood:

* a run of characters is a literal, a sequence an AND, a choice an OR,
* what may be absent (least rounds 0), classes and anchors restrict nothing.

Rewriting replaces each literal by the AND of the index keys it contains; a
literal without any key restricts nothing.  Without restriction one side of an
AND falls away, whereas an OR with such a side falls away altogether.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramforge.functions.regex import is_valid, parse

ALL: tuple = ("all",)


def conjunction(parts: Iterable[tuple]) -> tuple:
    """AND without unrestricted and repeated parts."""
    kept = list(dict.fromkeys(x for p in parts if p != ALL for x in (p[1] if p[0] == "and" else (p,))))
    return ALL if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def disjunction(parts: Iterable[tuple]) -> tuple:
    """OR; unrestricted as soon as one part is."""
    kept = list(dict.fromkeys(x for p in parts for x in (p[1] if p[0] == "or" else (p,))))
    return ALL if not kept or ALL in kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of(node: tuple) -> tuple:
    kind = node[0]
    if kind == "char":
        return ALL if node[2] else ("lit", node[1])
    if kind == "alt":
        return disjunction(map(_of, node[1]))
    if kind == "group":
        return _of(node[1])
    if kind == "repeat":
        return _of(node[1]) if node[2] else ALL
    if kind == "cat":
        parts, run = [], ""
        for n in node[1]:
            if n[0] == "char" and not n[2]:
                run += n[1]
                continue
            if run:
                parts.append(("lit", run))
            run = ""
            parts.append(_of(n))
        return conjunction([*parts, ("lit", run)] if run else parts)
    return ALL


def plan(pattern: str) -> tuple:
    """The plan of a pattern over its literals; an invalid pattern has no restriction (and no match)."""
    return _of(parse(pattern)) if is_valid(pattern) else ALL


def literals(node: tuple) -> list[str]:
    """The literals (or keys) of a plan."""
    return [node[1]] if node[0] in ("lit", "key") else [x for p in node[1:] for q in p for x in literals(q)]


def rewritten(node: tuple, keys_of: Callable[[str], Iterable[str]]) -> tuple:
    """The plan over index keys: each literal becomes the AND of its keys."""
    if node[0] == "lit":
        return conjunction(("key", k) for k in keys_of(node[1]))
    if node[0] in ("and", "or"):
        return (conjunction if node[0] == "and" else disjunction)(rewritten(p, keys_of) for p in node[1])
    return node


MOST_CLAUSES = 64


def _n_clauses(node: tuple) -> int:
    if node[0] == "or":
        return sum(map(_n_clauses, node[1]))
    return prod(map(_n_clauses, node[1])) if node[0] == "and" else 1


def bounded(node: tuple) -> tuple:
    """The plan with at most ``MOST_CLAUSES`` clauses: the choice with most clauses is given up first, which only lets more candidates through."""
    while _n_clauses(node) > MOST_CLAUSES:
        if node[0] != "and":
            return ALL
        widest = max(node[1], key=_n_clauses)
        node = conjunction(p for p in node[1] if p != widest)
    return node


def clauses(node: tuple) -> list[tuple[str, ...]]:
    """The plan as an OR of ANDs: the different keys of each clause."""
    if node[0] == "or":
        return list(dict.fromkeys(c for p in node[1] for c in clauses(p)))
    if node[0] == "and":
        return list(dict.fromkeys(tuple(sorted({k for c in choice for k in c})) for choice in product(*map(clauses, node[1]))))
    return [(node[1],)] if node[0] in ("lit", "key") else [()]


def condition(node: tuple, has: Callable[[str], Column]) -> Column:
    """The plan as a boolean column; ``has`` gives the column that says whether a record has a literal or key."""
    if node[0] in ("lit", "key"):
        return has(node[1])
    if node[0] in ("and", "or"):
        first, *rest = (condition(p, has) for p in node[1])
        for c in rest:
            first = first & c if node[0] == "and" else first | c
        return first
    return F.lit(True)


def shown(node: tuple) -> str:
    """The plan as text, e.g. ``AND(OR('Bill', 'William'), 'Clinton')``."""
    if node[0] in ("lit", "key"):
        return repr(node[1])
    return f"{node[0].upper()}({', '.join(map(shown, node[1]))})" if node[0] in ("and", "or") else "NULL"
