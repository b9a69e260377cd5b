"""Schemas that drift between files (problem 4).

``files(file_id, series, seq, kind, file_format)`` names exported files and
``lines(file_id, line_no, line)`` holds their text.

1. **Schemas and fingerprints.** A first pass over the lines gives each file its
   field names with their narrowest types (:func:`schemas`); tasks keep one
   type per file and field, so only these are shuffled.  The fingerprint of a
   file hashes its names and types; the different fingerprints of a series are
   its schema versions (:func:`versions`).
2. **Migration steps.** Files whose fingerprint differs from that of the file
   before it are compared field by field (:func:`changes`): added, removed,
   renamed, retyped.  Files with the fingerprint of the file before are done.
   Only where fields came and went together, a second pass takes the cells of
   just these fields, to tell a rename from an addition by the values of the
   configurations that both files hold.
3. **Routing.** The renames are chained down to the name a field first had
   (:func:`lineage`); every cell goes through the chained renames, then the
   default and cast rules of its field, into one table (:func:`unified` long,
   :func:`wide` with typed columns).

Lines never move to find their header: the catalog of files (one row each,
with the header line) is broadcast if its size allows it, else it is joined by
file and block of ``BLOCK`` lines, so a large file is no large task.

Edge cases: exact copies of file rows and of lines count once; lines may come
in any order; carriage returns at line ends are taken off; blank cells, JSON
nulls and absent members hold no value, so they neither narrow a type nor speak
against a rename; a field without any value has no type and is never
``retyped``; missing cells are blank; what can't be read (cells beyond the
header, lines that are no JSON object, lines of files without header, of files
that aren't listed, null lines) is reported by :func:`rejects`; a file whose
predecessor (seq - 1) is missing has no changes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.plans.cut import checkpointed, written

CONFIGURATION = "cfg"
INTEGER, DECIMAL, TEXT = 1, 2, 3
TYPE_NAMES = {INTEGER: "integer", DECIMAL: "decimal", TEXT: "text"}
BLOCK = 50_000
_INTEGER = re.compile(r"[+-]?[0-9]+")
_DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_EXACT = Context(prec=100)

CELL_SCHEMA = "file_id long, line_no int, cfg string, field string, value string, same_as string, quoted boolean"
_CELLS = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("cfg", pa.string()), ("field", pa.string()), ("value", pa.string()), ("same_as", pa.string()), ("quoted", pa.bool_())])
_RANKS = pa.schema([("file_id", pa.int64()), ("field", pa.string()), ("rank", pa.int32())])
_REJECTS = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("reason", pa.string()), ("text", pa.string())])


class _Number(str):
    """A JSON number as it is written."""


def _scalar(value) -> tuple[str | None, bool]:
    """(text, quoted) of a JSON value: numbers as written, text marked as quoted, lists and truth values as text."""
    if value is None:
        return None, False
    if isinstance(value, _Number):
        return str(value), False
    if isinstance(value, str):
        return value, True
    return json.dumps(value), True


def _members(obj: dict, prefix: str = "") -> Iterator[tuple[str, str | None, bool]]:
    for name, value in obj.items():
        if isinstance(value, dict) and value:
            yield from _members(value, f"{prefix}{name}.")
        else:
            yield (prefix + name, *_scalar(value))


def _row(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), []) if '"' in line else line.split(delimiter)


_json = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number).decode


class _Reader:
    """Reads lines by the header or members of their file; keeps the headers it has parsed."""

    def __init__(self) -> None:
        self.names: dict[tuple[str, str], list[str]] = {}

    def fields(self, header: str, delimiter: str) -> list[str]:
        found = self.names.get((delimiter, header))
        if found is None:
            if len(self.names) > 10_000:
                self.names.clear()
            found = self.names[delimiter, header] = _row(header.rstrip("\r\n"), delimiter)
        return found

    def read(self, line_no: int, line: str | None, file_format: str | None, header: str | None) -> tuple[list[tuple[str, str | None, bool]], str | None, str | None]:
        """(cells as (field, value, quoted), why something was left out, what); a header line gives its names without values."""
        if file_format is None:
            return [], "no such file", line
        if line is None:
            return [], "null line", None
        line = line.rstrip("\r\n")
        if file_format == "jsonl":
            try:
                obj = _json(line)
            except (ValueError, RecursionError):
                return [], "no JSON", line
            return (list(_members(obj)), None, None) if isinstance(obj, dict) else ([], "no JSON object", line)
        if header is None:
            return [], "no header", line
        delimiter = "\t" if file_format == "tsv" else ","
        fields = self.fields(header, delimiter)
        if line_no == 1:
            return [(f, None, False) for f in fields], None, None
        row = _row(line, delimiter)
        cells = [(f, row[k] if k < len(row) else None, False) for k, f in enumerate(fields)]
        return (cells, "cells beyond the header", delimiter.join(row[len(fields) :])) if len(row) > len(fields) else (cells, None, None)


def rank_of(value: str, quoted: bool) -> int:
    """The narrowest type of a value."""
    v = value.strip()
    return TEXT if quoted else INTEGER if _INTEGER.fullmatch(v) else DECIMAL if _DECIMAL.fullmatch(v) else TEXT


def canonical(value: str) -> str:
    """The same text for equal numbers, however long or written, and for equal texts."""
    v = value.strip()
    return f"n{_EXACT.create_decimal(v).normalize(_EXACT)}" if _DECIMAL.fullmatch(v) and len(v) <= 90 else f"t{value}"


def _kept(value: str | None) -> bool:
    return value is not None and value.strip() != ""


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        found: dict[tuple[int, str], int] = {}
        for file_id, line_no, line, file_format, header in zip(*(c.to_pylist() for c in batch.columns)):
            for field, value, quoted in reader.read(line_no, line, file_format, header)[0]:
                if field != CONFIGURATION:
                    key = (file_id, field)
                    known = found.get(key, 0)
                    if known < TEXT:
                        found[key] = max(known, rank_of(value, quoted)) if _kept(value) else known
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] or None for k in keys], pa.int32())], schema=_RANKS)


def _cells(some: bool):
    """Cells of all fields, or (``some``) of those that the row's ``wanted`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in _CELLS)
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for file_id, line_no, line, file_format, header, *wanted in rows:
                found = reader.read(line_no, line, file_format, header)[0]
                cfg = next((v for f, v, _ in found if f == CONFIGURATION), None)
                names = set(wanted[0]) if some else None
                for field, value, quoted in found:
                    if field != CONFIGURATION and (names is None or field in names):
                        value = value if _kept(value) else None
                        for column, x in zip(out, (file_id, line_no, cfg, field, value, canonical(value) if some and value is not None else None, quoted)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CELLS)], schema=_CELLS)

    return run


def _unread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        out: list[tuple] = []
        for file_id, line_no, line, file_format, header in zip(*(c.to_pylist() for c in batch.columns)):
            _, reason, text = reader.read(line_no, line, file_format, header)
            if reason:
                out.append((file_id, line_no, reason, text))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_REJECTS)], schema=_REJECTS)


# -- files ------------------------------------------------------------------------------------------------------


def listed(files: DataFrame) -> DataFrame:
    """One row per file: ``(file_id, series, seq, kind, file_format)``."""
    return files.select("file_id", "series", "seq", "kind", F.lower("file_format").alias("file_format")).distinct()


def catalog(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_id, series, seq, kind, file_format, header, last_block)``, kept as a table."""
    heads = lines.groupBy("file_id").agg(F.min(F.when(F.col("line_no") == 1, F.col("line"))).alias("header"), F.max(_block()).alias("last_block"))
    return written(listed(files).join(heads, "file_id", "left"))


def _block() -> Column:
    """The number of a line's block in its file."""
    return F.greatest(F.coalesce(F.floor(F.col("line_no") / BLOCK), F.lit(0)), F.lit(0)).cast("int")


def _located(lines: DataFrame, about: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Lines with the ``columns`` of their file from ``about(file_id, last_block, ...)``, a written table.

    Spark knows the size of a written table and broadcasts it below its own
    limit; a larger one is joined by file and block of lines.
    """
    rows, right = lines.select("file_id", "line_no", "line"), about.select("file_id", "last_block", *columns)
    conf = lines.sparkSession._jsparkSession.sessionState().conf()
    if int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= int(conf.autoBroadcastJoinThreshold()):
        return rows.join(F.broadcast(right.drop("last_block")), "file_id", how)
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("last_block", F.lit(0))))).drop("last_block")
    return rows.withColumn("block", _block()).join(right, ["file_id", "block"], how).drop("block")


_COLUMNS = ["file_id", "line_no", "line", "file_format", "header"]


def rejects(known: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_id, line_no, reason, text)``: everything in the lines that no field takes."""
    return _located(lines, known, ["file_format", "header"], "left").select(*_COLUMNS).mapInArrow(_unread, "file_id long, line_no int, reason string, text string").distinct()


def schemas(known: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_id, field, rank)``: the fields of each file with their narrowest type (null without any value), kept as a table."""
    found = _located(lines, known, ["file_format", "header"]).select(*_COLUMNS).mapInArrow(_ranks, "file_id long, field string, rank int")
    return written(found.groupBy("file_id", "field").agg(F.max("rank").alias("rank")))


def cells(known: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_id, line_no, cfg, field, value, same_as, quoted)``, one row per cell of each line."""
    return _located(lines, known, ["file_format", "header"]).select(*_COLUMNS).mapInArrow(_cells(False), CELL_SCHEMA)


def values(cell: DataFrame) -> DataFrame:
    """``(file_id, cfg, field, value, same_as)``: the first value of a configuration's field over its repeats (copies of lines make no difference)."""
    first = F.min_by(F.struct("value", "same_as"), F.when(F.col("value").isNotNull(), F.struct("line_no", "value")))
    return cell.groupBy("file_id", "cfg", "field").agg(first.alias("v")).select("file_id", "cfg", "field", "v.value", "v.same_as")


def _type_name(rank: str) -> Column:
    return F.create_map(*(x for k, v in TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))))[F.col(rank)]


def fingerprints(fields: DataFrame) -> DataFrame:
    """``(file_id, n_fields, fingerprint)``: a hash of the sorted names and types of each file."""
    named = F.concat("field", F.lit(":"), F.coalesce(_type_name("rank"), F.lit("empty")))
    return fields.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_fields"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(named))), 256).alias("fingerprint"))


def _steps(known: DataFrame, prints: DataFrame) -> DataFrame:
    """``(file_id, next_id)``: each file and the one after it (seq + 1) in its series, if their fingerprints differ."""
    own = known.select("file_id", "series", "seq").join(prints.select("file_id", "fingerprint"), "file_id")
    after = own.select(F.col("file_id").alias("next_id"), "series", (F.col("seq") - 1).alias("seq"), F.col("fingerprint").alias("next_print"))
    return own.join(after, ["series", "seq"]).filter("fingerprint <> next_print").select("file_id", "next_id")


def _wanted_cells(known: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """:func:`values` of just the fields ``wanted(file_id, field)``: a file's fields are few, its lines stay where they are."""
    per_file = written(wanted.groupBy("file_id").agg(F.collect_set("field").alias("wanted")).join(known.select("file_id", "file_format", "header", "last_block"), "file_id"))
    found = _located(lines, per_file, ["file_format", "header", "wanted"]).select(*_COLUMNS, "wanted").mapInArrow(_cells(True), CELL_SCHEMA)
    return values(found.filter("value is not null"))


def changes(known: DataFrame, lines: DataFrame, fields: DataFrame) -> DataFrame:
    """``(file_id, field_name, change_kind, old_name, old_type, new_type)``: every change of a file against the file before it.

    ``known`` is the :func:`catalog`, ``fields`` the :func:`schemas`.
    """
    steps = written(_steps(known, fingerprints(fields)))
    earlier = fields.join(steps, "file_id").select(F.col("next_id").alias("pair"), "field", F.col("rank").alias("old_rank"), F.lit(None).cast("int").alias("new_rank"), F.lit(1).alias("old"), F.lit(0).alias("new"))
    later = fields.join(steps.select(F.col("next_id").alias("file_id")), "file_id").select(F.col("file_id").alias("pair"), "field", F.lit(None).cast("int").alias("old_rank"), F.col("rank").alias("new_rank"), F.lit(0).alias("old"), F.lit(1).alias("new"))
    both = written(earlier.unionByName(later).groupBy("pair", "field").agg(*(F.max(c).alias(c) for c in ("old_rank", "new_rank", "old", "new"))).filter("old = 0 or new = 0 or old_rank <> new_rank"))

    gone, come = both.filter("new = 0"), both.filter("old = 0")
    # a rename needs a field that went and one that came
    mixed = both.filter("old = 0 or new = 0").groupBy("pair").agg(F.count_if(F.col("new") == 0).alias("g"), F.count_if(F.col("old") == 0).alias("c")).filter("g > 0 and c > 0").select("pair")
    came = come.join(mixed, "pair").select(F.col("pair").alias("file_id"), "field")
    went = gone.join(mixed, "pair").join(steps.select(F.col("next_id").alias("pair"), "file_id"), "pair").select("file_id", "field", "pair")
    value = written(_wanted_cells(known, lines, came.unionByName(went.select("file_id", "field"))))
    old_cells = value.join(went, ["file_id", "field"]).select("pair", "cfg", F.col("field").alias("old_name"), F.col("same_as").alias("old_value"))
    new_cells = value.join(came, ["file_id", "field"]).select(F.col("file_id").alias("pair"), "cfg", "field", F.col("same_as").alias("new_value"))
    # candidates share a value somewhere; only they are compared over all configurations
    alike = old_cells.join(new_cells.withColumnRenamed("new_value", "old_value"), ["pair", "cfg", "old_value"]).select("pair", "old_name", "field").distinct()
    compared = alike.join(old_cells, ["pair", "old_name"]).join(new_cells, ["pair", "field", "cfg"])
    renames = compared.groupBy("pair", "old_name", "field").agg(F.bool_and(F.col("old_value") == F.col("new_value")).alias("same")).filter("same")
    renames = checkpointed(renames.groupBy("pair", "field").agg(F.min("old_name").alias("old_name"), F.collect_set("old_name").alias("matches")))

    old_type, new_type = _type_name("old_rank").alias("old_type"), _type_name("new_rank").alias("new_type")
    nothing = F.lit(None).cast("string")
    added = come.join(renames, ["pair", "field"], "left").select("pair", "field", F.when(F.col("old_name").isNull(), "added").otherwise("renamed").alias("kind"), "old_name", nothing.alias("old_type"), new_type)
    taken = renames.select("pair", F.explode("matches").alias("field"))
    removed = gone.join(taken, ["pair", "field"], "left_anti").select("pair", "field", F.lit("removed").alias("kind"), nothing.alias("old_name"), old_type, nothing.alias("new_type"))
    retyped = both.filter("old = 1 and new = 1").select("pair", "field", F.lit("retyped").alias("kind"), nothing.alias("old_name"), old_type, new_type)
    return added.unionByName(removed).unionByName(retyped).select(F.col("pair").alias("file_id"), F.col("field").alias("field_name"), F.col("kind").alias("change_kind"), "old_name", "old_type", "new_type")


def versions(known: DataFrame, fields: DataFrame) -> DataFrame:
    """``(file_id, series, seq, n_fields, fingerprint, version)``: schema fingerprints, and the version of each within its series.

    The version counts the different fingerprints of the series in order of
    first appearance.
    """
    own = known.select("file_id", "series", "seq").join(fingerprints(fields), "file_id")
    first = own.groupBy("series", "fingerprint").agg(F.min("seq").alias("first_seq"))
    numbered = first.withColumn("version", F.row_number().over(Window.partitionBy("series").orderBy("first_seq", "fingerprint")))
    return own.join(numbered.select("series", "fingerprint", "version"), ["series", "fingerprint"]).select("file_id", "series", "seq", "n_fields", "fingerprint", F.col("version").cast("long").alias("version"))


def lineage(known: DataFrame, change: DataFrame) -> DataFrame:
    """``(series, field, from_seq, root)``: from ``from_seq`` on, ``field`` is the continuation of what was first called ``root``.

    Each rename is one migration step to the name before; the steps are chained
    by pointer jumping, so the number of joins is the logarithm of the longest
    chain, whatever the number of files.
    """
    at = known.select("file_id", "series", "seq")
    steps = change.filter("change_kind in ('added', 'renamed')").join(at, "file_id").select("series", "field_name", F.col("seq").alias("from_seq"), "old_name")
    later = steps.select("series", "field_name", "from_seq")
    # the step that gave the old name its own meaning: the last one before this rename
    linked = (
        steps.filter("old_name is not null")
        .join(later.select("series", F.col("field_name").alias("old_name"), F.col("from_seq").alias("old_seq")), ["series", "old_name"], "left")
        .filter("old_seq is null or old_seq < from_seq")
        .groupBy("series", "field_name", "from_seq", "old_name")
        .agg(F.max("old_seq").alias("old_seq"))
    )
    linked = steps.filter("old_name is not null").join(linked, ["series", "field_name", "from_seq", "old_name"], "left").select("series", "field_name", "from_seq", F.col("old_name").alias("root"), F.col("old_seq").alias("root_seq"))
    linked = checkpointed(linked)
    while linked.filter("root_seq is not null").limit(1).count():
        up = linked.select("series", F.col("field_name").alias("root"), F.col("from_seq").alias("root_seq"), F.col("root").alias("up"), F.col("root_seq").alias("up_seq"), F.lit(1).alias("found"))
        linked = checkpointed(
            linked.join(up, ["series", "root", "root_seq"], "left").select("series", "field_name", "from_seq", F.when(F.col("found") == 1, F.col("up")).otherwise(F.col("root")).alias("root"), F.when(F.col("found") == 1, F.col("up_seq")).alias("root_seq"))
        )
    added = steps.filter("old_name is null").select("series", "field_name", "from_seq", F.col("field_name").alias("root"))
    return linked.select("series", "field_name", "from_seq", "root").unionByName(added).withColumnRenamed("field_name", "field")


def unified(known: DataFrame, lines: DataFrame, fields: DataFrame, change: DataFrame) -> DataFrame:
    """``(series, seq, file_id, kind, cfg, field, source_field, value, value_type)``: all values under the names they first had.

    ``source_field`` is the name in the file, ``value_type`` the narrowest type
    that the field has over all files.
    """
    at = known.select("file_id", "series", "seq", "kind")
    named = fields.join(at, "file_id").select("file_id", "series", "seq", "field", "rank")
    # the last step at or before the file gives the meaning of the name there
    steps = lineage(known, change)
    routed = named.join(steps, ["series", "field"], "left").filter("from_seq is null or from_seq <= seq").groupBy("file_id", "field").agg(F.max_by("root", "from_seq").alias("root"))
    routed = named.join(routed, ["file_id", "field"], "left").select("file_id", "field", "rank", F.coalesce("root", "field").alias("root"))
    types = routed.groupBy(F.col("root").alias("wide_root")).agg(F.max("rank").alias("root_rank"))
    routed = routed.join(types, F.col("root") == F.col("wide_root")).select("file_id", "field", "root", _type_name("root_rank").alias("value_type"))
    value = values(cells(known, lines)).filter("cfg is not null or value is not null")
    joined = value.join(at, "file_id").join(routed, ["file_id", "field"])
    return joined.select("series", "seq", "file_id", "kind", "cfg", F.col("root").alias("field"), F.col("field").alias("source_field"), "value", "value_type")


# The column type of each type of field.
_CASTS = {"integer": "decimal(38,0)", "decimal": "double", "text": "string"}


def wide(table: DataFrame, rules: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row per file and configuration with a typed column per field of ``rules``: ``{field: (integer, decimal or text, default)}``.

    A value that the type can't take, or none, gives the default (as text, cast
    like the values).  Of several source fields of one name in a file the first
    in order counts.
    """

    def cast(c: Column, kind: str) -> Column:
        good = {"integer": c.rlike(r"^[+-]?[0-9]+$"), "decimal": c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")}.get(kind, F.lit(True))
        return F.when(good, c.try_cast(_CASTS[kind]))

    columns = []
    for field, (kind, default) in rules.items():
        own = F.when(F.col("field") == field, cast(F.trim("value") if kind != "text" else F.col("value"), kind))
        first = F.min_by(own, F.when(own.isNotNull(), F.col("source_field")))
        columns.append(F.coalesce(first, cast(F.lit(default).cast("string"), kind)).alias(field))
    return table.groupBy("series", "seq", "file_id", "kind", "cfg").agg(*columns)
