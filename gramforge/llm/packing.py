"""Items of varying length into containers of fixed capacity (problem 6).

Bounded-space online best-fit: at most ``OPEN`` bins are open; they are kept in
a bitset keyed by free space, so the best fit of an item is the lowest set bit
at or above its size.  An item that fits nowhere opens a bin; when all are
open, the fullest one is closed first.  A bin without free space closes at
once.  Only an item larger than the capacity is cut, into full containers and
one rest that is packed like any item.

Items are spread over partitions by a hash of their id, about
``ITEMS_PER_TASK`` each, and a partition packs all its items for all
capacities in one pass, so at most ``OPEN`` bins per partition and capacity
stay open to the end; with the default that is under one bin in a hundred.
Only ids and sizes are moved, never texts.

Edge cases: null sizes (null texts) aren't packed; sizes below 1 take no space
and go to the fullest open bin; null and repeated ids are packed row by row;
capacities that are null or below 1 are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN = 64
ITEMS_PER_TASK = 100_000
FLUSH = 20_000  # pieces held before they are sent on

SCHEMA = "capacity_id int, item_id long, size long, piece_no int, n_pieces int, piece_size long, bin_id string, bin_offset long"
_TYPES = pa.schema([("capacity_id", pa.int32()), ("item_id", pa.int64()), ("size", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("piece_size", pa.int64()), ("bin_id", pa.string()), ("bin_offset", pa.int64())])


class BestFit:
    """The open bins of one capacity."""

    def __init__(self, capacity: int, most_open: int = OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0  # bit f is set if an open bin has free space f
        self.bins: dict[int, list[int]] = {}
        self.open = self.opened = 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of an item that is no larger than the capacity."""
        size = max(size, 0)
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        rest = free - size
        if rest:
            self.bins.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def _pack(capacities: list[tuple[int, int]], most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [(k, c, BestFit(c, most_open)) for k, c in capacities]
        out: tuple[list, ...] = tuple([] for _ in _TYPES)

        def flushed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _TYPES)], schema=_TYPES)
            for c in out:
                c.clear()
            return rows

        for batch in batches:
            part, ids, sizes = (c.to_pylist() for c in batch.columns)
            for p, item, size in zip(part, ids, sizes):
                for k, capacity, packer in packers:
                    whole, rest = divmod(size, capacity) if size > capacity else (0, size)
                    pieces = whole + (1 if rest or not whole else 0)
                    for no in range(pieces):
                        piece = capacity if no < whole else rest
                        number, offset = packer.put(piece)
                        for column, x in zip(out, (k, item, size, no, pieces, piece, f"{p}-{number}", offset)):
                            column.append(x)
                        if len(out[0]) >= FLUSH:
                            yield flushed()
        yield flushed()

    return run


def packed(df: DataFrame, item: Column, size: Column, capacities: DataFrame, most_open: int = OPEN, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``(capacity_id, item_id, size, piece_no, n_pieces, piece_size, bin_id, bin_offset)``, one row per piece and capacity.

    ``capacities(capacity_id, capacity)`` is a parameter table of a few rows.
    """
    sizes = [(r.capacity_id, r.capacity) for r in capacities.select("capacity_id", "capacity").filter("capacity >= 1").distinct().orderBy("capacity_id").collect()]
    n = max(1, -(-df.count() // items_per_task))
    items = df.select(item.cast("long").alias("item_id"), size.cast("long").alias("size")).filter("size is not null")
    spread = items.repartition(n, F.xxhash64("item_id", "size")).sortWithinPartitions("item_id", "size")
    return spread.select(F.spark_partition_id().alias("part"), "item_id", "size").mapInArrow(_pack(sizes, most_open), SCHEMA)


def text_size(text: Column) -> Column:
    """Byte-level tokens of a text: its UTF-8 bytes and one end token."""
    return F.octet_length(text).cast(T.LongType()) + 1
