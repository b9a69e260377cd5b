import random
from collections import defaultdict

from pyspark.sql import functions as F

from gramforge.llm import packing

CAPACITIES = [(1, 100), (2, 64), (3, None), (4, 0)]


def packed(spark, items):
    df = spark.createDataFrame(items, "id long, size long, capacity int")
    return packing.packed(df, F.col("id"), F.col("size"), spark.createDataFrame(CAPACITIES, "capacity_id int, capacity long"), items_per_task=500).collect()


def test_every_item_is_packed_whole_and_no_bin_overflows(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([rng.randint(0, 90), rng.randint(1, 900)]), 5) for i in range(2000)]
    rows = packed(spark, items)
    for c, capacity in CAPACITIES[:2]:
        pieces, bins = defaultdict(list), defaultdict(list)
        for r in (r for r in rows if r.capacity_id == c):
            pieces[r.item_id].append(r)
            bins[r.bin_id].append((r.bin_offset, r.piece_size))
        for i, size, _ in items:
            own = sorted(pieces[i], key=lambda r: r.piece_no)
            assert sum(r.piece_size for r in own) == size and len(own) == own[0].n_pieces == max(1, -(-size // capacity))
            assert all(r.piece_size == capacity for r in own[:-1])
        for parts in bins.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset >= at or size == 0
                at = max(at, offset + size)
            assert at <= capacity
        used = sum(size for parts in bins.values() for _, size in parts)
        assert used / (len(bins) * capacity) > 0.9


def test_edge_cases(spark):
    rows = packed(spark, [(1, None, 0), (None, 5, 0), (2, 5, 0), (2, 5, 0), (3, -4, 0), (4, 100, 0), (5, 101, 0)])
    sizes = sorted((r.item_id is None, r.item_id or 0, r.piece_size) for r in rows if r.capacity_id == 1)
    assert sizes == sorted([(True, 0, 5), (False, 2, 5), (False, 2, 5), (False, 3, -4), (False, 4, 100), (False, 5, 100), (False, 5, 1)])


def test_empty_table_and_text_size(spark):
    df = spark.createDataFrame([], "id long, size long")
    assert packing.packed(df, F.col("id"), F.col("size"), spark.createDataFrame(CAPACITIES, "capacity_id int, capacity long")).count() == 0
    texts = spark.createDataFrame([("é",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(packing.text_size(F.col("t"))).collect()] == [3, 1, None]
