import random
import zlib

import numpy as np

from fieldloom.llm import sharding, topk_search

DOCS = "doc_id long, text string, shard string"


def test_sharding_balances_and_numbers_without_gaps(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 900) + "é", "clash") for i in range(600)] + [(600, None, None), (None, "no id", "a"), (601, "", "b"), (602, "y" * 9000, "c")]
    rows += [(7000, "same", "s")] * 5 + [(8000 + i, "copy", "s") for i in range(200)]
    placed, slot_map = sharding.shard_records(spark.createDataFrame(rows, DOCS), str(tmp_path / "map"), 8)
    got = placed.collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    loads = {}
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[s] = sum(r["size"] for r in own)
    assert max(loads.values()) - min(loads.values()) <= 9001
    assert slot_map.count() == sharding.N_SLOTS and {r.version for r in slot_map.collect()} == {1}


def test_rebalancing_moves_only_what_it_must(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 50, "") for i in range(4000)], DOCS)
    loads = sharding.slot_loads(sharding.sized_records(docs))
    _, first = sharding.shard_records(docs, str(tmp_path / "first"), 8)
    first = first.persist()
    grown = sharding.rebalance(first, loads, 9)
    moved = grown.alias("a").join(first.alias("b"), "virtual_slot").where("a.shard <> b.shard and a.shard <> 8").join(loads, "virtual_slot")
    assert moved.count() < 0.02 * sharding.N_SLOTS
    sharding.write_map(first, str(tmp_path / "maps"))
    sharding.write_map(grown, str(tmp_path / "maps"))
    assert sharding.read_map(spark, str(tmp_path / "maps")).select("shard").distinct().count() == 9
    assert sharding.read_map(spark, str(tmp_path / "maps"), 1).select("shard").distinct().count() == 8


def test_sharding_of_nothing(spark, tmp_path):
    placed, _ = sharding.shard_records(spark.createDataFrame([], DOCS), str(tmp_path / "map"), 8)
    assert placed.count() == 0


def test_repeated_rows_are_spread(spark, tmp_path):
    """Half of the table is one repeated row: shards still differ by no more than the largest row."""
    rows = [(1, "z" * 99, "s")] * 1000 + [(i, "y" * (i % 90), "s") for i in range(2, 1002)] + [(None, None, None)] * 50
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    placed, _ = sharding.shard_records(docs, str(tmp_path / "map"), 8)
    got = placed.collect()
    assert sorted(((r.doc_id or -1), r["size"]) for r in got) == sorted(((i or -1), len(t or "") + 1) for i, t, _ in rows)
    loads = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= 100
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_the_stored_map_is_edited_and_in_force(spark, tmp_path):
    store = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * (i % 50), "") for i in range(3000)], DOCS)
    placed, _ = sharding.shard_records(docs, store, 8)
    assert {r.map_version for r in placed.select("map_version").distinct().collect()} == {1}
    again, grown = sharding.shard_records(docs, store, 9)
    assert sharding.latest_version(spark, store) == 2 and grown.select("shard").distinct().count() == 9
    moved = placed.alias("a").join(again.alias("b"), ["doc_id", "size", "text_crc32", "copy"]).where("a.shard <> b.shard")
    total, gone = sum(r["size"] for r in placed.collect()), sum(r["size"] for r in moved.select("size").collect())
    assert total / 9 * 0.9 < gone < total / 9 * 1.2


def brute(rows, every, k):
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b)))[:k]
            out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)], "x") for i in range(150)]
    rows += [(200 + i, rows[0][1], "x") for i in range(40)]  # ties
    rows += [(900, None, "x"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (1000, [1.0, 2.0], "x"), (1010, [], "x")]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, `rank` string"))
    want = brute([(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e, _ in rows], 10, 10)
    for options in ({}, {"block": 4, "tile": 16, "cells": 9}, {"block": 2, "tile": 3, "cells": 40}):
        got = topk_search.top_k(v.where(topk_search.is_query(v.vec_id, 10)), v, 10, **options)
        assert sorted(map(tuple, got.collect())) == want


def test_topk_of_equal_query_rows(spark):
    """More equal query rows than three blocks hold: each row has its own ten results."""
    rows = [(0, [1.0, 2.0])] * 7 + [(i, [float(i), 1.0]) for i in range(1, 30)]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.top_k(v.where("vec_id = 0"), v, 10, block=2, tile=4, cells=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 100, 10)
    assert len(got) == 70


def test_grid_copies_grow_with_the_root():
    for tiles, blocks in ((1, 1), (10, 2), (40_000, 1_600), (1, 5000)):
        rows, columns = topk_search.grid(tiles, blocks, 16)
        assert rows * columns >= max(16, tiles * blocks / topk_search.CELL) and rows * columns <= 2 * max(16, 1 + tiles * blocks / topk_search.CELL)


def test_topk_large_values_and_nothing(spark):
    big = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, -1e6]), (2, [1e6, 1e6])], "vec_id long, embedding array<double>")
    v = topk_search.quantised(big)
    got = topk_search.top_k(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 2 * 1024000000**2), (0, 2, 1, 0)]
    assert topk_search.top_k(v.where("false"), v.where("false"), 2).count() == 0
