"""Exact top-k inner-product search by tiled matrix products.

Vectors are packed into tiles (matrices) by the task that reads them.  Query
blocks and candidate tiles meet in the cells of a grid by an equi-join, each
meeting is one matrix product, the best k of the product are selected at once, and
the per-query lists are merged up a tree whose nodes take about ``FAN`` lists of a
bounded block.

Components are quantised to ``floor(1024 * x)``, so scores are integers and the
products are exact: a product of doubles is used while every partial sum stays
below 2**53, Python integers otherwise (a score beyond a long is held at the
long's limit).

Defined results
---------------
* null vectors, vectors with a null or non-finite component and rows without a
  ``vec_id`` take no part; vectors meet only vectors of their own length.
* a query never meets rows that carry its own ``vec_id``; a repeated query row
  gets its own result rows.  Ties go to the smaller ``vec_id``.
* empty inputs give an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, TILE, BLOCK, CELL, FAN = 1024, 8192, 2048, 64, 8
TILE_SCHEMA = "number long, dim int, n int, ids binary, vectors binary"


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")
    )


def pack(rows: DataFrame, per_tile: int) -> DataFrame:
    """Rows of each partition as numbered matrices of at most ``per_tile`` vectors of one length.

    Rows are sorted first and a matrix is named by its partition and its place in it, so a partition that is computed
    again gives the same matrices under the same names, and equal rows are just neighbours.
    """

    def tiles(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            nonlocal number
            ids, vectors = held.pop(dim)
            m = np.floor(SCALE * np.stack(vectors).astype(np.float64)) if dim else np.zeros((len(ids), 0))
            number += 1
            return pd.DataFrame({"number": [number - 1], "dim": [dim], "n": [len(ids)], "ids": [np.asarray(ids, np.int64).tobytes()], "vectors": [m.tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["vector"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= per_tile:
                    yield out(len(v))
        for dim in sorted(held):
            yield out(dim)

    # Lengths one after another, so that a task holds one open matrix even where lengths differ from row to row.
    return rows.sortWithinPartitions(F.size("vector"), "vec_id", "vector").mapInPandas(tiles, TILE_SCHEMA)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q], dtype=object).reshape(len(q), len(c))
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, score, id) of each row's k best, ties to the smaller id."""
    rows, out = len(scores), []
    for r in range(rows):
        s, ok = scores[r], ids[r] if ids.ndim == 2 else ids
        if own is not None:
            keep = ok != own[r]
            s, ok = s[keep], ok[keep]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            s, ok = s[keep], ok[keep]
        order = np.lexsort((ok, -s.astype(object) if (s == np.iinfo(np.int64).min).any() else -s))[:k]
        out.append((np.full(len(order), r), s[order], ok[order]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def grid(tiles: int, blocks: int, least: int) -> tuple[int, int]:
    """(rows, columns) of the grid of cells in which candidate tiles and query blocks meet.

    A tile is copied to all columns of its row and a block to all rows of its column.  The number of cells follows
    the number of products (at most ``CELL`` a cell); their shape is such that the copies of either side weigh the
    same, so the copies grow with the root of the number of cells.
    """
    cells = max(least, -(-tiles * blocks // CELL))
    rows = min(max(1, round((cells * tiles * TILE / (blocks * BLOCK)) ** 0.5)), cells)
    return rows, -(-cells // rows)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK, tile: int = TILE, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    ``queries`` and ``candidates`` are outputs of :func:`quantised`.  Tiles and blocks meet in the cells of a
    :func:`grid` by an equi-join, so a task multiplies one tile and one block at a time whatever the sizes of the
    tables, and no row is picked by its content: equal vectors and equal ids weigh like any others.
    """
    spark = candidates.sparkSession
    n_tiles, n_blocks = (max(1, -(-n // size)) for n, size in ((candidates.count(), tile), (queries.count(), block)))
    rows, columns = grid(n_tiles, n_blocks, cells or 2 * spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    # Queries are few in each partition; those of several partitions fill a block.
    gathered = queries.withColumn("_from", F.spark_partition_id()).repartition(n_blocks, "_from").drop("_from")
    packed_q = (
        pack(gathered, block)
        .select("dim", F.col("number").alias("block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), dealt(columns).alias("column"))
        .withColumn("row", every(rows))
    )
    packed_c = pack(candidates, tile).withColumn("row", dealt(rows)).withColumn("column", every(columns))
    meetings = packed_c.join(packed_q, ["row", "column", "dim"])

    def multiply(batches):
        for b in batches:
            for m in b.itertuples(index=False):
                ids = np.frombuffer(m.ids, np.int64)
                q_ids = np.frombuffer(m.q_ids, np.int64)
                scores = _product(np.frombuffer(m.q_vectors).reshape(m.q_n, m.dim), np.frombuffer(m.vectors).reshape(m.n, m.dim))
                yield _packed(m.block, m.node, q_ids, *_best(scores, ids, k, own=q_ids))

    # The leaves of a block's merge tree: FAN lists or so each, dealt by the tile's number.
    left = max(1, -(-n_tiles // FAN))
    lists = (
        meetings.select(F.pmod(F.xxhash64("number"), F.lit(left)).cast("int").alias("node"), "dim", "block", "n", "ids", "vectors", "q_n", "q_ids", "q_vectors")
        .mapInPandas(multiply, LIST_SCHEMA)
        .groupBy("block", "node")
        .applyInPandas(_merger(k), LIST_SCHEMA)
    )
    while left > 1:
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("block", "node").applyInPandas(_merger(k), LIST_SCHEMA)
        left = -(-left // FAN)
    return lists.mapInPandas(_ranked, "query_id long, rank int, vec_id long, score long")


LIST_SCHEMA = "block long, node int, q_ids binary, rows binary, scores binary, ids binary"


def _packed(block, node, q_ids, rows, scores, ids) -> pd.DataFrame:
    return pd.DataFrame({"block": [int(block)], "node": [int(node)], "q_ids": [q_ids.tobytes()], "rows": [rows.astype(np.int64).tobytes()], "scores": [scores.astype(np.int64).tobytes()], "ids": [ids.astype(np.int64).tobytes()]})


def _merger(k: int):
    """Merges the lists of one block that meet in a node, about FAN of them."""

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        rows, scores, ids = (np.frombuffer(b"".join(lists[c]), np.int64) for c in ("rows", "scores", "ids"))
        q_ids = np.frombuffer(lists["q_ids"].iloc[0], np.int64)
        order = np.lexsort((ids, ~scores, rows))  # ~x orders as -x does, without overflow
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.searchsorted(rows, np.arange(len(q_ids)))
        keep = np.arange(len(rows)) - starts[rows] < k if len(rows) else np.zeros(0, bool)
        return _packed(lists["block"].iloc[0], lists["node"].iloc[0], q_ids, rows[keep], scores[keep], ids[keep])

    return merge


def _ranked(batches):
    for b in batches:
        for m in b.itertuples(index=False):
            rows, scores, ids = (np.frombuffer(x, np.int64) for x in (m.rows, m.scores, m.ids))
            q_ids = np.frombuffer(m.q_ids, np.int64)
            starts = np.searchsorted(rows, np.arange(len(q_ids)))
            yield pd.DataFrame({"query_id": q_ids[rows], "rank": (np.arange(len(rows)) - starts[rows] + 1).astype(np.int32), "vec_id": ids, "score": scores})


def is_query(vec_id: Column, every: int) -> Column:
    return F.pmod(vec_id, F.lit(every)) == 0
