"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Candidates are dealt to stripes and queries to blocks; every stripe meets every block in one task. There a
product of int8 tiles gives each squared distance up to a bound that follows from the quantisation error of
both vectors. Pairs whose lower bound is within the best upper bounds are computed anew in double precision
and merged into a heap for each query. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadymark.llm.token_files import ddl

#: Mean candidates of a stripe and queries of a block: what a task holds.
STRIPE_ROWS, BLOCK_ROWS = 8192, 2048
#: Candidates and queries of a tile.
TILE, TILE_QUERIES = 2048, 512
#: Dimensions up to which a sum of products of int8 is exact in single precision.
EXACT_DIMENSIONS = 1024

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: str) -> Column:
    """Not null, not all zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


class Tile:
    """Vectors, their int8 form and the norms that bound its error."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        scale = np.abs(vectors).max(axis=1, initial=0) / 127
        scale[scale == 0] = 1
        self.small = np.rint(vectors / scale[:, None]).astype(np.int8)
        self.scale = scale
        rounded = self.small * scale[:, None]
        self.norm = np.linalg.norm(vectors, axis=1)
        self.rounded_norm = np.linalg.norm(rounded, axis=1)
        self.error = np.linalg.norm(vectors - rounded, axis=1)

    def part(self, start: int, stop: int) -> Tile:
        own = object.__new__(Tile)
        for name, value in vars(self).items():
            setattr(own, name, value[start:stop])
        return own


def squared_bounds(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances between two tiles."""
    product = np.zeros((len(a.small), len(b.small)))
    for at in range(0, a.small.shape[1], EXACT_DIMENSIONS):
        part = slice(at, at + EXACT_DIMENSIONS)
        product += a.small[:, part].astype(np.float32) @ b.small[:, part].astype(np.float32).T
    product *= a.scale[:, None] * b.scale
    norms = a.norm[:, None] ** 2 + b.norm**2
    slack = 2 * (a.rounded_norm[:, None] * b.error + a.error[:, None] * b.norm) + 1e-9 * norms
    middle = norms - 2 * product
    return middle - slack, middle + slack


def nearest_in(queries: Tile, query_ids: np.ndarray, others: Tile, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest others of each query but itself, exactly, ties to the smaller id."""
    for first in range(0, len(query_ids), TILE_QUERIES):
        block = queries.part(first, first + TILE_QUERIES)
        own = query_ids[first : first + TILE_QUERIES]
        heaps: list[list[tuple[float, int]]] = [[] for _ in own]
        worst = np.full(len(own), np.inf)  # squared distance of the k-th found so far, with room for rounding
        for start in range(0, len(ids), TILE):
            some, tile = ids[start : start + TILE], others.part(start, start + TILE)
            low, high = squared_bounds(block, tile)
            itself = own[:, None] == some
            high[itself] = np.inf
            bound = worst
            if len(some) > k:
                bound = np.minimum(worst, np.partition(high, k - 1, axis=1)[:, k - 1])
            survives = ~(low > bound[:, None]) & ~itself
            for i in np.flatnonzero(survives.any(axis=1)):
                at = np.flatnonzero(survives[i])
                scores = np.sqrt(((tile.vectors[at] - block.vectors[i]) ** 2).sum(axis=1))
                heaps[i] = heapq.nsmallest(k, [*heaps[i], *zip(scores.tolist(), some[at].tolist(), strict=True)])
                if len(heaps[i]) == k:
                    worst[i] = heaps[i][-1][0] ** 2 * (1 + 1e-9)
        for query_id, heap in zip(own.tolist(), heaps, strict=True):
            for score, vec_id in heap:
                yield query_id, vec_id, score


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; of a repeated id the smallest vector."""
    ids = table["vec_id"].to_numpy()
    if not len(ids):
        return ids, np.empty((0, 0))
    vectors = np.array(table["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    new = np.append(True, ids[1:] != ids[:-1])
    return ids[new], vectors[new]


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest other vectors of each query by Euclidean distance.

    Rows with a null id, or a vector that is null, empty, all zero or holds a null or non-finite component,
    take no part. Vectors of different lengths are not compared. A repeated ``vec_id`` counts once, with its
    smallest vector. Fewer than k candidates are all returned; an empty table gives no rows. Other columns
    are ignored.
    """
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    asked = rows.where(is_query)
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    stripes, blocks = max(1, -(-size.n // STRIPE_ROWS)), max(1, -(-size.q // BLOCK_ROWS))
    hashed = F.xxhash64("vec_id")
    candidates = rows.withColumns({"stripe": F.pmod(hashed, F.lit(stripes)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    queries = asked.withColumns({"stripe": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))), "block": F.pmod(hashed, F.lit(blocks))})
    key = ["dim", F.col("stripe").cast("int").alias("stripe"), F.col("block").cast("int").alias("block")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = _vectors(left)
        query_ids, wanted = _vectors(right)
        found = list(nearest_in(Tile(wanted), query_ids, Tile(vectors), ids, k)) if len(ids) and len(query_ids) else []
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND) if found else _FOUND.empty_table()

    found = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(meet, ddl(_FOUND))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
