"""Nearest neighbours by inner product with collision-counting hashing.

Each block of vectors keeps one sorted array per random projection (vectors are lengthened by one component that makes
all norms of a block equal, so that the largest inner product is the smallest distance). Around a query's own projections
windows open; virtual rehashing widens them all by the same ratio until enough vectors lie in the windows of at
least ``threshold`` of the projections. Those are verified: their exact inner products decide.

Null and zero vectors and vectors with null or non-finite components take no part, nor do rows without an id. Rows that
repeat an id count once, with the least vector. Only vectors of the same length are compared. A query with fewer
candidates than wanted gets all of them. Equally near vectors stand by id. Empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 16384
QUERIES = 4096
# Queries whose windows are looked up at once.
SLICE = 256
PROJECTIONS = 64
# Share of the projections in whose windows a vector must lie to be verified.
THRESHOLD = 0.6
# The first windows' half width in standard deviations of a projection, and the ratio of widening.
FIRST, RATIO = 0.6, 1.25
# Verified vectors at which widening ends: a share of the block, and so many times the wanted ones at least.
VERIFIED, TIMES = 0.15, 25


def usable(vector: Column) -> Column:
    """All components finite, one of them not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 7):
        self.ids, self.x = ids, x
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max())
        rnd = np.random.default_rng(seed)
        # Sets of orthogonal directions: random, but no two of a set measure the same.
        sets = -(-PROJECTIONS // (x.shape[1] + 1))
        turned = np.concatenate([np.linalg.qr(rnd.standard_normal((x.shape[1] + 1, x.shape[1] + 1)))[0] for _ in range(sets)], axis=1)
        self.directions = turned[:, :PROJECTIONS]
        at = x @ self.directions[:-1] + np.sqrt(np.maximum(self.top - norms, 0))[:, None] * self.directions[-1]
        order = np.argsort(at, axis=0, kind="stable").T
        self.values = np.take_along_axis(at.T, order, axis=1)
        # The place of each vector in each sorted array: it collides where that lies in a query's window.
        self.places = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)
        self.first = FIRST * float(np.median(at.std(axis=0))) or 1.0

    def windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First places and sizes of the windows around the queries' projections in the sorted arrays; one row a query."""
        low = np.stack([np.searchsorted(v, a - width) for v, a in zip(self.values, at.T)], axis=1)
        high = np.stack([np.searchsorted(v, a + width, "right") for v, a in zip(self.values, at.T)], axis=1)
        return low.astype(self.places.dtype), (high - low).astype(self.places.dtype)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the nearest found of each query, nearest first."""
        n = len(self.ids)
        enough = min(n, max(TIMES * k, int(VERIFIED * n)) + 1)
        need = max(1, int(THRESHOLD * PROJECTIONS))
        for first in range(0, len(query_ids), SLICE):
            ids, q = query_ids[first: first + SLICE], queries[first: first + SLICE]
            # Only the direction of a query matters, so it is put among vectors of the block's norm.
            at = (q * np.sqrt(self.top / np.einsum("ij,ij->i", q, q))[:, None]) @ self.directions[:-1]
            unmet, width = np.arange(len(ids)), self.first
            chosen: dict[int, np.ndarray] = {}
            while len(unmet):
                for i, low, size in zip(unmet.tolist(), *self.windows(at[unmet], width)):
                    # Below a window's first place the difference wraps round, and so exceeds any size.
                    counts = ((self.places - low[:, None]) < size[:, None]).sum(axis=0, dtype=np.uint16)
                    met = np.flatnonzero(counts >= need)
                    if len(met) >= enough or size.sum(dtype=np.int64) >= n * PROJECTIONS:
                        chosen[i] = met
                unmet, width = np.array([i for i in unmet.tolist() if i not in chosen], int), width * RATIO
            for i, query_id in enumerate(ids.tolist()):
                yield query_id, *self.verified(chosen[i], query_id, q[i], k)

    def verified(self, chosen: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact inner products of the best of the chosen vectors."""
        chosen = chosen[self.ids[chosen] != query_id]
        # Row by row, so that equal vectors score equally to the last bit wherever they lie.
        scores = np.einsum("ij,j->i", self.x[chosen], q)
        if len(chosen) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            chosen, scores = chosen[near], scores[near]
        best = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen][best], scores[best]


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found of each query; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = cut_lineage(spark, rows.withColumn("dim", F.size("vector")).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    blocks, batches = max(1, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["dim", "block", "batch"]
    index = rows.select("vec_id", "vector", "dim", deal(blocks).alias("block"), every(batches).alias("batch"))
    asked = rows.filter("asks").select("vec_id", "vector", "dim", deal(batches).alias("batch"), every(blocks).alias("block"))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if held.num_rows and wanted.num_rows:
            block = Block(held.column("vec_id").to_numpy(), _vectors(held))
            found = list(block.nearest(wanted.column("vec_id").to_numpy(), _vectors(wanted), k))
        return pa.table({
            "query_id": pa.array(np.concatenate([np.full(len(v), i, np.int64) for i, v, _ in found] or [np.zeros(0, np.int64)])),
            "vec_id": pa.array(np.concatenate([v for _, v, _ in found] or [np.zeros(0, np.int64)])),
            "score": pa.array(np.concatenate([s for _, _, s in found] or [np.zeros(0)]))})

    near = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
