"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale each. A tile is a block of queries against a block of candidates; the
product of their codes gives every inner product up to a proven bound. A pair survives if its upper bound reaches the
k-th largest lower bound seen so far for its query; survivors are recomputed in double precision and merged into
each query's heap. The result is that of a full search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import saved, with_row_id

NEAREST = 20
EVERY = 20
#: Queries, candidates of a tile; candidates of one task.
QUERY_BLOCK, TILE_ROWS, TASK_ROWS = 1024, 4096, 16384


def usable(vector):
    """Not null, not empty, without null or non-finite components, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of what the codes stand for, and lengths of the residuals.

    With ``x = s*c + e``: ``<x, y> - s*t*<c, d> = <e, y> + <s*c, f>``, so the error of a product of codes is at most
    ``|e| |y| + |s*c| |f|`` (Cauchy-Schwarz).
    """
    scales = np.abs(vectors).max(axis=1) / 127
    scales[scales == 0] = 1.0  # denormal rows: all codes zero, everything is residual
    codes = np.rint(vectors / scales[:, None]).astype(np.int8)
    kept = codes * scales[:, None]
    return codes, scales, np.linalg.norm(kept, axis=1), np.linalg.norm(vectors - kept, axis=1)


def code_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: 1,024 terms of at most 127 squared fit in a float's 24 bits."""
    out = np.zeros((len(left), len(right)))
    for start in range(0, left.shape[1], 1024):
        part = slice(start, start + 1024)
        out += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return out


class Heaps:
    """The best ``k`` candidates of each query of a block: larger score first, then smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scales, self.kept, self.lost = quantised(vectors)
        self.length = self.kept + self.lost
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes, scales, kept, lost = quantised(vectors)
        about = code_products(self.codes, codes) * self.scales[:, None] * scales
        error = self.lost[:, None] * (kept + lost) + self.kept[:, None] * lost
        error = error * (1 + 1e-9) + 1e-12 * self.length[:, None] * (kept + lost)  # rounding of the bounds themselves
        own = self.ids[:, None] == ids
        lower = np.where(own, -np.inf, about - error)
        least = self.scores[:, -1]
        if len(ids) >= self.k:
            least = np.maximum(least, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((about + error >= least[:, None]) & ~own)
        scores = inner_products(self.vectors[q], vectors[c])
        self.merge(q, scores, ids[c])

    def merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        held = np.isfinite(self.scores)
        everyone = np.repeat(np.arange(len(self.ids)), self.k).reshape(self.scores.shape)
        q = np.concatenate((everyone[held], q))
        scores = np.concatenate((self.scores[held], scores))
        ids = np.concatenate((self.found[held], ids))
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.scores[q[best], place[best]] = scores[best]
        self.found[q[best], place[best]] = ids[best]


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the terms added in their order."""
    out = np.zeros(len(left))
    for i in range(left.shape[1]):
        out += left[:, i] * right[:, i]
    return out


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest by inner product, nearest first.

    ``is_query`` is a condition on the table's columns. A query is not its own candidate: rows that share its id are
    left out. Ties go to the smaller id. Null ids and unusable vectors (see ``usable``) take no part. Every other row
    is a candidate, and a query if it asks, whether or not its id or vector is repeated; the queries of one id share
    its ``k`` ranks. Vectors of another length than a query are no candidates of it. With fewer than ``k`` candidates
    all are returned; an empty table gives no rows.

    Queries and candidates are dealt to blocks by a hash of the row, and each pair of a query block and a task's share
    of the candidates is one group of a co-group: its size does not depend on the data. Per task and query at most
    ``k`` rows leave; they are cut again before and after the last shuffle.
    """
    rows, row = with_row_id(saved(
        vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector).alias("dim")), "vectors"))
    n_all, n_asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not n_asks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups, shares = math.ceil(n_asks / query_block), math.ceil(n_all / task_rows)

    def block(count: int, seed: int):
        return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = rows.where("asks").select("id", "v", "dim", block(groups, 1).alias("g")).select(
        "id", "v", "dim", "g", every(shares).alias("s"))
    offered = rows.select("id", "v", "dim", block(shares, 2).alias("s")).select(
        "id", "v", "dim", "s", every(groups).alias("g"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = answers = np.zeros(0, np.int64)
        scores = np.zeros(0)
        if len(left) and len(right):
            left, right = left.combine_chunks(), right.combine_chunks()
            heaps = Heaps(left["id"].to_numpy(), matrix(left["v"].combine_chunks()), k)
            for tile in right.select(["id", "v"]).to_batches(max_chunksize=TILE_ROWS):
                heaps.tile(tile.column(0).to_numpy(), matrix(tile.column(1)))
            held = np.isfinite(heaps.scores)
            queries = np.repeat(heaps.ids, held.sum(axis=1))
            answers, scores = heaps.found[held], heaps.scores[held]
        return pa.table({"query_id": queries, "vec_id": answers, "score": scores})

    found = asked.groupBy("g", "s", "dim").cogroup(offered.groupBy("g", "s", "dim")).applyInArrow(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
