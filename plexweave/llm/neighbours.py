"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are quantised to int8 with a scale of their own, and the norm of what that leaves over is kept. Queries and
candidates meet in tiles of bounded size: every block of queries with every block of candidates. In a tile the int8
product gives each inner product within a proven bound, so all but a few candidates fall away; those left are computed
again in double precision from the original vectors and go through one heap for each query. The best of all tiles are
then merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches

#: Bytes of a block of queries and of candidates, about, over a hash: every block of one kind is copied to each of the other.
QUERY_BYTES, CANDIDATE_BYTES = 16 << 20, 64 << 20
#: Smaller tables are cut into up to so many blocks of either kind, of at least so many vectors.
LEAST_BLOCKS, LEAST_QUERIES, LEAST_CANDIDATES = 8, 512, 4096
#: Candidates multiplied at once within a tile.
STRIP = 1024
#: Sums of products of int8 values are exact in float32 over so many dimensions.
EXACT_DIMS = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (int8), scale, rest: x is about scale * codes, and rest is the norm of the difference."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows: float32 matrix products over at most EXACT_DIMS dimensions each."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return out


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the dimensions, so equal rows have equal values."""
    out = np.zeros(len(x))
    for d in range(len(q)):
        out += q[d] * x[:, d]
    return out


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
    """(query, score, candidate): the k nearest of a tile for each query, without the query itself."""
    q_codes, q_scale, q_rest = quantised(q)
    q_norm = np.linalg.norm(q_codes * q_scale[:, None], axis=1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for at in range(0, len(ids), STRIP):
        own, strip = ids[at : at + STRIP], x[at : at + STRIP].astype(np.float64)
        codes, scale, rest = quantised(strip)
        near = tile_product(q_codes, codes) * q_scale[:, None] * scale
        norm = np.linalg.norm(codes * scale[:, None], axis=1)
        bound = q_norm[:, None] * rest + q_rest[:, None] * norm + q_rest[:, None] * rest
        bound += 1e-9 * (np.abs(near) + bound) + 1e-300
        self_ = q_ids[:, None] == own
        low = np.where(self_, -np.inf, near - bound)
        high = np.where(self_, -np.inf, near + bound)
        if len(own) > k:
            least = np.partition(low, len(own) - k, axis=1)[:, len(own) - k]
        else:
            least = np.full(len(q_ids), -np.inf)
        for i, heap in enumerate(heaps):
            floor = max(least[i], heap[0][0]) if len(heap) == k else least[i]
            some = np.flatnonzero((high[i] >= floor) & ~self_[i])
            if not len(some):
                continue
            scores = exact_products(q[i], strip[some])
            if len(some) > k:  # ties stay in, for the smaller id
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                some, scores = some[scores >= cut], scores[scores >= cut]
                order = np.lexsort((own[some], -scores))[:k]
                some, scores = some[order], scores[order]
            for s, c in zip(scores.tolist(), own[some].tolist()):
                entry = (s, -c)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    for query, heap in zip(q_ids.tolist(), heaps):
        for s, c in heap:
            yield query, s, -c


def _tile(group: pa.Table, k: int) -> pa.Table:
    ids = group["vec_id"].to_numpy()
    asks = group["asks"].to_numpy(zero_copy_only=False).astype(bool)
    vectors = group["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(ids), -1)
    rows = list(best_of_tile(ids[asks], x[asks].astype(np.float64), ids[~asks], x[~asks], k)) if asks.any() and not asks.all() else []
    q, s, c = zip(*rows) if rows else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "score": pa.array(s, pa.float64()), "vec_id": pa.array(c, pa.int64())})


def _usable(name: str):
    """Whether a vector column has components, all finite and not all zero."""
    v = F.col(name)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows.

    Nearness is the largest inner product in double precision; ties go to the smaller id. Vectors that are null, empty
    or zero, or hold null, NaN or infinite components take no part, nor do rows with a null id; vectors of different
    lengths are not compared. Of rows that repeat an id, each is a candidate, but none for a query of its own id; a
    repeated query is asked once, with the vector that comes first in order. Fewer candidates than k are all
    returned; an empty table gives an empty result.
    """
    bound_batches(vectors.sparkSession)
    # single precision is sent as it is; products are taken in double precision
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
        .where(_usable("vector"))
    )
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_rows, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    n_queries, width = queries.count(), dims * (4 if single else 8)
    blocks = lambda n, most, least: max(1, math.ceil(n * width / most), min(LEAST_BLOCKS, n // least))
    q_blocks, c_blocks = blocks(n_queries, QUERY_BYTES, LEAST_QUERIES), blocks(n_rows, CANDIDATE_BYTES, LEAST_CANDIDATES)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "vector", F.lit(True).alias("asks"), block(q_blocks).alias("i"), every_block(c_blocks).alias("j"))
    offered = rows.select("vec_id", "vector", F.lit(False).alias("asks"), every_block(q_blocks).alias("i"), block(c_blocks).alias("j"))
    tiles = asked.unionByName(offered).withColumn("dims", F.size("vector")).groupBy("i", "j", "dims")
    found = tiles.applyInArrow(lambda group: _tile(group, k), "query_id long, score double, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
