"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Vectors are dealt to shards. In a shard every tree is a sorted array of 32-bit hash strings (signs of random projections). A
query descends each tree to its longest matching prefix, then all trees ascend together, one bit at a time, until the ranges
under the current prefixes hold enough candidates; these are scored exactly. For inner products the vectors are scaled to
the largest norm and get one more coordinate, so that a larger inner product is a smaller angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.common import stored

#: Length of the hash strings.
BITS = 32
RESULT = "query_id bigint, vec_id bigint, score double"


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def hash_strings(points: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """(trees, n) hash strings, the first bit highest."""
    packed = np.packbits((points @ normals > 0).reshape(len(points), trees, BITS), axis=2)
    return np.ascontiguousarray(packed).view(">u4")[:, :, 0].astype(np.uint64).T


class Forest:
    """Sorted arrays of one shard."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def ranges(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) bounds of the entries that share the first ``depth`` bits."""
        shift = np.uint64(BITS - depth)
        low = (q >> shift) << shift
        high = low + (np.uint64(1) << shift)
        lo = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low, strict=True)])
        hi = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, high, strict=True)])
        return lo, hi

    def candidates(self, q: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Per query the entries met when the trees ascend together until their ranges sum to ``enough`` or the roots are reached."""
        n = q.shape[1]
        lo = np.zeros(q.shape, np.int64)
        hi = np.zeros(q.shape, np.int64)
        open_ = np.arange(n)
        for depth in range(BITS, -1, -1):
            a, b = self.ranges(q[:, open_], depth)
            lo[:, open_], hi[:, open_] = a, b
            open_ = open_[(b - a).sum(axis=0) < enough]
            if not len(open_):
                break
        seen = np.zeros(self.order.shape[1], bool)
        for j in range(n):
            seen[:] = False
            for t in np.nonzero(hi[:, j] > lo[:, j])[0]:
                seen[self.order[t, lo[t, j]:hi[t, j]]] = True
            yield np.nonzero(seen)[0]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 96, share: float = 0.75, shard_rows: int = 4096,
            block_rows: int = 4096, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` nearest other rows, ties to the smaller id.

    ``queries`` selects the query rows of ``vectors``. Trees ascend until their ranges sum to ``share`` of the shard, ``100 * k`` at least. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; a query with fewer
    than ``k`` candidates found gets those. Of equal vectors only the k + 1 smallest ids can be among a query's nearest, so the
    others aren't indexed. Of rows that repeat an id the least vector is taken. An empty table gives no rows; all vectors of one call have
    one length.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("is_query"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")), "ann-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, most, dim = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    n_queries = rows.where("is_query").count()
    shards, blocks = max(1, math.ceil((n or 0) / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    same = Window.partitionBy("v").orderBy("vec_id")
    index = (rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
             .select(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v"))
    asked = (rows.where("is_query")
             .select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v"))
    scale = most or 1.0

    def search(key, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ours = ours.sort_values("vec_id")
        x, ids = np.stack(ours.v.to_numpy()), ours.vec_id.to_numpy()
        q, q_ids = np.stack(theirs.v.to_numpy()), theirs.vec_id.to_numpy()
        normals = planes(dim + 1, trees, seed)
        rest = np.sqrt(np.maximum(0.0, 1.0 - ((x / scale) ** 2).sum(axis=1)))
        forest = Forest(hash_strings(np.hstack([x / scale, rest[:, None]]), normals, trees))
        unit = q / np.linalg.norm(q / np.abs(q).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(q).max(axis=1, keepdims=True)
        asked_hashes = hash_strings(np.hstack([unit, np.zeros((len(q), 1))]), normals, trees)
        out = []
        for j, found in enumerate(forest.candidates(asked_hashes, max(100 * k, int(share * len(x))))):
            found = found[ids[found] != q_ids[j]]
            score = np.einsum("ij,j->i", x[found], q[j])
            if len(found) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.nonzero(score >= kth)[0]
                keep = keep[np.lexsort((ids[found[keep]], -score[keep]))][:k]
            else:
                keep = np.arange(len(found))
            out.append(pd.DataFrame({"query_id": q_ids[j], "vec_id": ids[found[keep]], "score": score[keep]}))
        return pd.concat(out)

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
