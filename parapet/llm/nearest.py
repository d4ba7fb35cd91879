"""Approximate nearest neighbours by a block matrix join on int8 tiles, exact in its results.

Vectors are quantised to int8 with one scale each and packed into blocks: queries, and all
candidates. Every query block meets every candidate block in a tile, which is a group of its own.
The tile's int8 products give all inner products with an error bound per pair, from the norms of
vectors and quantisation errors. A pair survives if its upper bound reaches the k-th largest lower
bound of its query in the tile; survivors are computed again in double precision on the original
vectors, and a heap keeps the tile's k best. The tiles' lists are then merged per query. The
bounds hold for every pair, so no neighbour is lost: the results are those of brute force.

A tile holds at most QUERY_BLOCK x CANDIDATE_BLOCK products, whatever the size of the table. Rows
are dealt to blocks by a hash of the id, with a number of blocks that follows the counts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do null ids; rows equal in id and vector count once, other rows of one id are rows of
their own, as queries (their lists share the id) and as candidates, also of each other; vectors only meet
vectors of their own dimension; ties go to the smaller id; a query with fewer candidates than k
gets them all, one without any gets no row; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, QUERY_BLOCK, CANDIDATE_BLOCK = 20, 2048, 8192
#: Products of a slice of a tile that are held at once.
_SLICE = 1 << 21
_OUT = "query_id long, tag long, vec_id long, score double"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles, tag) of the rows that take part; ``tag`` tells the vectors of one id apart."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    return rows.distinct().withColumn("tag", F.xxhash64("vector"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors, and norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: sums below 2**24 are whole in float32, others in float64."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> list[tuple[int, int, int, float]]:
    """The k nearest candidates of each query in one tile as (query_id, tag, vec_id, score)."""
    if not len(queries) or not len(candidates):
        return []
    q, c = np.stack(queries["vector"].to_numpy()), np.stack(candidates["vector"].to_numpy())
    q_ids, c_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    q_tags, c_tags = queries["tag"].to_numpy(), candidates["tag"].to_numpy()
    q_codes, q_scale, q_norm, q_error = quantise(q)
    c_codes, c_scale, c_norm, c_error = quantise(c)
    out = []
    step = max(1, _SLICE // len(c_ids))
    for start in range(0, len(q_ids), step):
        part = slice(start, start + step)
        near = _products(q_codes[part], c_codes).astype(np.float64) * q_scale[part, None] * c_scale[None, :]
        # |xy - x'y'| <= |x'||ey| + |ex||y'| + |ex||ey|, and a little for the rounding of this sum.
        bound = q_norm[part, None] * c_error[None, :] + q_error[part, None] * (c_norm + c_error)[None, :]
        bound = bound * (1 + 1e-9) + 1e-12 * (1 + q_norm[part, None] * c_norm[None, :])
        own = (q_ids[part, None] == c_ids[None, :]) & (q_tags[part, None] == c_tags[None, :])
        low = np.where(own, -np.inf, near - bound)
        reach = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k] if len(c_ids) > k else np.full(len(low), -np.inf)
        rows, columns = np.nonzero((near + bound >= reach[:, None]) & ~own)
        for i in np.unique(rows):
            found = columns[rows == i] if len(rows) < 64 else columns[np.searchsorted(rows, i):np.searchsorted(rows, i, "right")]
            # Row-wise sums of products are the same for the same two vectors, wherever they stand.
            scores = (c[found] * q[start + i]).sum(axis=1)
            best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[found].tolist()))
            out.extend((int(q_ids[start + i]), int(q_tags[start + i]), vec, -score) for score, vec in best)
    return out


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows with a ``block`` of about ``size`` rows at most, and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def search(
    df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's ``k`` nearest by inner product; ``is_query`` is over ``vec_id``."""
    rows = usable(df, key, vector)
    queries, n_queries = _blocks(rows.where(is_query), query_block)
    candidates, n_candidates = _blocks(rows, candidate_block)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("block").alias("q"), spread(n_candidates).alias("c"), F.size("vector").alias("d"), "vec_id", "tag", "vector")
    right = candidates.select(spread(n_queries).alias("q"), F.col("block").alias("c"), F.size("vector").alias("d"), "vec_id", "tag", "vector")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(tile(a, b, k), columns=["query_id", "tag", "vec_id", "score"])

    found = left.groupBy("q", "c", "d").cogroup(right.groupBy("q", "c", "d")).applyInPandas(work, _OUT)
    order = W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
