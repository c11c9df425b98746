"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks.

Vectors are whole numbers: floor(256 x) of each component. A task holds a slice of candidates, column by column, and a
group of queries; both have bounded size, and slices and groups meet by key, so nothing is broadcast. Dimensions are
taken in blocks, those with the most mass first. After each block a candidate's score lies within the product of the
remaining lengths (Cauchy-Schwarz) of its partial score; candidates whose upper bound lies below the k-th lower bound
cannot be among the k best of their slice, and the rest are compacted before the next block. What survives all blocks
has its exact score. Each slice gives k rows a query, and the k best of those are the answer.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; vectors are compared
with those of their own length; a candidate row is any row but the query's own, so rows that repeat an id are candidates;
equal scores go by smaller vec_id, null ids last. Vectors with components beyond 2**24 after scaling are compared in whole
numbers of any size, without the bounds; components are held to 64 bits, and so is a score. Fewer than k candidates give fewer
rows, an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

K = 5
SCALE = 256
SLICE, GROUP = 8192, 2048
DIMENSION_BLOCK = 8
_LARGEST, _MOST = 1 << 24, (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, v (array of long) of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _large(m: np.ndarray) -> np.ndarray:
    """Which vectors hold a component whose products and sums may not be exact as floating-point numbers."""
    return ((m > _LARGEST) | (m < -_LARGEST)).any(axis=1)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> list[list[int]]:
    """All scores, as Python's integers."""
    return (queries.astype(object) @ vectors.T.astype(object)).tolist() if len(queries) and len(vectors) else [[] for _ in queries]


def search_slice(queries: np.ndarray, query_rows: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """best() for vectors of any size: large queries meet all candidates, and large candidates all queries, in exact numbers."""
    big_q, big_v = _large(queries), _large(vectors)
    if not big_q.any() and not big_v.any():
        return best(queries.astype(np.float64), query_rows, bounds, vectors.astype(np.float64), rows, ids, k)
    small = np.flatnonzero(~big_v)
    plain = iter(best(queries[~big_q].astype(np.float64), query_rows[~big_q], bounds[~big_q], vectors[small].astype(np.float64), rows[small], ids[small], k))
    large = np.flatnonzero(big_v)
    for_all, for_big = iter(_exact(queries[~big_q], vectors[large])), iter(_exact(queries[big_q], vectors))
    out = []
    for i, is_big in enumerate(big_q.tolist()):
        if is_big:
            found = list(zip(next(for_big), range(len(vectors))))
        else:
            places, scores = next(plain)
            found = list(zip(scores.tolist(), small[places].tolist())) + list(zip(next(for_all), large.tolist()))
        held = ((max(min(score, _MOST), -_MOST - 1), j) for score, j in found if rows[j] != query_rows[i])
        found = sorted((-score, int(ids[j]), int(rows[j]), j) for score, j in held)[:k]
        out.append((np.array([x[3] for x in found], np.int64), np.array([-x[0] for x in found], np.int64)))
    return out


def best(queries: np.ndarray, query_rows: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSION_BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query: places of its k best vectors and their scores, of those that reach its bound. ids order ties."""
    mass = (vectors**2).sum(axis=0) * (queries**2).sum(axis=0)
    by = np.argsort(-mass, kind="stable")
    columns, q = np.ascontiguousarray(vectors[:, by].T), queries[:, by]
    starts = list(range(0, len(by), step))
    # lengths of what each block leaves, rounded up a little
    rest_v = [np.sqrt((columns[s + step :] ** 2).sum(axis=0)) * (1 + 1e-12) for s in starts]
    rest_q = [np.sqrt((q[:, s + step :] ** 2).sum(axis=1)) * (1 + 1e-12) for s in starts]
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero(rows != query_rows[i])
        part = np.zeros(len(alive))
        for s, rv, rq in zip(starts, rest_v, rest_q):
            block = columns[s : s + step]
            part += q[i, s : s + step] @ (block if len(alive) == block.shape[1] else block[:, alive])
            slack = rv[alive] * rq[i]
            reach = bounds[i]
            if len(alive) > k:
                low = part - slack
                reach = max(reach, np.partition(low, len(low) - k)[len(low) - k])
            keep = part + slack >= reach - 0.5
            if not keep.all():
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        order = np.lexsort((rows[alive], ids[alive], -part))[:k]
        out.append((alive[order], part[order].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per query row (is_query, over vec_id) and rank: query_id, rank, vec_id, score."""
    rows = cut(quantized(vectors, id_col, vector_col, scale), "quantized").withColumn("dim", F.size("v"))
    wanted = rows.where(is_query)
    n, n_queries = rows.count(), wanted.count()
    slices, groups = max(1, math.ceil(n / SLICE)), max(1, math.ceil(n_queries / GROUP))
    deal = lambda into: F.pmod(F.xxhash64("row"), F.lit(into)).cast("int")
    each = lambda into: F.explode(F.sequence(F.lit(0), F.lit(into - 1)))
    left = wanted.select("row", "vec_id", "v", "dim", deal(groups).alias("g"), each(slices).alias("s"))
    # both sides come from one table: names of its own keep the optimizer from taking one side's columns for the other's
    right = rows.select(F.col("row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.col("dim").alias("c_dim"), deal(slices).alias("c_s"), each(groups).alias("c_g"))
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not (len(queries) and len(candidates)):
            return schema.empty_table()
        q_rows, rows_ = queries.column("row").to_numpy(), candidates.column("c_row").to_numpy()
        ids = candidates.column("c_id")
        sortable = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        found = search_slice(_matrix(queries.column("v")), q_rows, queries.column("bound").to_numpy(), _matrix(candidates.column("c_v")), rows_, sortable, k)
        sizes = [len(p) for p, _ in found]
        places = np.concatenate([p for p, _ in found])
        return pa.table(
            [pa.array(np.repeat(q_rows, sizes)), queries.column("vec_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(rows_[places]), ids.take(pa.array(places)), pa.array(np.concatenate([s for _, s in found]))],
            schema=schema,
        )

    def scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.groupBy("dim", "g", "s").cogroup(candidates.groupBy("c_dim", "c_g", "c_s")).applyInArrow(search, "query_row long, query_id long, row long, vec_id long, score long")

    none = F.lit(float("-inf"))
    found = scores(left.where("s = 0").withColumn("bound", none), right.where("c_s = 0"))
    if slices > 1:
        found = cut(found, "first-slice")
        bounds = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
        rest = left.where("s > 0").join(bounds.select(F.col("query_row").alias("row"), "least"), "row", "left").withColumn("bound", F.coalesce("least", none)).drop("least")
        found = found.unionByName(scores(rest, right.where("c_s > 0")))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
