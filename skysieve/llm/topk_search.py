"""Exact top-k inner-product search by MaxScore over dimension postings.

Vectors become integers, floor(scale * x). A dimension is a term; its postings
are the values of a shard's vectors in that dimension. For each query a term's
score bound in the shard is the largest product it can give. Terms are taken by
falling bound, and a shard's vectors in lots. Once the bounds of the rest sum to
less than the query's k-th best score so far, the rest are non-essential: only
vectors still competitive on the essential postings are probed in them, and
dropped as soon as their partial score plus the bounds left cannot reach the
k-th best. Each lot's hits raise the threshold for the next, so terms become
non-essential as the search goes on. Shards' best k are merged by rank.

Plan: shards and query blocks are dealt to the cells of a grid, so that a cell
holds a bounded number of vectors and of queries; only vectors and k results
per query and shard are shuffled. Nothing is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows

CELL_VECTORS, CELL_QUERIES = 60_000, 4_000
_FAR = -(2**62)


def _integers(values: list | None, scale: float) -> bytes | None:
    if values is None or any(x is None or not math.isfinite(x) for x in values):
        return None
    floors = np.floor(np.asarray(values, dtype=np.float64) * scale)
    return np.clip(floors, _FAR, -_FAR).astype(np.int64).tobytes()


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    schema = T.StructType([field(vectors, id_col, "id"), T.StructField("v", T.BinaryType())])

    def cut(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "v": [_integers(x, scale) for x in batch.column(1).to_pylist()]}

    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return map_rows(picked, schema, cut).filter("v IS NOT NULL")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """int64 rows padded with zeros to ``width``: a missing term has no posting."""
    rows = [np.frombuffer(x.as_py(), dtype=np.int64) for x in column]
    if all(len(r) == width for r in rows):
        return np.concatenate(rows).reshape(len(rows), width) if rows else np.zeros((0, width), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score down, id up)."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Shard:
    """Postings of a set of vectors by dimension, with their bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, largest_query: int):
        width = max(1, matrix.shape[1])
        reach = int(np.abs(matrix).max(initial=0)) * largest_query * width
        kind = np.float64 if reach < 2**53 else np.int64  # both exact here; floats are faster
        self.ids, self.width = ids, matrix.shape[1]
        self.postings = np.ascontiguousarray(matrix.T).astype(kind)
        self.high, self.low = self.postings.max(axis=1, initial=0), self.postings.min(axis=1, initial=0)

    def search(self, query: np.ndarray, own: object, k: int, lot: int = 256, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k but ``own``. Lots double in size from ``lot`` (or k) on."""
        q = query.astype(self.postings.dtype)
        bound = np.maximum(q * self.high, q * self.low)
        order = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # left[j]: bounds of order[j:], falling
        other = np.flatnonzero(self.ids != own)
        at, scores = other[:0], np.zeros(0, q.dtype)
        done, size = 0, max(lot, k)
        while done < len(other):
            some, done, size = other[done : done + size], done + size, 2 * size
            # Below k hits there is no threshold, and every term is essential.
            least = scores[-1] if len(at) >= k else None
            j = len(order) if least is None else int(np.searchsorted(-left, -least, side="right"))
            terms = order[: min(j, len(order))]
            part = q[terms] @ self.postings[np.ix_(terms, some)]
            while least is not None:
                keep = part + left[min(j, len(order))] >= least
                some, part = some[keep], part[keep]
                if j >= len(order) or not len(some):
                    break
                terms = order[j : j + step]
                part = part + q[terms] @ self.postings[np.ix_(terms, some)]
                j = min(j + step, len(order))
            at, scores = np.concatenate([at, some]), np.concatenate([scores, part])
            best = _best(scores, self.ids[at], k)
            at, scores = at[best], scores[best]
        return self.ids[at], scores.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k best vectors, its own id left out.

    Ties go to the smaller id. Null ids, null vectors and vectors with a null or
    non-finite component take no part. Vectors of unequal length meet as if
    padded with zeros. A repeated row is a candidate each time; a query id given
    more than once is asked once, with its smallest vector. Components are held
    to +-2^62 and scores wrap as longs. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    all_v = _quantised(vectors, id_col, vector_col, scale)
    all_q = _quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-m // cell_queries))
    across = max(-(-tasks // down), -(-n // cell_vectors))
    place = lambda c, parts, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(parts))
    shards = all_v.select("id", "v", place("id", across, 1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("j"))
    blocks = all_q.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("i"), place("id", down, 2).alias("j"))
    result = T.StructType([T.StructField("query_id", vectors.schema[id_col].dataType), field(vectors, id_col), T.StructField("score", T.LongType())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        asked, found, scores = [], [], []
        if len(left) and len(right):
            width = max(len(x.as_py()) // 8 for t in (left, right) for x in t["v"])
            wanted = _matrix(right["v"], width)
            shard = Shard(left["id"].to_numpy(), _matrix(left["v"], width), int(np.abs(wanted).max(initial=0)))
            for own, q in zip(right["id"].to_numpy(), wanted, strict=True):
                ids, s = shard.search(q, own, k)
                asked.append(np.full(len(ids), own))
                found.append(ids)
                scores.append(s)
        cols = [np.concatenate(x) if x else [] for x in (asked, found, scores)]
        return pa.table([pa.array(x, type=f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    near = shards.groupBy("i", "j").cogroup(blocks.groupBy("i", "j")).applyInArrow(cell, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
