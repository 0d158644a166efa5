"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table itself. A vector is represented by its nearest pivots in order; it is
posted in the inverted files of the first few, together with that order and its components. A query
looks into the files of more of its own nearest pivots. In each file (or block of it) the vectors are
ranked by footrule distance between the two orders, cut off at the depth kept, and the best share of
them is reranked by exact distance; a query's results from all files are merged. A vector that several
of these files hold counts only in the one whose pivot is nearest to the query.

Large files are dealt in blocks, and so are the queries of one file: a task compares bounded numbers of
both. Of identical vectors no query can name more than the k + 1 of smallest id, so only these are
posted; this is exact. Queries that found fewer than k are compared with all vectors, again in blocks.

Ids that are null take no part; of rows that share an id, the one with the smallest vector is taken.
Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different length are never near each other: each length has pivots of its own. Further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Pivots; how deep their order is kept; files that a vector is posted in; files that a query looks into.
PIVOTS, DEPTH, POSTED, PROBED = 128, 64, 4, 48
#: The share of a block's vectors that is reranked, and how many at least.
RERANK_SHARE, RERANK_LEAST = 0.25, 128
#: Vectors and queries that one task compares (expected numbers).
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048

POST = "role int, pivot int, x int, y int, vec_id long, vector binary, nearest binary"
FOUND = "query_id long, vec_id long, score double"


def takes_part(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    kind = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, kind) & F.exists(vector, lambda x: x != 0), F.lit(False))


def chosen_pivots(vectors: DataFrame, n_pivots: int, k: int) -> dict[int, np.ndarray]:
    """For each length the pivots: the vectors whose ids have the smallest hashes, at most n_pivots and half of all."""
    out = {}
    for row in vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        own = vectors.where(F.col("dim") == row.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(n_pivots, row.n // 2))).collect()
        out[row.dim] = np.array([r.vector for r in own], np.float64)
    return out


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots in order."""
    apart = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :depth].astype(np.uint8)


def places(nearest: np.ndarray, n_pivots: int, depth: int) -> np.ndarray:
    """The place of every pivot in each order; those that the order lacks share the place behind it."""
    out = np.full((len(nearest), n_pivots), depth, np.int16)
    np.put_along_axis(out, nearest.astype(np.int64), np.arange(nearest.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def posted(vectors: DataFrame, pivots: dict[int, np.ndarray], depth: int, n_files: int, role: int, number: str = "<f8") -> DataFrame:
    """Rows (dim, role, pivot, vec_id, vector, nearest): one for each of the n_files nearest pivots; components travel as `number`."""
    size = np.dtype(number).itemsize
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors of each length

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                values = np.asarray(own.column(2).flatten(), np.float64).reshape(-1, int(dim))
                near = nearest_pivots(values, shared.value[int(dim)], depth)
                files = min(n_files, near.shape[1])
                n = len(near) * files
                raw, orders = values.astype(number).tobytes(), near.tobytes()
                vectors_out = [raw[i : i + size * int(dim)] for i in range(0, len(raw), size * int(dim))]
                orders_out = [orders[i : i + near.shape[1]] for i in range(0, len(orders), near.shape[1])]
                rows = pa.array(np.repeat(np.arange(len(near)), files))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, role, np.int32)), pa.array(near[:, :files].astype(np.int32).reshape(-1)), own.column(1).take(rows), pa.array(vectors_out, pa.binary()).take(rows), pa.array(orders_out, pa.binary()).take(rows)], names=["dim", "role", "pivot", "vec_id", "vector", "nearest"])

    return vectors.select("dim", "vec_id", "vector").mapInArrow(run, "dim int, role int, pivot int, vec_id long, vector binary, nearest binary")


def blocks_of(rows: DataFrame, most: int) -> dict[tuple[int, int], int]:
    """The number of blocks of each file; one row for each pivot comes to the driver."""
    return {(r.dim, r.pivot): max(1, -(-r.n // most)) for r in rows.groupBy("dim", "pivot").agg(F.count("*").alias("n")).collect()}


def compared(data: DataFrame, queries: DataFrame, k: int, depth: int, probed: int, share: float, least: int, exact: bool = False, number: str = "<f8") -> DataFrame:
    """(query_id, vec_id, score): the k nearest found in each pair of blocks."""
    spark = data.sparkSession
    sizes, asked = blocks_of(data, BLOCK_ROWS), blocks_of(queries, BLOCK_QUERIES)
    rows = [(dim, pivot, n, asked[dim, pivot]) for (dim, pivot), n in sizes.items() if (dim, pivot) in asked]
    if not rows:
        return queries.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    grid = F.broadcast(spark.createDataFrame(rows, "dim int, pivot int, n_x int, n_y int"))

    def dealt(side: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        side = side.join(grid, ["dim", "pivot"])
        side = side.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(own_blocks)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).select("dim", "pivot", "x", "y", "vec_id", "vector", "nearest")

    left, right = dealt(data, "x", "n_x", "y", "n_y"), dealt(queries, "y", "n_y", "x", "n_x")

    def compare(key, ours, asking):
        if not len(ours) or not len(asking):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim, pivot = int(key[0].as_py()), int(key[1].as_py())
        ours, asking = ours.sort_by("vec_id"), asking.sort_by("vec_id")
        ids, asked_ids = np.asarray(ours.column("vec_id")), np.asarray(asking.column("vec_id"))
        vectors, wanted = (np.frombuffer(b"".join(t.column("vector").to_pylist()), number).astype(np.float64).reshape(-1, dim) for t in (ours, asking))
        orders, orders_asked = (np.frombuffer(b"".join(t.column("nearest").to_pylist()), np.uint8).reshape(len(t), -1) for t in (ours, asking))
        n_pivots = 1 + int(max(orders.max(), orders_asked.max()))
        depth_here = orders.shape[1]
        place, place_asked = places(orders, n_pivots, depth_here), places(orders_asked, n_pivots, depth_here)
        found = []
        for q in range(len(asked_ids)):
            if exact:
                own = np.arange(len(ids))
            else:
                # Only those that are in no file of a pivot nearer to the query.
                nearer = orders_asked[q, : int(place_asked[q, pivot])]
                own = np.flatnonzero((place[:, nearer] >= POSTED).all(axis=1)) if len(nearer) else np.arange(len(ids))
            own = own[ids[own] != asked_ids[q]]
            keep = max(least, int(np.ceil(share * len(own))))
            if not exact and len(own) > keep:
                footrule = np.abs(place[own] - place_asked[q][None, :]).sum(axis=1)
                own = own[np.argsort(footrule, kind="stable")[:keep]]
            apart = np.sqrt(((vectors[own] - wanted[q]) ** 2).sum(axis=1))
            best = np.lexsort((ids[own], apart))[:k]
            found.append((np.full(len(best), asked_ids[q]), ids[own[best]], apart[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["dim", "pivot", "x", "y"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", n_pivots: int = PIVOTS, depth: int = DEPTH, probed: int = PROBED, share: float = RERANK_SHARE, least: int = RERANK_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: up to k nearest found of every row where is_query holds (an expression over vec_id)."""
    if n_pivots > 256:
        raise ValueError("n_pivots must be at most 256: orders hold a pivot in a byte")
    taken = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & takes_part(F.col("vector")))
    # Squares of huge components overflow; such vectors are as good as infinitely far, yet stay defined.
    vectors = written(taken.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = written(vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "distinct")
    # Single-precision components travel as they are; distances are in double precision.
    number = "<f4" if table.schema[vector].dataType == T.ArrayType(T.FloatType(), table.schema[vector].dataType.containsNull) else "<f8"
    pivots = chosen_pivots(few, n_pivots, k)
    data = written(posted(few, pivots, depth, POSTED, 0, number), "postings")
    asking = vectors.where(is_query)
    queries = written(posted(asking, pivots, depth, probed, 1, number), "queries")
    first = written(ranked(compared(data, queries, k, depth, probed, share, least, number=number), k), "found")
    # Those that found fewer than k are compared with everything (once each: the file of the first pivot becomes that of all).
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    lacking = asking.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti")
    if lacking.isEmpty():
        return first.select("query_id", "rank", "vec_id", "score")
    once = posted(few, pivots, depth, 1, 0, number).withColumn("pivot", F.lit(0))
    again = ranked(compared(once, posted(lacking, pivots, depth, 1, 1, number).withColumn("pivot", F.lit(0)), k, depth, probed, 1.0, least, exact=True, number=number), k)
    whole = first.join(enough, "query_id", "left_semi").unionByName(again)
    return whole.select("query_id", "rank", "vec_id", "score")
