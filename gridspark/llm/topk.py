"""Exact top-k search by a Voronoi kNN join.

Largest inner product becomes nearest neighbour: with M the largest length of any vector, data get one more component
sqrt(M^2 - |x|^2) and queries a zero, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x. A bounded sample of the data gives pivots;
every vector belongs to its nearest pivot. Summaries of the groups (largest distances, the k + 1 smallest distances to
each pivot) bound how far a query group's k-th neighbour can be, and so which ring around each pivot its queries can
need. Data go only to the query groups whose ring they lie in, are scored there in exact integers, and each query's
best are merged.

Groups are cut into blocks: a task holds ``DATA_BLOCK`` data and ``QUERY_BLOCK`` queries at most, however large a group is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DATA_BLOCK, QUERY_BLOCK = 20_000, 2_000
#: Bounds are widened by this share of M, far more than rounding can make.
SLACK = 1e-6


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double. Rows with a null id, a null vector or a null or non-finite
    component are left out."""
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), value.alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None) -> DataFrame:
    """The ``k`` largest inner products of each row of ``queries (id, v)`` with the rows of ``data (id, v)``: query_id, rank, vec_id, score.

    ``v`` are arrays of longs. A query never meets data of its own id, or of another length. Ties go to the smaller id;
    fewer than k candidates give fewer rows; rows that repeat an id are candidates of their own, and queries that
    repeat one are ranked together. Scores that may not fit in a long are an error. Empty tables give no rows. Unless given, the
    pivots grow with the root of the rows, from 8 to 64: what reaches the driver is k + 1 distances for each.
    """
    data = data.withColumn("dim", F.size("v"))
    dims = [r.dim for r in data.select("dim").distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    queries = queries.withColumn("dim", F.size("v"))
    parts = [_search(data.where(F.col("dim") == d).drop("dim"), queries.where(F.col("dim") == d).drop("dim"), k, pivots) for d in sorted(dims)]
    if not parts:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rings(need: dict[int, dict[int, tuple[float, float]]], data: dict[int, int], queries: dict[int, int]) -> tuple[list[tuple], list[int]]:
    """(cell, group, low, high, blocks of data, blocks of queries) of what each query group needs, and the groups that were merged.

    Groups that need cells with more than half of all data each are merged into one, under the smallest of their numbers, with the
    widest of their rings: so data that no bound keeps from them are sent once for all of them.
    """
    total = sum(data.values())
    wide = [i for i, cells in need.items() if 2 * sum(data[j] for j in cells) > total]
    merged = wide if len(wide) > 1 else []
    if merged:
        both: dict[int, tuple[float, float]] = {}
        for i in merged:
            for j, (low, high) in need[i].items():
                a, b = both.get(j, (low, high))
                both[j] = min(a, low), max(b, high)
        queries = {i: n for i, n in queries.items() if i not in merged} | {min(merged): sum(queries[i] for i in merged)}
        need = {i: c for i, c in need.items() if i not in merged} | {min(merged): both}
    return [(j, i, low, high, -(-data[j] // DATA_BLOCK), -(-queries[i] // QUERY_BLOCK)) for i, cells in need.items() for j, (low, high) in cells.items()], merged


def _search(data: DataFrame, queries: DataFrame, k: int, pivots: int | None) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = lambda df: df.agg(F.max(square).alias("m")).first().m or 0.0
    most, own = longest(data), longest(queries)
    if most * own >= 2.0**124:
        raise ValueError("inner products may not fit in a long")
    pivots = pivots or min(64, max(8, int(data.count() ** 0.5) // 64))
    exact = np.float64 if max(most, own) < 2.0**52 else np.int64
    sample = data.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").collect()
    centre = np.unique(np.array([r.v for r in sample], np.float64).reshape(len(sample), -1), axis=0)
    lift = lambda v: np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1)))
    centre_lift = lift(centre)

    def near(lifted: bool):
        def run(batches):
            for batch in batches:
                v = np.array(batch["v"].flatten().to_numpy(), np.float64).reshape(batch.num_rows, -1)
                up = lift(v) if lifted else np.zeros(len(v))
                apart = ((v * v).sum(axis=1) + up * up)[:, None] + most - 2 * (v @ centre.T + up[:, None] * centre_lift)
                cell = apart.argmin(axis=1)
                far = np.sqrt(np.maximum(0.0, apart[np.arange(len(v)), cell]))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(cell, pa.int32()), pa.array(far)], ["id", "v", "cell", "far"])

        return run

    schema = "id long, v array<long>, cell int, far double"
    data, queries = stored(data.mapInArrow(near(True), schema).withColumn("s", F.monotonically_increasing_id()), "cells"), stored(queries.mapInArrow(near(False), schema), "queries")

    order = Window.partitionBy("cell").orderBy("far")
    least = data.select("cell", "far").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).collect()  # k + 1 for each pivot
    cells = {r.cell: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    groups = {r.cell: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("high")).collect()}
    between = np.sqrt(np.maximum(0.0, 2 * most - 2 * (centre @ centre.T + np.outer(centre_lift, centre_lift))))
    slack, need = SLACK * (most**0.5 + own**0.5 + 1), {}
    for i, group in groups.items():
        bounds = sorted(group.high + between[i, r.cell] + r.far for r in least)
        theta = bounds[k] if len(bounds) > k else float("inf")
        for j, cell in cells.items():
            low, high = between[i, j] - group.high - theta - slack, between[i, j] + group.high + theta + slack
            if low <= cell.high and high >= cell.low:
                need.setdefault(i, {})[j] = float(low), float(high)
    rings, merged = _rings(need, {j: c.n for j, c in cells.items()}, {i: g.n for i, g in groups.items()})
    spark = data.sparkSession
    if not rings:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    ring = F.broadcast(spark.createDataFrame(rings, "cell int, group int, low double, high double, n_data int, n_query int"))  # at most pivots^2 rows
    part = lambda n, *more: F.pmod(F.xxhash64("id", "v", *more), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cell", "group", "d", "q"]
    if merged:
        queries = queries.withColumn("cell", F.when(F.col("cell").isin(merged), F.lit(min(merged))).otherwise(F.col("cell")))
    left = data.join(ring, "cell").where("far between low and high").withColumn("d", part("n_data", "s"))  # rows that repeat are dealt out by their stored number
    left = left.withColumn("q", every("n_query")).select(*keys, "id", "v")
    right = queries.withColumnRenamed("cell", "group").join(ring, "group").withColumn("q", part("n_query")).withColumn("d", every("n_data")).select(*keys, "id", "v")

    def solve(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = candidates["id"].to_numpy(), asked["id"].to_numpy()
        out = []
        if len(ids) and len(names):
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).astype(exact)
            order = np.argsort(ids, kind="stable")
            ids, x, q = ids[order], matrix(candidates)[order], matrix(asked)
            for at in range(0, len(q), 64):
                scores = (q[at : at + 64] @ x.T).astype(np.int64)
                for name, row in zip(names[at : at + 64], scores):
                    allowed = np.flatnonzero(ids != name)
                    row = row[allowed]
                    if len(row) > k:
                        floor = np.partition(row, len(row) - k)[len(row) - k]
                        kept = np.flatnonzero(row >= floor)
                        kept = kept[np.argsort(-row[kept], kind="stable")][:k]
                    else:
                        kept = np.arange(len(row))
                    out.append((np.full(len(kept), name), ids[allowed[kept]], row[kept]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
