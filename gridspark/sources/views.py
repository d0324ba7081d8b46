"""Grid-shaped views of the benchmark tables: cells, runs, type facts, pixels and draw commands.

Cells have ``x, y, kind, level``; a column is all cells of an ``x``, ordered by ``y``. Runs have ``x, y0, run_len, kind``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.runs import compress_cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid: 64 cells for each vector."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("x"), F.posexplode("embedding").alias("y", "e"))
    e = F.col("e").cast("double")
    return cells.select("x", "y", F.floor(e * 4).cast("int").alias("kind"), (F.floor(F.abs(e) * 1000) % 256).alias("level"))


def g_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with holes: order lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"))
    return lines.agg(F.max("l_returnflag").alias("kind"), (F.sum("l_quantity").cast("long") % 256).alias("level"))


def g_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long columns: each user's events in the order of time."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr("user_id AS x", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y", "event_type AS kind", "value")


def r_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_cells(g_dense(spark, sf_dir), ["kind"])


def r_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_cells(g_events(spark, sf_dir), ["kind"])


#: Facts of each kind: kind, solid (unknown: null), layer, family mask, rank. Kind -3 is not listed.
KINDS = [(-2, True, "solid", 3, 1), (-1, False, "back", 4, 2), (0, True, "solid", 1, 3), (1, None, "liquid", 8, 4)]


def d_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind int, solid boolean, layer string, family_mask int, rank int")


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels: x, y, r, g, b, a."""
    level = F.col("level")
    return g_dense(spark, sf_dir).select("x", "y", level.alias("r"), (level * 3 % 256).alias("g"), (level * 7 % 256).alias("b"), F.when(F.col("kind") >= 0, F.lit(255).cast("long")).otherwise(level).alias("a"))


def cmds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw commands: rectangles with an order, an asset and a kind."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "o_custkey % 128 * 16 AS dx", "o_orderkey % 64 * 16 AS dy", "16 * (1 + o_orderkey % 3) AS dw", "16L AS dh", "o_orderpriority AS asset", "o_orderstatus AS kind"
    )


def g_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid with the fields of world files: type (some unknown), active, shape, level and liquid (0: dry), wall, frame_x and frame_y
    (null: none), is_solid."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("x"), F.posexplode("embedding").alias("y", "f"))
    return cells.selectExpr("x", "y", "cast(f AS double) AS e").selectExpr(
        "x", "y", "cast(floor(abs(e) * 100000) % 760 AS int) AS type", "floor(e * 4) <> -1 AS active", "cast(CASE WHEN floor(abs(e) * 7000) % 9 <= 5 THEN floor(abs(e) * 7000) % 9 ELSE 0 END AS int) AS shape",
        "CASE WHEN floor(e * 4) = 1 THEN floor(abs(e) * 1000) % 256 ELSE 0L END AS level", "cast(CASE WHEN floor(e * 4) = 1 THEN 1 + floor(abs(e) * 100000) % 4 ELSE 0 END AS int) AS liquid",
        "cast(floor(abs(e) * 900) % 320 AS int) AS wall", "cast(CASE WHEN floor(abs(e) * 100000) % 3 = 0 THEN floor(abs(e) * 100000) % 5 * 18 - 18 END AS int) AS frame_x",
        "cast(CASE WHEN floor(abs(e) * 100000) % 3 = 0 THEN 0 END AS int) AS frame_y", "floor(e * 4) = -2 AS is_solid",
    )


#: The same views for DuckDB.
VIEWS = {
    "g_dense": "SELECT vec_id AS x, (i - 1)::INT AS y, floor(embedding[i]::DOUBLE * 4)::INT AS kind, floor(abs(embedding[i]::DOUBLE) * 1000)::BIGINT % 256 AS level FROM embeddings, range(1, 65) r(i)",
    "g_sparse": "SELECT l_orderkey AS x, l_linenumber AS y, max(l_returnflag) AS kind, sum(l_quantity)::BIGINT % 256 AS level FROM lineitem GROUP BY 1, 2",
    "g_events": "SELECT user_id AS x, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS y, event_type AS kind, value FROM events",
    "g_tiles": """SELECT vec_id AS x, (i - 1)::INT AS y, (t % 760)::INT AS type, floor(e * 4) <> -1 AS active, (CASE WHEN floor(abs(e) * 7000)::BIGINT % 9 <= 5 THEN floor(abs(e) * 7000)::BIGINT % 9 ELSE 0 END)::INT AS shape,
        CASE WHEN floor(e * 4) = 1 THEN floor(abs(e) * 1000)::BIGINT % 256 ELSE 0 END AS level, (CASE WHEN floor(e * 4) = 1 THEN 1 + t % 4 ELSE 0 END)::INT AS liquid, (floor(abs(e) * 900)::BIGINT % 320)::INT AS wall,
        (CASE WHEN t % 3 = 0 THEN t % 5 * 18 - 18 END)::INT AS frame_x, (CASE WHEN t % 3 = 0 THEN 0 END)::INT AS frame_y, floor(e * 4) = -2 AS is_solid
        FROM (SELECT vec_id, i, embedding[i]::DOUBLE AS e, floor(abs(embedding[i]::DOUBLE) * 100000)::BIGINT AS t FROM embeddings, range(1, 65) r(i))""",
    "r_dense": "SELECT x, min(y) AS y0, count(*)::INT AS run_len, kind FROM (SELECT *, y - row_number() OVER (PARTITION BY x, kind ORDER BY y) AS grp FROM g_dense) GROUP BY x, kind, grp",
    "r_events": "SELECT x, min(y) AS y0, count(*)::INT AS run_len, kind FROM (SELECT *, y - row_number() OVER (PARTITION BY x, kind ORDER BY y) AS grp FROM g_events) GROUP BY x, kind, grp",
    "d_kind": "SELECT * FROM (VALUES (-2, TRUE, 'solid', 3, 1), (-1, FALSE, 'back', 4, 2), (0, TRUE, 'solid', 1, 3), (1, NULL, 'liquid', 8, 4)) v(kind, solid, layer, family_mask, rank)",
    "pix": "SELECT x, y, level AS r, level * 3 % 256 AS g, level * 7 % 256 AS b, CASE WHEN kind >= 0 THEN 255 ELSE level END AS a FROM g_dense",
    "cmds": "SELECT o_orderkey AS seq, o_custkey % 128 * 16 AS dx, o_orderkey % 64 * 16 AS dy, 16 * (1 + o_orderkey % 3) AS dw, 16::BIGINT AS dh, o_orderpriority AS asset, o_orderstatus AS kind FROM orders",
}


def with_views(sql: str) -> str:
    """``sql``, a query that may begin with further tables after a comma, with those of the views that it needs, each made once."""
    needed, text = [], sql
    for name in reversed(VIEWS):  # a view uses earlier ones only
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, f"{name} AS MATERIALIZED ({VIEWS[name]})")
            text += VIEWS[name]
    recursive = "RECURSIVE " if re.search(r"UNION ALL SELECT [a-z]+\.", sql) else ""
    more = sql.lstrip()
    if more.startswith(","):
        return f"WITH {recursive}{', '.join(needed)}{more if needed else more[1:]}"
    return (f"WITH {', '.join(needed)} " if needed else "") + more
