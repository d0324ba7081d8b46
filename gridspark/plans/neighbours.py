"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions.scalars import wall_variant
from gridspark.operators import joins
from gridspark.plans.registry import at, query
from gridspark.sources import facts, views

C = F.col

MASK4 = """(coalesce((SELECT 1 FROM p WHERE p.x = g.x AND p.y = g.y - 1), 0) + coalesce((SELECT 2 FROM p WHERE p.x = g.x - 1 AND p.y = g.y), 0)
    + coalesce((SELECT 4 FROM p WHERE p.x = g.x + 1 AND p.y = g.y), 0) + coalesce((SELECT 8 FROM p WHERE p.x = g.x AND p.y = g.y + 1), 0))::INT"""
#: The kinds above and below each cell, and then those of the columns beside.
TALL = f", v AS (SELECT x, y, kind, {at('kind', 'y', -1)} AS n, {at('kind', 'y', 1)} AS s FROM g_dense)"
EIGHT = ", ".join(f"{at(value, 'x', step)} AS {prefix}{side}" for prefix, value in (("", "kind"), ("n", "n"), ("s", "s")) for side, step in (("w", -1), ("e", 1)))


@query("SELECT x, y, CASE WHEN level % 9 = 0 OR level % 11 = 0 THEN FALSE ELSE solid END AS is_solid FROM g_dense LEFT JOIN d_kind USING (kind)")
def jn01_classify_material(spark, d):
    level = F.col("level")
    return joins.classify_material(views.g_dense(spark, d), views.d_kind(spark), level % 9 != 0, level % 11 == 0).select("x", "y", "is_solid")


@query(
    """SELECT x, y, CASE WHEN coalesce(family_mask, 0) & 1 <> 0 THEN 'special' WHEN coalesce(family_mask, 0) & 2 <> 0 THEN 'plant' WHEN coalesce(family_mask, 0) & 4 <> 0 THEN 'furniture'
    WHEN coalesce(family_mask, 0) & 8 <> 0 THEN 'misc' WHEN level % 2 = 0 THEN 'stored' WHEN level % 3 = 0 THEN 'rope' WHEN level % 5 = 0 THEN 'ordinary' ELSE 'unsupported' END AS family
FROM g_dense LEFT JOIN d_kind USING (kind)"""
)
def jn02_dispatch_family(spark, d):
    level = F.col("level")
    return joins.dispatch_family(views.g_dense(spark, d), views.d_kind(spark), level % 2 == 0, level % 3 == 0, level % 5 == 0).select("x", "y", "family")


SOLID_SQL = f"type IN ({', '.join(map(str, facts.SOLID))})"


@query(
    f""" SELECT x, y, CASE WHEN NOT active OR level % 11 = 5 THEN FALSE WHEN type >= 754 OR type = 379 THEN NULL ELSE ({SOLID_SQL}) AND type NOT IN ({', '.join(map(str, facts.SOLID_TOP))}) END AS is_solid,
    CASE WHEN type >= 754 OR type = 379 THEN NULL WHEN ({SOLID_SQL}) OR type IN ({', '.join(map(str, facts.DRAWN_SOLID))}) THEN 'solid' ELSE 'non-solid' END AS draw_layer FROM g_tiles"""
)
def jn01_materials_of_types(spark, d):
    """Cells of world files with the facts of all known types."""
    dim = facts.materials(spark).withColumnRenamed("type", "kind")
    cells = views.g_tiles(spark, d).drop("is_solid").withColumnRenamed("type", "kind")
    return joins.classify_material(cells, dim, C("active"), C("level") % 11 == 5).join(dim.select("kind", "draw_layer"), "kind", "left").select("x", "y", "is_solid", "draw_layer")


@query(
    " SELECT x, y, CASE " + " ".join(f"WHEN type IN ({', '.join(map(str, facts.FAMILY_TYPES[bit]))}) THEN '{name}'" for name, bit in joins.FAMILIES)
    + f" WHEN frame_x >= 0 AND type IN ({', '.join(map(str, facts.STORED))}) THEN 'stored' WHEN type IN ({', '.join(map(str, facts.ROPES))}) THEN 'rope' WHEN type IN ({', '.join(map(str, facts.ORDINARY))}) THEN 'ordinary' ELSE 'unsupported' END AS family FROM g_tiles"
)
def jn02_families_of_types(spark, d):
    dim = facts.families(spark).withColumnRenamed("type", "kind")
    cells = views.g_tiles(spark, d).withColumnRenamed("type", "kind").join(dim.drop("family_mask"), "kind", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return joins.dispatch_family(cells, dim, no(C("stored") & (C("frame_x") >= 0)), no(C("rope")), no(C("ordinary"))).select("x", "y", "family")


@query(f", p AS (SELECT x, y FROM g_dense WHERE kind >= 0) SELECT x, y, {MASK4} AS mask FROM g_dense g")
def jn03_neighbors4(spark, d):
    return joins.neighbors4(views.g_dense(spark, d), F.col("kind") >= 0)


@query(f", p AS (SELECT x, y FROM g_sparse WHERE kind <> 'R') SELECT x, y, {MASK4} AS mask FROM g_sparse g")
def jn03_neighbors4_sparse(spark, d):
    return joins.neighbors4(views.g_sparse(spark, d), F.col("kind") != "R")


@query(f"{TALL} SELECT x, y, n, s, {EIGHT} FROM v")
def jn04_neighbors8(spark, d):
    return joins.neighbors8(views.g_dense(spark, d), "kind")


@query(
    """, c AS (SELECT DISTINCT x // 16 AS cx, (y // 16)::BIGINT AS cy FROM g_dense)
SELECT x, y, cx, cy, x // 16 = cx AND y // 16 = cy AS is_core FROM g_dense JOIN c ON x BETWEEN cx * 16 - 3 AND cx * 16 + 18 AND y BETWEEN cy * 16 - 3 AND cy * 16 + 18"""
)
def jn05_halo_exchange(spark, d):
    cells = views.g_dense(spark, d)
    width = cells.agg(F.max("x")).first()[0] + 1
    return joins.halo_exchange(cells, 16, 3, width, 64).select("x", "y", "cx", "cy", "is_core")


@query(
    """, b AS (SELECT x, y0 + 3 AS y0, run_len, kind FROM r_dense)
SELECT a.x, greatest(a.y0, b.y0) AS y0, (least(a.y0 + a.run_len, b.y0 + b.run_len) - greatest(a.y0, b.y0))::INT AS run_len, a.kind AS a_kind, b.kind AS b_kind
FROM r_dense a JOIN b ON a.x = b.x AND a.y0 < b.y0 + b.run_len AND b.y0 < a.y0 + a.run_len"""
)
def jn06_runs_join(spark, d):
    r = views.r_dense(spark, d)
    return joins.runs_join(r, r.withColumn("y0", F.col("y0") + 3))


RECTS = "SELECT event_id AS rect_id, event_id * 37 % 1900 - 20 AS rx, user_id * 11 % 900 - 10 AS ry, 100 + event_id % 90 AS rw, 40 + event_id % 70 AS rh FROM events WHERE event_type = 'error'"


@query(f", r AS ({RECTS}) SELECT seq, rect_id, dx - rx AS local_x, dy - ry AS local_y FROM cmds JOIN r ON dx < rx + rw AND rx < dx + dw AND dy < ry + rh AND ry < dy + dh")
def jn07_rect_overlap(spark, d):
    rects = spark.sql(RECTS.replace("FROM events", "FROM {events}"), events=views.table(spark, d, "events"))
    return joins.copies_overlap(views.cmds(spark, d).drop("asset", "kind"), rects).select("seq", "rect_id", "local_x", "local_y")


@query("SELECT x, y, CASE WHEN bool_or(kind = 1 AND level > 150) OVER (PARTITION BY x, y) THEN TRUE END AS has_origin FROM g_dense")
def jn08_has_origin(spark, d):
    cells = views.g_dense(spark, d)
    return joins.has_origin(cells, cells.where("kind = 1 AND level > 150"), complete=False).select("x", "y", "has_origin")


ASSETS = [("1-URGENT", 48, 32), ("2-HIGH", 32, 16), ("5-LOW", 40, 16)]
ASSETS_SQL = ", assets(asset, width, height) AS (VALUES ('1-URGENT', 48, 32), ('2-HIGH', 32, 16), ('5-LOW', 40, 16))"


def assets(spark):
    return spark.createDataFrame(ASSETS, "asset string, width int, height int")


@query(ASSETS_SQL + " SELECT asset, count(*) AS commands FROM cmds WHERE asset NOT IN (SELECT asset FROM assets) GROUP BY asset")
def jn09_missing_assets(spark, d):
    return joins.missing_assets(views.cmds(spark, d), assets(spark))


@query(ASSETS_SQL + " SELECT seq, asset FROM cmds JOIN assets USING (asset) WHERE NOT (seq % 3 * 8 + dw <= width AND dh <= height)")
def jn10_invalid_crops(spark, d):
    crops = views.cmds(spark, d).withColumns({"sx": F.col("seq") % 3 * 8, "sy": F.lit(0), "sw": F.col("dw"), "sh": F.col("dh")})
    return joins.invalid_crops(crops, assets(spark)).select("seq", "asset")


@query(f""", p AS (SELECT *, CASE WHEN x < 100 AND y < 30 THEN kind END AS pk, CASE WHEN x < 100 AND y < 30 THEN level END AS pl FROM g_dense), q AS (SELECT *, {at('pk', 'y', -10)} AS qk, {at('pl', 'y', -10)} AS ql FROM p)
SELECT x, y, coalesce({at('qk', 'x', -20)}, kind) AS kind, coalesce({at('ql', 'x', -20)}, level) AS level FROM q""")
def jn11_overlay(spark, d):
    cells = views.g_dense(spark, d)
    return joins.overlay(cells, cells.where("x < 100 AND y < 30"), 20, 10, ["kind", "level"])


@query(
    """, b AS (SELECT x, y, CASE WHEN x % 17 = 0 THEN kind + 1 ELSE kind END AS kind, CASE WHEN y % 19 = 0 THEN level + 1 ELSE level END AS level FROM g_dense WHERE x % 23 <> 0 UNION ALL SELECT x, 64, 0, 0 FROM g_dense WHERE y = 0 AND x % 29 = 0),
j AS (SELECT x, y, a.kind IS NOT NULL AS in_a, b.kind IS NOT NULL AS in_b, concat_ws(',', CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.level IS DISTINCT FROM b.level THEN 'level' END) AS differs
    FROM g_dense a FULL JOIN b USING (x, y))
SELECT * FROM j WHERE differs <> ''"""
)
def jn12_diff_cells(spark, d):
    a = views.g_dense(spark, d)
    b = a.where("x % 23 <> 0").selectExpr("x", "y", "CASE WHEN x % 17 = 0 THEN kind + 1 ELSE kind END AS kind", "CASE WHEN y % 19 = 0 THEN level + 1 ELSE level END AS level")
    b = b.union(a.where("y = 0 AND x % 29 = 0").selectExpr("x", "64", "0", "0"))
    return joins.diff_cells(a, b, ["kind", "level"]).withColumn("differs", F.concat_ws(",", "differs"))


@query(
    """SELECT p.x, p.y, p.x - p.level % 2 AS anchor_x, p.y - p.level % 3 AS anchor_y, CASE WHEN a.x IS NULL THEN 'no anchor' WHEN a.kind <> p.kind THEN 'other object' END AS reason
FROM g_sparse p LEFT JOIN g_sparse a ON a.x = p.x - p.level % 2 AND a.y = p.y - p.level % 3"""
)
def jn13_resolve_anchor(spark, d):
    cells = views.g_sparse(spark, d)
    return joins.resolve_anchor(cells, F.col("level") % 2, F.col("level") % 3).select("x", "y", "anchor_x", "anchor_y", "reason")


@query("SELECT x, y, (SELECT min(b.y) FROM g_dense b WHERE b.x = g.x AND b.y >= g.y AND b.y < g.y + 9 AND b.kind = 1) AS below_y FROM g_dense g")
def jn14_nearest_below(spark, d):
    return joins.nearest_below(views.g_dense(spark, d), F.col("kind") == 1, 9).select("x", "y", "below_y")


@query("SELECT x, y, (SELECT min(b.y) FROM g_sparse b WHERE b.x = g.x AND b.y >= g.y AND b.kind = 'R') AS below_y FROM g_sparse g")
def jn14_nearest_below_sparse(spark, d):
    return joins.nearest_below(views.g_sparse(spark, d), F.col("kind") == "R").select("x", "y", "below_y")


@query(
    """, m AS (SELECT g.x, g.y, g.kind, (SELECT max(b.y) FROM g_events b WHERE b.x = g.x AND b.kind = 'click' AND b.y BETWEEN g.y - 5 AND g.y - 1) AS a, (SELECT min(b.y) FROM g_events b WHERE b.x = g.x AND b.kind = 'click' AND b.y BETWEEN g.y + 1 AND g.y + 5) AS b FROM g_events g)
SELECT x, y, coalesce(b - a <= 6 AND kind <> 'error' AND NOT EXISTS (SELECT 1 FROM g_events e WHERE e.x = m.x AND e.kind = 'error' AND e.y > m.a AND e.y < m.b), FALSE) AS bracketed FROM m"""
)
def jn15_bracketed(spark, d):
    return joins.bracketed(views.g_events(spark, d), F.col("kind") == "click", F.col("kind") == "error").select("x", "y", "bracketed")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey >= 20)::INT + (l_suppkey >= 50)::INT + (l_suppkey >= 80)::INT AS zone, ['a', 'b', 'c', 'd'][1 + (l_suppkey >= 20)::INT + (l_suppkey >= 50)::INT + (l_suppkey >= 80)::INT] AS style FROM lineitem")
def jn16_zone_join(spark, d):
    zones = spark.createDataFrame([([20, 50, 80], ["a", "b", "c", "d"])], "cuts array<int>, styles array<string>")
    return joins.zone_join(views.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "x"), zones).select("l_orderkey", "l_linenumber", "l_partkey", "zone", "style")


@query(
    f""", p AS (SELECT x, y FROM g_dense WHERE kind >= 0), m AS (SELECT x, y, {MASK4} AS mask FROM g_dense g), v AS (SELECT x, y, mask, (CASE WHEN mask = 15 THEN 15 + [[2, 0, 0], [0, 1, 4], [0, 3, 0]][x % 3 + 1][y % 3 + 1] ELSE mask END)::INT AS variant FROM m)
SELECT x, y, mask, [{', '.join(str(a) for a, _ in facts.BLOCK_FRAMES)}][mask + 1] AS sx, [{', '.join(str(b) for _, b in facts.BLOCK_FRAMES)}][mask + 1] AS sy,
    variant, [{', '.join(str(a) for a, _ in facts.WALL_FRAMES)}][variant + 1] * 36 AS wall_sx, [{', '.join(str(b) for _, b in facts.WALL_FRAMES)}][variant + 1] * 36 AS wall_sy FROM v"""
)
def jn17_frame_lookup(spark, d):
    """Source rectangles of blocks by mask, and of walls by variant."""
    blocks = joins.frame_lookup(jn03_neighbors4(spark, d), facts.block_frames(spark))
    walls = facts.wall_frames(spark).withColumnsRenamed({"sx": "wall_sx", "sy": "wall_sy"})
    return joins.frame_lookup(blocks.withColumn("variant", wall_variant(C("mask"), C("x"), C("y")).cast("int")), walls, "variant").select("x", "y", "mask", "sx", "sy", "variant", "wall_sx", "wall_sy")


@query(f"SELECT x, y, CASE WHEN kind = 1 THEN coalesce(nullif({at('kind', 'x', -1)}, -1), nullif({at('kind', 'x', 1)}, -1), nullif({at('kind', 'y', -1)}, -1)) END AS chosen FROM g_dense")
def jn18_neighbor_priority(spark, d):
    return joins.neighbor_priority(views.g_dense(spark, d), "kind", ["w", "e", "n"], F.col("kind") == 1, none=-1)


REQUESTED_SQL = ", v AS (SELECT event_id AS request_id, user_id * 3 % 480 AS rx, event_id % 50 AS ry, 4 + event_id % 20 AS rw, 3 + user_id % 12 AS rh FROM events WHERE event_type = 'view')"


def requested(spark, d):
    """Viewports that users asked for, in cells."""
    views_of = views.table(spark, d, "events").where("event_type = 'view'")
    return views_of.selectExpr("event_id AS request_id", "user_id * 3 % 480 AS rx", "event_id % 50 AS ry", "4 + event_id % 20 AS rw", "3 + user_id % 12 AS rh")
