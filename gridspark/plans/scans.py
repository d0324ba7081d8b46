"""Queries: sources, run-length operators, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import project, runs
from gridspark.plans.registry import query
from gridspark.sources import facts, views
from gridspark.sources.grids import chunk_manifest, formula_grid, heights_of

C = F.col


@query("SELECT x, y, kind FROM g_events")
def src02_read_cells(spark, d):
    """Runs of the events grid, read as cells."""
    return runs.expand_runs(views.r_events(spark, d)).select("x", "y", "kind")


@query("SELECT i % w AS x, i // w AS y, (i % w * 7 + i // w * 13) % 5 AS kind, (i % w + i // w) % 256 AS level FROM (SELECT count(*) AS w FROM customer), range(0, 64 * (SELECT count(*) FROM customer)) t(i)")
def src07_formula_grid(spark, d):
    """A grid by formula, as wide as the customer table and 64 high."""
    width = views.table(spark, d, "customer").count()
    return formula_grid(spark, width, 64)


@query("SELECT x // 128 AS cx, (y // 16)::BIGINT AS cy, count(*) AS cells, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM g_dense GROUP BY 1, 2")
def snk01_chunk_manifest(spark, d):
    return chunk_manifest(views.g_dense(spark, d), 128, 16).drop("content_hash", "content_sum")


@query("SELECT x, y0 + i AS y, kind FROM r_dense, LATERAL (SELECT unnest(range(0, run_len)) AS i)")
def rle01_expand_runs(spark, d):
    return runs.expand_runs(views.r_dense(spark, d)).select("x", F.col("y").cast("long").alias("y"), "kind")


@query("SELECT x, y0, run_len, kind FROM r_dense")
def rle02_compress_cells(spark, d):
    return views.r_dense(spark, d)


@query("SELECT e.event_id, g.kind FROM (SELECT event_id, user_id AS x, event_id % 80 + 1 AS y FROM events) e JOIN g_events g ON g.x = e.x AND g.y = e.y")
def rle03_lookup_points(spark, d):
    points = views.table(spark, d, "events").selectExpr("event_id", "user_id AS x", "event_id % 80 + 1 AS y")
    return runs.lookup_points(views.r_events(spark, d), points).select("event_id", "kind")


@query("SELECT x, y // 16 AS band, kind, (SELECT min(r.y0) FROM r_dense r WHERE r.x = g.x AND r.y0 <= g.y AND r.y0 + r.run_len > g.y) AS y0 FROM g_dense g WHERE y % 16 = 0")
def rle04_band_index(spark, d):
    return runs.band_index(views.r_dense(spark, d)).select("x", F.col("band").cast("int").alias("band"), "kind", "y0")


@query(
    """, bad AS (SELECT x, CASE WHEN x % 7 = 0 AND y0 = 0 THEN 0 ELSE run_len END AS run_len, CASE WHEN x % 11 = 0 AND y0 > 0 THEN y0 + 1 ELSE y0 END AS y0 FROM r_dense),
o AS (SELECT *, lag(y0 + run_len) OVER (PARTITION BY x ORDER BY y0, run_len) AS b FROM bad),
v AS (SELECT x, y0, CASE WHEN run_len <= 0 THEN 'not positive' WHEN y0 < 0 OR y0 + run_len > 64 THEN 'outside' WHEN y0 < b THEN 'overlap' WHEN y0 > b THEN 'gap' END AS reason FROM o)
SELECT * FROM v WHERE reason IS NOT NULL UNION ALL SELECT x, NULL, 'incomplete' FROM bad GROUP BY x HAVING sum(run_len) <> 64"""
)
def rle05_check_runs(spark, d):
    """Runs damaged by rule, and what the check finds."""
    bad = views.r_dense(spark, d).selectExpr("x", "CASE WHEN x % 11 = 0 AND y0 > 0 THEN y0 + 1 ELSE y0 END AS y0", "CASE WHEN x % 7 = 0 AND y0 = 0 THEN 0 ELSE run_len END AS run_len")
    return runs.check_runs(bad, 64)


@query("SELECT x, greatest(y0, 10) AS y0, least(y0 + run_len, 40) - greatest(y0, 10) AS run_len, kind FROM r_dense WHERE x BETWEEN 100 AND 299 AND y0 < 40 AND y0 + run_len > 10")
def rle06_clip_runs(spark, d):
    return runs.clip_runs(views.r_dense(spark, d), 100, 10, 200, 30)


@query("SELECT x, y, kind, level, x - 50 AS local_x, y - 8 AS local_y, (x - 50) * 32 + (y - 8) AS index FROM g_dense WHERE x >= 50 AND x < 250 AND y >= 8 AND y < 40")
def prj01_region(spark, d):
    return project.region(views.g_dense(spark, d), 50, 8, 200, 32)


@query("SELECT x, y, kind, x >= 50 AND x < 250 AND y >= 20 AND y < 40 AS is_core FROM g_dense WHERE x >= 38 AND x < 262 AND y >= 8 AND y < 52")
def prj02_region_with_halo(spark, d):
    return project.region_with_halo(views.g_dense(spark, d), 50, 20, 200, 20, 12).select("x", "y", "kind", "is_core")


@query(
    """, f AS (SELECT DISTINCT x // 100 AS fragment_id, 100 AS width, CASE WHEN (x // 100) % 3 = 0 THEN 20 ELSE 64 END AS height FROM g_dense)
SELECT fragment_id, x % 100 - 10 AS x, y - 20 AS y, kind, NULL AS reason FROM g_dense JOIN f ON f.fragment_id = x // 100 WHERE height >= 30 AND x % 100 >= 10 AND x % 100 < 40 AND y >= 20 AND y < 30
UNION ALL SELECT fragment_id, NULL, NULL, NULL, 'outside' FROM f WHERE height < 30"""
)
def prj03_crop(spark, d):
    cells = views.g_dense(spark, d).selectExpr("x div 100 AS fragment_id", "x % 100 AS x", "y", "kind")
    fragments = cells.select("fragment_id").distinct().selectExpr("fragment_id", "100 AS width", "CASE WHEN fragment_id % 3 = 0 THEN 20 ELSE 64 END AS height")
    return project.crop(fragments, cells, 10, 20, 30, 10)


REQUESTS = ("event_id", "user_id * 37 % 900 - 50 AS x1", "event_id % 700 - 40 AS y1", "event_id * 13 % 900 - 50 AS x2", "user_id * 11 % 700 - 40 AS y2", "1 + event_id % 16 AS scale")


@query(
    """, q AS (SELECT event_id, user_id * 37 % 900 - 50 AS x1, event_id % 700 - 40 AS y1, event_id * 13 % 900 - 50 AS x2, user_id * 11 % 700 - 40 AS y2, 1 + event_id % 16 AS scale FROM events),
b AS (SELECT event_id, greatest(least(least(x1, x2), 799), 0) AS x, greatest(least(least(y1, y2), 599), 0) AS y, greatest(least(greatest(x1, x2), 799), 0) AS r, greatest(least(greatest(y1, y2), 599), 0) AS e, x1, y1, scale FROM q),
c AS (SELECT event_id, x, y, r - x + 1 AS width, e - y + 1 AS height, x1, y1, scale FROM b)
SELECT event_id, x, y, width, height, greatest(least(x + 25, 800 - width), 0) AS moved_x, greatest(least(y - 25, 600 - height), 0) AS moved_y,
    greatest(least(x1 - 2, 800), 0) AS view_x, greatest(least(y1 - 2, 600), 0) AS view_y,
    greatest(least(ceil(x1 + 640 / scale)::BIGINT + 2, 800), 0) - greatest(least(x1 - 2, 800), 0) AS view_w, greatest(least(ceil(y1 + 480 / scale)::BIGINT + 2, 600), 0) - greatest(least(y1 - 2, 600), 0) AS view_h FROM c"""
)
def prj04_rectangles(spark, d):
    """Dragged, moved and viewed rectangles of a request table."""
    q = views.table(spark, d, "events").selectExpr(*REQUESTS)
    c = F.col
    q = q.withColumn("r", project.rect_from_points(c("x1"), c("y1"), c("x2"), c("y2"), 800, 600))
    q = q.withColumn("m", project.move_rect(c("r.x"), c("r.y"), c("r.width"), c("r.height"), F.lit(25), F.lit(-25), 800, 600))
    q = q.withColumn("v", project.viewport_rect(c("x1"), c("y1"), c("scale"), 640, 480, 800, 600, 2))
    return q.select("event_id", "r.*", c("m.x").alias("moved_x"), c("m.y").alias("moved_y"), c("v.x").alias("view_x"), c("v.y").alias("view_y"), c("v.width").alias("view_w"), c("v.height").alias("view_h"))


@query(
    """, r AS (SELECT o_orderkey AS id, o_custkey % 5 AS world_id, o_orderkey % 900 - 20 AS x, o_custkey % 500 - 10 AS y, o_orderkey % 600 AS w, o_custkey % 400 AS h FROM orders)
SELECT id, CASE WHEN world_id = 4 THEN 'unknown world' WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN x < 0 OR y < 0 OR x + w > 800 + 100 * world_id OR y + h > 600 THEN 'outside'
    WHEN w > 512 OR h > 512 THEN 'side too long' WHEN w * h > 65536 THEN 'too many cells' END AS reason FROM r"""
)
def prj05_check_rects(spark, d):
    rects = views.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey % 5 AS world_id", "o_orderkey % 900 - 20 AS x", "o_custkey % 500 - 10 AS y", "o_orderkey % 600 AS w", "o_custkey % 400 AS h")
    worlds = spark.createDataFrame([(k, 800 + 100 * k, 600) for k in range(4)], "world_id long, width long, height long")
    return project.check_rects(rects, worlds).select("id", "reason")


@query("SELECT x, y, kind <> -1 AND NOT level % 5 = 0 AS block, level > 0 AND level <> 318 AND NOT level % 7 = 0 AS wall, level > 0 AND level <> 318 AS revealed FROM g_dense")
def prj06_visible(spark, d):
    level = F.col("level")
    shown = {"block": project.visible_block(F.col("kind") != -1, level % 5 == 0), "wall": project.visible_wall(level, level % 7 == 0), "revealed": project.visible_wall(level, level % 7 == 0, reveal=True)}
    return views.g_dense(spark, d).withColumns(shown).select("x", "y", *shown)


@query(
    """SELECT x, y, (kind >= 0)::INT + 2 * (level % 2)::INT + 64 * (level % 3 = 0)::INT + 2048 * (kind <> -1)::INT AS flags, level::INT AS type, (CASE WHEN kind <> -1 THEN (x % 70000) - CASE WHEN x % 70000 >= 32768 THEN 65536 ELSE 0 END END)::INT AS frame_x, y AS paint, level % 2 = 1 AS wire_red FROM g_dense"""
)
def prj07_pack_and_unpack(spark, d):
    """Cells packed to bytes, flags included, and unpacked again."""
    cells = views.g_dense(spark, d)
    flags = {"active": F.col("kind") >= 0, "wire_red": F.col("level") % 2 == 1, "inactive": F.col("level") % 3 == 0, "has_frame": F.col("kind") != -1}
    little = lambda c: F.concat(F.unhex(F.lpad(F.hex(c % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(c / F.lit(256)) % 256), 2, "0")))
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    packed = F.concat(little(project.pack_flags(flags)), little(F.col("level")), little(F.col("x") % 70000), little(F.lit(0)), little(F.lit(0)), byte(F.col("y")), *[byte(F.lit(0))] * 21)
    found = cells.withColumn("packed", packed).withColumns({f"u_{k}": c for k, c in project.unpack_cell(F.col("packed")).items()})
    back = project.pack_flags({k: F.col(f"u_{k}") for k in project.FLAGS})
    return found.select("x", "y", back.alias("flags"), F.col("u_type").alias("type"), F.col("u_frame_x").alias("frame_x"), F.col("u_paint").alias("paint"), F.col("u_wire_red").alias("wire_red"))


@query(
    """SELECT kind, count(*) FILTER (dx < 801 AND dx + dw > 99 AND dy < 601 AND dy + dh > 199) AS kept, count(*) FILTER (NOT (dx < 801 AND dx + dw > 99 AND dy < 601 AND dy + dh > 199)) AS culled,
    coalesce(sum(seq) FILTER (dx < 801 AND dx + dw > 99 AND dy < 601 AND dy + dh > 199), 0)::BIGINT AS kept_seq FROM cmds GROUP BY kind"""
)
def prj09_cull(spark, d):
    kept, counts = project.cull(views.cmds(spark, d), 100, 200, 700, 400)
    sums = kept.groupBy("kind").agg(F.sum("seq").alias("kept_seq"))
    return counts.join(sums, "kind", "left").select("kind", "kept", "culled", F.coalesce("kept_seq", F.lit(0).cast("long")).alias("kept_seq"))


@query(
    """, o AS (SELECT *, CASE WHEN seq % 50 <> 0 THEN dx // 16 + seq % 41 - 20 END AS ox, dy // 16 + seq % 3 - 1 AS oy, dx < 801 AND dx + dw > 99 AND dy < 601 AND dy + dh > 199 AS meets FROM cmds),
k AS (SELECT *, meets OR ox IS NULL OR (ox * 16 < 800 AND oy * 16 < 600 AND ox * 16 + 16 > 100 AND oy * 16 + 16 > 200) OR seq % 97 = 0 AS keep FROM o)
SELECT kind, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS culled, count(*) FILTER (keep AND NOT meets) AS by_owner FROM k GROUP BY kind"""
)
def prj09_cull_by_owner(spark, d):
    """Commands outside the output stay where their owner is inside or unknown, or their layer is."""
    owned = views.cmds(spark, d).selectExpr("*", "CASE WHEN seq % 50 <> 0 THEN dx div 16 + seq % 41 - 20 END AS owner_x", "dy div 16 + seq % 3 - 1 AS owner_y")
    kept, counts = project.cull(owned, 100, 200, 700, 400, unknown=F.col("seq") % 97 == 0)
    more = kept.where("NOT (dx < 801 AND dx + dw > 99 AND dy < 601 AND dy + dh > 199)").groupBy("kind").agg(F.count("*").alias("by_owner"))
    return counts.join(more, "kind", "left").select("kind", "kept", "culled", F.coalesce("by_owner", F.lit(0).cast("long")).alias("by_owner"))


@query("SELECT x, y, x // 128 AS cx, (y // 128)::BIGINT AS cy FROM g_dense")
def prj10_assign_chunk(spark, d):
    return project.assign_chunk(views.g_dense(spark, d)).select("x", "y", "cx", "cy")


def types_sql(name: str, types) -> str:
    return f"{name} AS (SELECT unnest([{', '.join(map(str, types))}]) AS type)"


CONDITIONAL = sorted({t for bit in (8, 16, 32, 64, 128) for t in facts.FAMILY_TYPES[bit]})


@query(
    f""", {types_sql("cond", CONDITIONAL)}, {types_sql("stored", facts.STORED)}, {types_sql("plain", facts.ORDINARY)}
SELECT x, y, shape + CASE WHEN y % 9 = 0 THEN 3 ELSE 0 END <= 5 AND (type IN (SELECT type FROM cond) OR (coalesce(frame_x >= 0 AND frame_y >= 0, FALSE) AND type IN (SELECT type FROM stored))
    OR (NOT coalesce(frame_x >= 0 AND frame_y >= 0, FALSE) AND (type IN (SELECT type FROM plain) OR type = 353))) AS supported FROM g_tiles"""
)
def prj11_supports(spark, d):
    cells = views.g_tiles(spark, d).join(facts.families(spark), "type", "left")
    shape = C("shape") + F.when(C("y") % 9 == 0, 3).otherwise(0)
    return cells.select("x", "y", project.supported(shape, C("frame_x"), C("frame_y"), facts.conditional_type(C("type")), C("stored"), C("ordinary") | (C("type") == 353)).alias("supported"))


@query("SELECT x, y, kind, layer FROM g_dense LEFT JOIN d_kind USING (kind)")
def prj12_layer_of(spark, d):
    return project.layer_of(views.g_dense(spark, d), views.d_kind(spark)).select("x", "y", "kind", "layer")


@query("SELECT x, 64 AS height, count(*) AS runs FROM r_dense GROUP BY x")
def src02_column_heights(spark, d):
    return heights_of(views.r_dense(spark, d))
