"""Queries: composite operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import aggs, terrain, tracing
from gridspark.plans import audit, overview
from gridspark.plans.counts import CELLS, MEANS, OMISSIONS, omissions
from gridspark.plans.neighbours import ASSETS_SQL, MASK4, REQUESTED_SQL, assets, requested
from gridspark.operators.ranks import with_place
from gridspark.plans.registry import at, query
from gridspark.sources import views

C = F.col
TILE, WALL = "kind >= 0", "level % 3 = 0"


@query(
    f""", p AS (SELECT x, y FROM g_dense WHERE kind >= 0), t AS (SELECT x, y, {MASK4} AS tile_mask FROM g_dense g), q AS (SELECT x, y FROM g_dense WHERE level % 3 = 0), w AS (SELECT x, y, {MASK4.replace('FROM p', 'FROM q').replace('p.', 'q.')} AS wall_mask FROM g_dense g)
SELECT x, y, tile_mask, wall_mask, (CASE WHEN wall_mask = 15 THEN 15 + [[2, 0, 0], [0, 1, 4], [0, 3, 0]][x % 3 + 1][y % 3 + 1] ELSE wall_mask END)::INT AS wall_variant FROM t JOIN w USING (x, y)"""
)
def dm01_terrain_masks(spark, d):
    return terrain.terrain_masks(views.g_dense(spark, d), F.expr(TILE), F.expr(WALL))


RULES = [(1, "n", 0, True), (1, "s", 0, True), (1, "n", 2, False), (1, "w", 1, True), (1, "e", 1, True), (2, "n", 0, True), (2, "w", 0, True), (2, "e", 0, True), (2, "s", 3, True), (2, "nw", 0, True), (2, "se", 1, True), (2, "sw", 2, False)]


@query(
    ", rules(family, dir, shape, connects) AS (VALUES " + ", ".join(f"({f}, '{k}', {s}, {str(c).upper()})" for f, k, s, c in RULES) + """),
c AS (SELECT x, y, kind, (1 + level % 2)::INT AS family, (level % 4)::INT AS shape, level % 5 = 0 AS hidden FROM g_dense),
dirs(dir, dx, dy, bit) AS (VALUES ('n', 0, -1, 1), ('w', -1, 0, 2), ('e', 1, 0, 4), ('s', 0, 1, 8), ('nw', -1, -1, 16), ('ne', 1, -1, 32), ('sw', -1, 1, 64), ('se', 1, 1, 128)),
m AS (SELECT c.x, c.y, sum(CASE WHEN r.connects AND o.kind <> -2 AND o.hidden = c.hidden THEN bit ELSE 0 END)::INT AS bits FROM c CROSS JOIN dirs LEFT JOIN c o ON o.x = c.x + dx AND o.y = c.y + dy LEFT JOIN rules r ON r.family = c.family AND r.dir = dirs.dir AND r.shape = o.shape GROUP BY 1, 2)
SELECT x, y, bits & 15 AS mask, (CASE WHEN bits & 3 = 3 THEN bits & 16 ELSE 0 END + CASE WHEN bits & 5 = 5 THEN bits & 32 ELSE 0 END + CASE WHEN bits & 10 = 10 THEN bits & 64 ELSE 0 END + CASE WHEN bits & 12 = 12 THEN bits & 128 ELSE 0 END)::INT AS corners FROM m"""
)
def dm02_connect8(spark, d):
    rules = spark.createDataFrame(RULES, "family int, dir string, shape int, connects boolean")
    cells = views.g_dense(spark, d).selectExpr("x", "y", "kind", "cast(1 + level % 2 AS int) AS family", "cast(level % 4 AS int) AS shape", "level % 5 = 0 AS hidden")
    return terrain.connect8(cells, rules, attaches=C("kind") != -2)


@query(
    f""", o AS (SELECT *, {{{{'k': liquid, 'wet': level > 0, 'solid': is_solid}}}} AS own FROM g_tiles), n AS (SELECT *, {at('own', 'x', -1)} AS w, {at('own', 'x', 1)} AS e, {at('own', 'y', -1)} AS u FROM o),
p AS (SELECT *, NOT coalesce(w.solid OR (w.wet AND w.k = liquid), FALSE) AS open_left, NOT coalesce(e.solid OR (e.wet AND e.k = liquid), FALSE) AS open_right, NOT coalesce(u.solid OR (u.wet AND u.k = liquid), FALSE) AS open_top FROM n WHERE level > 0),
q AS (SELECT *, CASE WHEN open_left AND open_right THEN 16 WHEN open_left THEN 0 WHEN open_right THEN 32 ELSE 16 END AS sx,
    CASE WHEN open_left AND open_right THEN CASE WHEN open_top THEN 16 ELSE 32 END WHEN open_top THEN 0 WHEN open_left OR open_right THEN CASE WHEN y % 2 = 0 THEN 32 ELSE 16 END ELSE 48 END AS base FROM p)
SELECT x, y, liquid, level, open_left, open_right, open_top, sx, base, ceil(level / 255.0::DOUBLE * 16)::INT AS height, sx = 16 AND base = 0 AND y > 70 - 40 AS surface FROM q""".replace("{{", "{").replace("}}", "}")
)
def dm03_liquid_surface(spark, d):
    """Openings and atlas places of the liquids of world files; the surface is row 70."""
    return terrain.liquid_surface(views.g_tiles(spark, d), surface=70.0)


@query(
    f""", o AS (SELECT x, y, CASE WHEN kind >= 0 THEN level ELSE 0 END AS wet, kind = -2 AS solid, level % 6 = 0 AS half FROM g_dense),
n AS (SELECT *, coalesce({at('wet', 'y', -1)} > 0, FALSE) AS uw, coalesce({at('wet', 'x', -1)} > 0, FALSE) AS lw, coalesce({at('wet', 'x', 1)} > 0, FALSE) AS rw, coalesce({at('half', 'y', 1)}, FALSE) AS dh FROM o)
SELECT x, y, CASE WHEN wet = 0 AND NOT (uw OR lw OR rw) THEN 'dry' WHEN solid AND NOT half THEN 'occluded' WHEN half OR dh THEN 'full rules' ELSE 'ordinary' END AS class, uw::INT + 2 * lw::INT + 4 * rw::INT AS bits FROM n"""
)
def dm04_liquid_candidates(spark, d):
    cells = views.g_dense(spark, d).selectExpr("x", "y", "CASE WHEN kind >= 0 THEN level ELSE 0L END AS level", "kind = -2 AS is_solid", "level % 6 = 0 AS half")
    return terrain.liquid_candidates(cells)


SOURCES = """, n AS (SELECT c.*, u.level AS ul, u.liquid AS uk, u.is_solid AND u.shape = 0 AS uw, w.level AS wl, w.liquid AS wk, w.is_solid AND w.shape = 0 AS ww, w.shape AS ws, e.level AS el, e.liquid AS ek, e.is_solid AND e.shape = 0 AS ew, e.shape AS es,
    d.level AS dl, d.is_solid AND d.shape = 0 AS dw, d.shape AS ds FROM g_tiles c LEFT JOIN g_tiles u ON u.x = c.x AND u.y = c.y - 1 LEFT JOIN g_tiles d ON d.x = c.x AND d.y = c.y + 1 LEFT JOIN g_tiles w ON w.x = c.x - 1 AND w.y = c.y LEFT JOIN g_tiles e ON e.x = c.x + 1 AND e.y = c.y WHERE c.active),
h AS (SELECT x, y AS by_y, 0 AS k, y, CASE WHEN 2 IN (uk, wk, ek) THEN 1 WHEN 3 IN (uk, wk, ek) THEN 14 WHEN 4 IN (uk, wk, ek) THEN 25 ELSE 0 END AS fall, 'halfbrick' AS source FROM n
    WHERE shape = 1 AND (ul < 16 OR uw) AND (wl > 160 OR el > 160) AND ((wl = 0 AND NOT ww AND ws <= 1) OR (el = 0 AND NOT ew AND es <= 1)) AND wl IS NOT NULL AND el IS NOT NULL
    UNION ALL SELECT x, y, 1, y + 1, CASE type WHEN 196 THEN 11 WHEN 460 THEN 22 ELSE 26 END, 'cloud' FROM n WHERE type IN (196, 460, 717) AND dl = 0 AND NOT dw AND ds <= 1)"""


def sources(spark, d, cap):
    return terrain.detect_sources(views.g_tiles(spark, d), cap)


@query(SOURCES + " SELECT x, y::BIGINT AS y, fall::INT AS fall, source, (n - 1)::INT AS idx FROM (SELECT *, row_number() OVER (ORDER BY x, by_y, k) AS n FROM h) WHERE n <= 300")
def dm05_detect_sources(spark, d):
    return sources(spark, d, 300).select("x", F.col("y").cast("long").alias("y"), "fall", "source", F.col("idx").cast("int").alias("idx"))


@query(SOURCES + " SELECT x // 100 AS world, x, y::BIGINT AS y, fall::INT AS fall, source, (n - 1)::INT AS idx FROM (SELECT *, row_number() OVER (PARTITION BY x // 100 ORDER BY x, by_y, k) AS n FROM h JOIN (SELECT x, y AS by_y FROM g_tiles WHERE x % 100 NOT IN (0, 99)) m USING (x, by_y)) WHERE n <= 40")
def dm05_sources_by_world(spark, d):
    """Worlds of 100 columns: their first and last columns, whose neighbours are other worlds' cells, hold no half-brick sources; here they are left
    out altogether, and each world keeps its first 40."""
    cells = views.g_tiles(spark, d).withColumn("world", F.expr("x div 100"))
    found = terrain.detect_sources(cells.withColumn("active", C("active") & ~(C("x") % 100).isin(0, 99)), 40, ["world"])
    return found.select("world", "x", F.col("y").cast("long").alias("y"), "fall", "source", "idx")


@query(
    SOURCES + """, o AS (SELECT row_number() OVER (ORDER BY x, by_y, k) - 1 AS idx, x, y FROM h),
f AS (SELECT o.idx, o.x, o.y, (SELECT min(c.y) FROM g_tiles c WHERE c.x = o.x AND c.y > o.y AND c.is_solid) AS wall, (SELECT min(c.y) FROM g_tiles c WHERE c.x = o.x AND c.y > o.y AND NOT c.is_solid AND c.level > 0) AS pool FROM o),
e AS (SELECT *, least(coalesce(wall, 64), coalesce(pool, 64), 64, y + 21) AS stop FROM f)
SELECT idx, x, y + 1 + k AS y, (k + 1)::INT AS step, CASE WHEN stop = wall THEN 'solid' WHEN stop = pool THEN 'liquid' WHEN stop = 64 THEN 'end' ELSE 'limit' END AS reason FROM e, LATERAL (SELECT unnest(range(0, stop - y - 1)) AS k)"""
)
def dm06_trace_vertical(spark, d):
    """From every source of the grid."""
    return tracing.trace_vertical(sources(spark, d, None), views.g_tiles(spark, d), height=64, most=20)


PATHS = """, c AS (SELECT x, y, active, type, shape, level > 0 AS wet, is_solid AND shape = 0 AND type <> 546 AS hard, shape IN (2, 3) AS top, shape IN (4, 5) AS bottom, shape = 1 AS half FROM g_tiles),
o AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS idx, x, y FROM g_tiles WHERE level > 0 AND type % 3 = 0),
b AS (SELECT t.x, t.y, t.hard, t.wet, t.half, w.x IS NULL OR e.x IS NULL OR s.x IS NULL AS edge, s.top AND NOT t.half AND s.type <> 19 AS sloped, CASE s.shape WHEN 2 THEN 1 ELSE -1 END AS down,
    NOT t.half AND (NOT (s.hard OR s.bottom) OR NOT s.active) AS falls, (w.hard OR w.top OR w.wet) AND NOT (e.hard OR e.wet) AS goes_right, (e.hard OR e.top OR e.wet) AND NOT (w.hard OR w.wet) AS goes_left,
    (NOT (e.hard OR t.top) OR NOT e.wet) AND NOT (w.hard OR w.wet) AND NOT t.top AS goes_on, (w.active AND w.type IN (189, 196)) OR (e.active AND e.type IN (189, 196)) OR (s.active AND s.type IN (189, 196)) AS longer
    FROM c t LEFT JOIN c w ON w.x = t.x - 1 AND w.y = t.y LEFT JOIN c e ON e.x = t.x + 1 AND e.y = t.y LEFT JOIN c s ON s.x = t.x AND s.y = t.y + 1),
t AS (SELECT idx, 0 AS step, x, y::BIGINT AS y, 0 AS dir, 0 AS turns, 12 AS most, NULL::VARCHAR AS reason, FALSE AS shown FROM o
UNION ALL SELECT t.idx, CASE WHEN m.after THEN t.step + 1 ELSE t.step END, CASE WHEN m.after THEN t.x + m.dx ELSE t.x END, CASE WHEN m.after THEN t.y + m.dy ELSE t.y END, CASE WHEN m.after THEN m.dir ELSE t.dir END, CASE WHEN m.after THEN m.turns ELSE t.turns END,
    CASE WHEN m.after AND m.longer THEN 30 ELSE t.most END, m.reason, NOT m.after
FROM t JOIN LATERAL (
    SELECT *, reason IS NULL AS after FROM (SELECT dx * flip AS dx, dy, dir * flip AS dir, turns, longer, CASE WHEN t.step >= t.most THEN 'distance' WHEN t.turns >= 2 THEN 'reversed' WHEN hard THEN 'solid' WHEN edge THEN 'edge' WHEN dx = 0 AND dy = 0 THEN 'stationary' WHEN wet AND NOT half THEN 'liquid' END AS reason
    FROM (SELECT *, CASE WHEN turns >= 2 THEN -1 ELSE 1 END AS flip FROM (SELECT b.*,
        CASE WHEN sloped THEN down WHEN falls THEN 0 WHEN goes_right THEN 1 WHEN goes_left THEN -1 WHEN goes_on THEN t.dir ELSE 0 END AS dx, CASE WHEN sloped OR falls THEN 1 ELSE 0 END AS dy, CASE WHEN sloped THEN down WHEN falls THEN t.dir WHEN goes_right THEN 1 WHEN goes_left THEN -1 ELSE t.dir END AS dir,
        CASE WHEN sloped THEN t.turns WHEN falls THEN 0 WHEN goes_right THEN t.turns + (t.dir = -1)::INT WHEN goes_left THEN t.turns + (t.dir = 1)::INT WHEN goes_on THEN t.turns ELSE t.turns + 1 END AS turns FROM b WHERE b.x = t.x AND b.y = t.y) q0) q1) q2) m ON TRUE WHERE t.reason IS NULL),
l AS (SELECT idx, step, x, y, max(reason) AS reason FROM t GROUP BY idx, step, x, y), bad AS (SELECT idx FROM l WHERE reason = 'edge')
SELECT idx, step::INT AS step, x, y, CASE WHEN idx IN (SELECT idx FROM bad) THEN 'edge' ELSE reason END AS reason FROM l WHERE step = 0 OR idx NOT IN (SELECT idx FROM bad)"""


@query(PATHS)
def dm07_trace_paths(spark, d):
    cells = views.g_tiles(spark, d)
    origins = cells.where("level > 0 AND type % 3 = 0")
    return tracing.trace_paths(with_place(origins.select("x", "y"), ["x", "y"], "idx"), cells, 12, longest=30)


@query(
    """, c AS (SELECT x, y, (kind // 2)::INT AS kind FROM g_dense), o AS (SELECT x AS x0, y AS y0, (kind // 2)::INT AS kind FROM g_dense WHERE level % 11 = 0),
b AS (SELECT c.x, c.y, c.kind, d.kind AS base, coalesce(d.kind = c.kind, FALSE) AS down, coalesce(w.kind = c.kind AND dw.kind = c.kind, FALSE) AS l, coalesce(e.kind = c.kind AND de.kind = c.kind, FALSE) AS r FROM c LEFT JOIN c d ON d.x = c.x AND d.y = c.y + 1
    LEFT JOIN c w ON w.x = c.x - 1 AND w.y = c.y LEFT JOIN c dw ON dw.x = c.x - 1 AND dw.y = c.y + 1 LEFT JOIN c e ON e.x = c.x + 1 AND e.y = c.y LEFT JOIN c de ON de.x = c.x + 1 AND de.y = c.y + 1),
t AS (SELECT x0, y0, x0 AS x, y0 AS y, 0 AS step FROM o
UNION ALL SELECT t.x0, t.y0, CASE WHEN b.down THEN b.x WHEN b.l AND b.x >= t.x0 THEN b.x - 1 ELSE b.x + 1 END, b.y + 1, t.step + 1 FROM t JOIN b ON b.x = t.x AND b.y = t.y AND (b.down OR (b.l AND b.x >= t.x0) OR (b.r AND b.x <= t.x0)) WHERE t.step < 5),
f AS (SELECT x0, y0, arg_max(x, step) AS x, arg_max(y, step) AS y, max(step) AS steps FROM t GROUP BY x0, y0)
SELECT x0, y0::BIGINT AS y0, f.x AS root_x, f.y::BIGINT AS root_y, steps::INT AS steps, NOT (b.down OR (b.l AND b.x >= x0) OR (b.r AND b.x <= x0)) AS complete, CASE WHEN NOT (b.down OR (b.l AND b.x >= x0) OR (b.r AND b.x <= x0)) THEN CASE b.base WHEN -1 THEN 'rock' WHEN 0 THEN 'sand' END END AS class FROM f JOIN b ON b.x = f.x AND b.y = f.y"""
)
def dm08_trace_root(spark, d):
    """Stacks of more than five cells have no root within the limit."""
    cells = views.g_dense(spark, d).selectExpr("x", "y", "cast(kind / 2 AS int) AS kind", "level")
    starts = cells.where("level % 11 = 0").selectExpr("x AS x0", "y AS y0", "kind")
    return tracing.trace_root(starts, cells.drop("level"), {-1: "rock", 0: "sand"}, 5)


@query(
    """ SELECT x, y, (SELECT min(b.y) FROM g_dense b WHERE b.x = g.x AND b.kind = -2 AND b.y <= g.y + 20 AND b.y >= (SELECT min(a.y) FROM g_dense a WHERE a.x = g.x AND a.kind = 1 AND a.y BETWEEN g.y AND g.y + 20)) AS ground_y FROM g_dense g"""
)
def dm08_stack_ground(spark, d):
    """Ground of the stacks at or under every cell, within 20 rows."""
    return tracing.stack_ground(views.g_dense(spark, d).select("x", "y", "kind"), C("kind") == 1, C("kind") == -2).select("x", "y", "ground_y")


@query(
    """, n AS (SELECT x, y, kind, (SELECT min(b.y) FROM g_sparse b WHERE b.x = g.x AND b.y > g.y AND b.y <= g.y + 3 AND b.kind <> g.kind) AS ground_y FROM g_sparse g)
SELECT n.x, n.y, ground_y, b.kind AS ground, ((n.x >= 3000)::INT + (n.x >= 7000)::INT + (n.x >= 11000)::INT)::INT AS zone, CASE WHEN ground_y IS NULL THEN 'none' ELSE concat(b.kind, '-', ['p', 'q', 'r', 's'][1 + (n.x >= 3000)::INT + (n.x >= 7000)::INT + (n.x >= 11000)::INT]) END AS style
FROM n LEFT JOIN g_sparse b ON b.x = n.x AND b.y = n.ground_y"""
)
def dm09_attribute_ground(spark, d):
    zones = spark.createDataFrame([([3000, 7000, 11000], ["p", "q", "r", "s"])], "cuts array<int>, styles array<string>")
    return terrain.attribute_ground(views.g_sparse(spark, d), zones, 3)


PLAN_SQL = f""", p AS (SELECT x, y FROM g_dense WHERE kind >= 0), v AS (SELECT g.*, solid, layer, family_mask, {MASK4} AS mask FROM g_dense g LEFT JOIN d_kind USING (kind)),
a AS (SELECT x, y, kind, level, mask, CASE WHEN kind = -1 THEN 'invisible' WHEN level % 13 = 0 THEN 'hidden' WHEN layer IS NULL THEN 'unknown layer' WHEN family_mask & 3 = 0 THEN 'unsupported family' WHEN level % 17 = 0 THEN 'unsupported shape' END AS reason, layer FROM v)"""


@query(PLAN_SQL + " SELECT x, y, concat('tile_', kind + 3, '.png') AS asset, layer, mask % 4 * 18 AS sx, mask // 4 * 18 AS sy, (row_number() OVER (ORDER BY CASE layer WHEN 'solid' THEN 7 ELSE 3 END, x, y) - 1)::BIGINT AS seq FROM a WHERE reason IS NULL")
def dm10_plan_commands(spark, d):
    return audit.numbered(audit.plan(views.g_dense(spark, d), views.d_kind(spark), **audit.view_rules()).commands)


@query(PLAN_SQL + " SELECT reason, kind, count(*) AS cells, first(x ORDER BY x // 128, y // 128, x, y) AS x, first(y ORDER BY x // 128, y // 128, x, y) AS y FROM a WHERE reason IS NOT NULL AND reason NOT IN ('invisible', 'hidden') GROUP BY reason, kind")
def dm10_plan_omissions(spark, d):
    found = audit.plan(views.g_dense(spark, d), views.d_kind(spark), **audit.view_rules()).omissions
    return aggs.first_example(found, ["reason", "kind"]).select("reason", "kind", F.col("n").alias("cells"), "x", "y")


AUDIT_SQL = PLAN_SQL.replace("p.x = g.x - 1 ", "p.x = g.x - 1 AND p.x // 100 = g.x // 100 ").replace("p.x = g.x + 1 ", "p.x = g.x + 1 AND p.x // 100 = g.x // 100 ") + """, assets(asset, width, height) AS (VALUES ('tile_1.png', 72, 72), ('tile_4.png', 60, 72)),
m AS (SELECT x // 100 AS world_id, reason, concat('tile_', kind + 3, '.png') AS asset, mask % 4 * 18 AS sx, mask // 4 * 18 AS sy FROM a),
k AS (SELECT m.*, s.asset IS NULL AS missing, s.asset IS NOT NULL AND (sx + 16 > width OR sy + 16 > height) AS bad FROM m LEFT JOIN assets s USING (asset)),
t AS (SELECT world_id, count(*) FILTER (reason IS DISTINCT FROM 'invisible') AS visible, count(*) FILTER (reason IS NULL) AS planned, count(*) FILTER (reason = 'hidden') AS hidden,
    count(*) FILTER (reason IN ('unknown layer', 'unsupported family', 'unsupported shape')) AS unsupported, count(*) FILTER (reason IS NULL AND missing) AS missing, count(*) FILTER (reason IS NULL AND bad) AS invalid FROM k GROUP BY 1)
SELECT *, planned - missing - invalid AS rendered, visible = planned + hidden + unsupported AS balanced FROM t"""


@query(AUDIT_SQL)
def dm11_audit(spark, d):
    return audit.audit_query(spark, d)


@query(AUDIT_SQL)
def dm11_audit_of_overlapping_worlds(spark, d):
    """The same cells in worlds whose coordinates overlap: the same counts."""
    return audit.overlapping_query(spark, d)


@query(PLAN_SQL.replace("p.x = g.x - 1 ", "p.x = g.x - 1 AND p.x // 100 = g.x // 100 ").replace("p.x = g.x + 1 ", "p.x = g.x + 1 AND p.x // 100 = g.x // 100 ") + " SELECT x // 100 AS world_id, x % 100 AS x, y, concat('tile_', kind + 3, '.png') AS asset, layer, mask % 4 * 18 AS sx, mask // 4 * 18 AS sy, (row_number() OVER (PARTITION BY x // 100 ORDER BY CASE layer WHEN 'solid' THEN 7 ELSE 3 END, x, y) - 1)::BIGINT AS seq FROM a WHERE reason IS NULL")
def dm10_plan_commands_by_world(spark, d):
    cells = views.g_dense(spark, d).withColumn("world_id", F.expr("x div 100")).withColumn("x", F.expr("x % 100"))
    return audit.numbered(audit.plan(cells, views.d_kind(spark), ["world_id"], **audit.view_rules()).commands, ["world_id"])


@query(OMISSIONS + ", m AS (SELECT x, y, bit_or(code) AS code FROM om GROUP BY x, y) SELECT i % 128 AS x, i // 128 AS y, coalesce(code, 0) AS code, CASE WHEN code IS NULL THEN 'covered' ELSE concat_ws('+', CASE WHEN code & 1 <> 0 THEN 'row' END, CASE WHEN code & 2 <> 0 THEN 'column' END, CASE WHEN code & 4 <> 0 THEN 'wide' END, CASE WHEN code & 8 <> 0 THEN 'low' END) END AS legend FROM range(0, 8192) t(i) LEFT JOIN m ON m.x = i % 128 AND m.y = i // 128")
def dm12_coverage_map(spark, d):
    cells = spark.range(128 * 64).selectExpr("id % 128 AS x", "id div 128 AS y")
    return overview.coverage_map(cells, omissions(spark, d), {1: "row", 2: "column", 4: "wide", 8: "low"})


@query(f" SELECT f::INT AS factor, x // f AS x, (y // f)::BIGINT AS y, {MEANS.replace('pix.', '')} FROM pix, (VALUES (1), (2), (4), (8)) v(f) GROUP BY f, pix.x // f, pix.y // f")
def dm13_overview(spark, d):
    return overview.overview(views.pix(spark, d), [1, 2, 4, 8])


@query("SELECT x // 8 AS x, (y // 8)::BIGINT AS y, CASE WHEN count(*) FILTER (kind = 1) >= greatest(count(*) FILTER (kind = 0), 1) AND count(*) FILTER (kind = 1) >= count(*) FILTER (kind = -2) THEN 1 WHEN count(*) FILTER (kind = 0) >= greatest(count(*) FILTER (kind = -2), 1) THEN 0 WHEN count(*) FILTER (kind = -2) > 0 THEN -2 END AS majority FROM g_dense GROUP BY 1, 2")
def dm13_overview_kinds(spark, d):
    return overview.overview_kinds(views.g_dense(spark, d), 8, [1, 0, -2])


@query(
    REQUESTED_SQL + """, a AS (SELECT request_id, count(*) AS cells, sum(level)::BIGINT AS level FROM v JOIN g_dense g ON g.x >= v.rx AND g.x < v.rx + v.rw AND g.y >= v.ry AND g.y < v.ry + v.rh GROUP BY 1),
b AS (SELECT request_id, count(*) AS commands, max(seq) AS top FROM v JOIN cmds ON dx < (rx + rw) * 16 AND rx * 16 < dx + dw AND dy < (ry + rh) * 16 AND ry * 16 < dy + dh GROUP BY 1)
SELECT request_id, coalesce(cells, 0) AS cells, level, coalesce(commands, 0) AS commands, top FROM v LEFT JOIN a USING (request_id) LEFT JOIN b USING (request_id)"""
)
def dm14_query_viewports(spark, d):
    return overview.query_viewports(requested(spark, d), views.g_dense(spark, d), views.cmds(spark, d))


@query("SELECT DISTINCT concat(lower(replace(p_brand, '#', '_')), '_', p_size, '.png') AS asset, variant::INT AS variant, shape::INT AS shape, paint::INT AS paint, ((((2::BIGINT * 1024 + p_size) * 32 + variant) * 6 + shape) * 32 + paint)::BIGINT AS recipe FROM part, range(0, 4) v(variant), range(0, 6) s(shape), range(0, 3) q(paint) WHERE p_size % 5 = 0")
def dm15_compile_frames(spark, d):
    parts = views.table(spark, d, "part").selectExpr("concat(lower(replace(p_brand, '#', '_')), '_', p_size, '.png') AS asset", "p_size AS type")
    present = parts.where("type % 5 = 0").select("asset").distinct()
    return overview.compile_frames(parts.distinct(), present, variants=4, shapes=6, paints=3)
