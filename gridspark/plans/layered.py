"""Queries: the layered planner and its reports, over the cells of world files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import joins
from gridspark.plans import planner
from gridspark.plans.registry import query
from gridspark.sources import facts, views


def _in(types) -> str:
    return f"({', '.join(map(str, sorted(types)))})"


_FAMILY = " ".join(f"WHEN type IN {_in(facts.FAMILY_TYPES[bit])} THEN '{name}'" for name, bit in joins.FAMILIES)
_OBJECT = f"type IN {_in(facts.FAMILY_TYPES[64])} AND type NOT IN {_in({t for bit in (1, 2, 4, 8, 16, 32) for t in facts.FAMILY_TYPES[bit]})}"


def _mask(test: str) -> str:
    return " + ".join(f"coalesce(({test.format(c=c)})::INT, 0) * {bit}" for c, bit in (("n", 1), ("w.o", 2), ("e.o", 4), ("s", 8)))


def _pick(frames, k: int, mask: str, scale: int = 1) -> str:
    return f"[{', '.join(str(f[k] * scale) for f in frames)}][1 + {mask}]"


_WET = "coalesce(CASE WHEN n.level > 0 THEN n.liquid END, CASE WHEN w.o.level > 0 THEN w.o.liquid END, CASE WHEN e.o.level > 0 THEN e.o.liquid END, CASE WHEN s.level > 0 THEN s.liquid END)"
_THORNS = ", ".join(f"({t}, {under})" for t, under in facts.THORN_GROUND.items())
_GLOW = " ".join(f"WHEN {t} THEN {number}" for t, (number, _) in facts.GLOW.items())
_AROUND = ("w.n", "w.o", "w.s", "n", "q", "s", "e.n", "e.o", "e.s")
_NEAR = ", ".join(f"CASE {c}.near WHEN 1 THEN 'invalid-shape-neighborhood' WHEN 2 THEN 'special-tile-neighborhood' WHEN 3 THEN 'unknown-solid-neighborhood' END, CASE WHEN {c}.level > 0 AND {c}.liquid <> lk THEN 'mixed-liquid-neighborhood' END" for c in _AROUND)
_MISSING = " OR ".join(f"{c} IS NULL" for c in ("w.n", "w.o", "w.s", "n", "s", "e.n", "e.o", "e.s"))
_SHAPED = " OR ".join(f"coalesce({c}.active AND {c}.shape <> 0, FALSE)" for c in _AROUND)
_STABLE = " AND ".join(f"coalesce({c}.solid OR ({c}.level = 255 AND {c}.liquid = lk), FALSE)" for c in _AROUND if c != "q")
_OPEN = {d: f"NOT coalesce({c}.solid OR ({c}.level > 0 AND {c}.liquid = lk), FALSE)" for d, c in (("l", "w.o"), ("r", "e.o"), ("t", "n"))}

#: Every entry of every cell of {cells}, whose neighbours stay within {part}.
ENTRIES = f""", c0 AS (SELECT x, y, type, active, shape, level, liquid, wall, frame_x, frame_y FROM {{cells}}),
c1 AS (SELECT *, active AND type NOT IN (379) AND type IN {_in(facts.SOLID)} AND type NOT IN {_in(facts.SOLID_TOP)} AND type NOT IN {_in(facts.PLATFORMS)} AS solid,
    CASE WHEN NOT active THEN 0 WHEN shape NOT BETWEEN 0 AND 5 THEN 1 WHEN type IN (379, 518, 546) THEN 2 WHEN type >= 754 THEN 3 ELSE 0 END AS near, wall > 0 AND wall <> 318 AS walled, type IN {_in(facts.ORDINARY)} AS ordinary,
    type IN {_in(facts.ROPES)} AS ropes, CASE {_FAMILY} END AS family, coalesce(frame_x >= 0 AND frame_y >= 0, FALSE) AS framed FROM c0),
c2 AS (SELECT c1 AS q, lag(c1) OVER v AS n, lead(c1) OVER v AS s, x, y FROM c1 WINDOW v AS (PARTITION BY x ORDER BY y)),
c3 AS (SELECT q, n, s, lag({{{{'o': q, 'n': n, 's': s}}}}) OVER h AS w, lead({{{{'o': q, 'n': n, 's': s}}}}) OVER h AS e, x, y FROM c2 WINDOW h AS (PARTITION BY {{part}}y ORDER BY x)),
c4 AS (SELECT *, q.type AS type, q.shape AS shape, q.level AS level, q.active AS active, q.wall AS wall, CASE WHEN q.level > 0 THEN q.liquid ELSE {_WET} END AS lk, {_mask("{c}.walled")} AS wm, {_mask("{c}.active AND {c}.type = q.type")} + CASE WHEN s.active AND (q.type, s.type) IN ({_THORNS}) THEN 8 ELSE 0 END AS bm,
    coalesce(n.active AND (n.ropes OR (n.ordinary AND n.shape = 0)), FALSE) AS up, coalesce(s.active AND (s.ropes OR (s.ordinary AND s.shape = 0)), FALSE) AS down FROM c3),
c5 AS (SELECT *, CASE WHEN wm = 15 THEN 15 + [[2, 0, 0], [0, 1, 4], [0, 3, 0]][x % 3 + 1][y % 3 + 1] ELSE wm END AS wv, coalesce({_NEAR}) AS why, {_MISSING} AS missing, {_SHAPED} AS shaped, {_STABLE} AS stable, {_OPEN['l']} AS l, {_OPEN['r']} AS r, {_OPEN['t']} AS t,
    up::INT + 2 * coalesce(w.o.active AND (w.o.type = 353 OR (NOT up AND w.o.ordinary)), FALSE)::INT + 4 * coalesce(e.o.active AND (e.o.type = 353 OR (NOT up AND e.o.ordinary)), FALSE)::INT + 8 * down::INT AS rm,
    CASE WHEN type = 18 THEN q.frame_x // 2016 ELSE 0 END AS wrap FROM c4),
c6 AS (SELECT *, shaped AND NOT missing AND stable AND (level = 255 OR (level = 0 AND shape = 1 AND q.solid AND n.level = 255)) AS whole, CASE WHEN l AND r THEN 16 WHEN l THEN 0 WHEN r THEN 32 ELSE 16 END AS lx, ceil(level / 255.0::DOUBLE * 16)::INT AS h,
    CASE WHEN l AND r THEN CASE WHEN t THEN 16 ELSE 32 END WHEN t THEN 0 WHEN l OR r THEN CASE WHEN y % 2 = 0 THEN 32 ELSE 16 END ELSE 48 END AS ly, q.frame_x - wrap * 2016 AS fx, q.frame_y + wrap * 20 AS fy FROM c5),
c7 AS (SELECT *, CASE WHEN lk = 4 THEN 'shimmer' WHEN lk NOT IN (1, 2, 3) THEN 'unknown-liquid-kind' WHEN why IS NOT NULL THEN why WHEN active AND shape <> 0 AND NOT q.solid THEN CASE WHEN missing THEN 'shape-non-solid' ELSE 'liquid-shape-geometry' END
        WHEN active AND shape <> 0 AND missing THEN 'shape-missing-context' WHEN active AND shape = 1 AND whole AND wall > 0 AND n.level = 255 THEN NULL WHEN active AND shape <> 0 THEN 'liquid-shape-geometry' WHEN q.solid THEN 'inside-solid' WHEN shaped AND whole THEN NULL
        WHEN shaped AND missing THEN 'shape-missing-context' WHEN shaped THEN 'liquid-shape-geometry' END AS lwhy,
    CASE WHEN NOT active THEN NULL WHEN shape NOT BETWEEN 0 AND 5 THEN 'unimplemented-type' WHEN q.family IS NULL AND q.ordinary AND NOT q.framed THEN NULL WHEN type IN (373, 374, 375, 461, 709) THEN 'particle-emitter-without-tile-body'
        WHEN {_OBJECT.replace('type', 'q.type')} AND shape <> 0 THEN 'shaped-static-object' WHEN q.family = 'block' AND (q.frame_x IS NOT NULL OR q.frame_y IS NOT NULL) THEN 'framed-static-block' WHEN q.family = 'block' AND type IN {_in(facts.THORN_GROUND)} AND shape <> 0 THEN 'shaped-thorn'
        WHEN q.family = 'object' AND NOT q.framed THEN 'object-without-frame' WHEN q.family = 'object' AND type = 184 AND q.frame_y >= 216 THEN 'unknown-attachment' WHEN q.family IN ('block', 'object') THEN NULL WHEN q.family IS NOT NULL THEN 'family-' || q.family WHEN q.framed AND type IN {_in(facts.STORED)} THEN NULL WHEN NOT q.framed AND type = 353 THEN NULL ELSE 'unimplemented-type' END AS twhy,
    CASE WHEN q.family = 'block' THEN CASE WHEN type IN {_in(facts.THORN_GROUND)} THEN 'approximate-static-thorn' ELSE 'approximate-static-block' END WHEN q.family = 'object' THEN CASE WHEN type IN (73, 74, 113, 184) THEN 'static-zero-wind' ELSE 'static-stored-frame' END
        WHEN q.framed AND type IN {_in(facts.STORED)} AND NOT (q.ordinary AND NOT q.framed) THEN 'stored-frame' WHEN type = 353 THEN 'approximate-rope' ELSE 'approximate' END AS fid FROM c6),
entries AS (
    SELECT x, y, CASE WHEN q.walled THEN 'command' ELSE 'hidden' END AS entry, 'wall' AS kind, wall AS type, CASE WHEN q.walled THEN 'wall' END AS phase, CASE WHEN q.walled THEN concat('Wall_', wall, '.png') END AS asset,
        CASE WHEN q.walled THEN {_pick(facts.WALL_FRAMES, 0, 'wv', 36)} END AS sx, CASE WHEN q.walled THEN {_pick(facts.WALL_FRAMES, 1, 'wv', 36)} END AS sy, CASE WHEN q.walled THEN 32 END AS sw, CASE WHEN q.walled THEN 32 END AS sh, CASE WHEN q.walled THEN x * 16 - 8 END AS dx, CASE WHEN q.walled THEN y * 16 - 8 END AS dy,
        CASE WHEN q.walled THEN 0 END AS shape, CASE WHEN q.walled THEN 'approximate' END AS fidelity, CASE WHEN NOT q.walled THEN 'invisible' END AS reason FROM c7 WHERE wall > 0
    UNION ALL SELECT x, y, CASE WHEN lwhy IS NULL THEN 'command' WHEN lwhy = 'inside-solid' THEN 'hidden' ELSE 'omitted' END, 'liquid', lk, CASE WHEN lwhy IS NULL THEN 'foreground liquid' END, CASE WHEN lwhy IS NULL THEN concat('water_', [0, 1, 11][lk], '.png') END,
        CASE WHEN lwhy IS NOT NULL THEN NULL WHEN whole THEN 16 ELSE lx END, CASE WHEN lwhy IS NOT NULL THEN NULL WHEN whole THEN CASE WHEN shape = 1 AND active THEN 56 ELSE 48 END ELSE ly + 16 - h END, CASE WHEN lwhy IS NULL THEN 16 END,
        CASE WHEN lwhy IS NOT NULL THEN NULL WHEN whole THEN CASE WHEN shape = 1 AND active THEN 8 ELSE 16 END ELSE h END, CASE WHEN lwhy IS NULL THEN x * 16 END, CASE WHEN lwhy IS NOT NULL THEN NULL WHEN whole THEN y * 16 ELSE y * 16 + 16 - h END, CASE WHEN lwhy IS NULL THEN 0 END,
        CASE WHEN lwhy IS NOT NULL THEN NULL WHEN whole THEN CASE WHEN shape = 1 AND active THEN 'static-wet-halfbrick-top' ELSE 'static-full-liquid-near-shape' END ELSE 'flat-fill-approximation' END, lwhy FROM c7 WHERE level > 0 OR (shape <> 0 AND q.solid AND lk IS NOT NULL)
    UNION ALL SELECT x, y, CASE WHEN twhy IS NULL THEN 'command' WHEN twhy LIKE 'particle%' THEN 'hidden' ELSE 'omitted' END, 'tile', type, CASE WHEN twhy IS NOT NULL THEN NULL WHEN type IN {_in(facts.SOLID)} OR type IN {_in(facts.DRAWN_SOLID)} THEN 'solid tile' ELSE 'non-solid tile' END, CASE WHEN twhy IS NULL THEN concat('Tiles_', type, '.png') END,
        CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid LIKE 'st%' THEN fx WHEN fid <> 'approximate-rope' THEN {_pick(facts.BLOCK_FRAMES, 0, 'bm')} ELSE {_pick(facts.BLOCK_FRAMES, 0, 'rm')} END, CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid LIKE 'st%' THEN fy WHEN fid <> 'approximate-rope' THEN {_pick(facts.BLOCK_FRAMES, 1, 'bm')} ELSE {_pick(facts.BLOCK_FRAMES, 1, 'rm')} END,
        CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid = 'stored-frame' AND type = 4 THEN 20 WHEN type = 184 THEN 20 ELSE 16 END,
        CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid = 'stored-frame' THEN CASE WHEN type = 4 THEN 20 WHEN (type IN (14, 21) AND fy = 18) OR (type = 15 AND fy % 40 = 18) OR (type = 27 AND fy % 74 = 54) OR (type = 172 AND fy % 38 = 18) THEN 18 ELSE 16 END WHEN fid = 'approximate-static-thorn' THEN 18 WHEN type IN (73, 74, 113) THEN 32 WHEN fid IN ('approximate', 'approximate-static-block') AND shape = 1 THEN 8 ELSE 16 END,
        CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid = 'stored-frame' AND type = 4 THEN x * 16 - 2 WHEN type = 184 THEN x * 16 + CASE WHEN fy // 54 = 3 THEN 2 ELSE -2 END ELSE x * 16 END,
        CASE WHEN twhy IS NOT NULL THEN NULL WHEN fid = 'stored-frame' AND type = 4 AND coalesce(n.active AND n.ordinary AND n.shape = 0, FALSE) THEN y * 16 + 4 WHEN fid IN ('approximate', 'approximate-static-block') AND shape = 1 THEN y * 16 + 8
            WHEN type IN (73, 74, 113) THEN y * 16 - 12 WHEN type = 184 THEN y * 16 + CASE WHEN fy <= 36 THEN 2 WHEN fy < 108 THEN -2 WHEN fy = 108 THEN -1 ELSE 0 END WHEN type = 178 THEN y * 16 + CASE WHEN fy <= 36 THEN 2 ELSE 0 END WHEN q.family = 'object' AND type <> 165 THEN y * 16 + 2 ELSE y * 16 END,
        CASE WHEN twhy IS NULL THEN shape END, CASE WHEN twhy IS NULL THEN fid END, twhy FROM c7 WHERE active
    UNION ALL SELECT x, y, 'command', 'tile overlay', type, CASE WHEN type IN {_in(facts.SOLID)} OR type IN {_in(facts.DRAWN_SOLID)} THEN 'solid tile' ELSE 'non-solid tile' END, concat('Glow_', CASE type {_GLOW} END, '.png'), {_pick(facts.BLOCK_FRAMES, 0, 'bm')}, {_pick(facts.BLOCK_FRAMES, 1, 'bm')}, 16,
        CASE WHEN shape = 1 THEN 8 ELSE 16 END, x * 16, y * 16 + CASE WHEN shape = 1 THEN 8 ELSE 0 END, shape, 'static-glow-mask', NULL FROM c7 WHERE active AND twhy IS NULL AND type IN {_in(facts.GLOW)})"""

_WHOLE = ENTRIES.format(cells="g_tiles", part="")
_ORDER = "CASE phase WHEN 'wall' THEN 0 WHEN 'non-solid tile' THEN 3 WHEN 'solid tile' THEN 7 ELSE 10 END"
COMMAND = ["x", "y", "kind", "type", "phase", "asset", "sx", "sy", "sw", "sh", "dx", "dy", "shape", "fidelity"]


@query(_WHOLE + f" SELECT x, y, kind, type::INT AS type, phase, asset, sx::INT AS sx, sy::INT AS sy, sw, sh::INT AS sh, dx, dy::BIGINT AS dy, shape, fidelity, (row_number() OVER (ORDER BY {_ORDER}, x, y, kind) - 1)::BIGINT AS seq FROM entries WHERE entry = 'command'")
def dm10_layered_commands(spark, d):
    """Walls, blocks, stored frames, ropes and liquids of the whole grid in drawing order."""
    return planner.commands_in_order(planner.plan_cells(views.g_tiles(spark, d))).select(*COMMAND, "seq")


@query(_WHOLE + " SELECT x, y, entry, kind, type::INT AS type, reason FROM entries WHERE entry <> 'command'")
def dm10_layered_omissions(spark, d):
    """Every wall, liquid and tile that isn't drawn, with its reason."""
    return planner.plan_cells(views.g_tiles(spark, d)).where("entry <> 'command'").select("x", "y", "entry", "kind", "type", "reason")


#: The assets at hand in the report queries: those of every type that leaves 0 or 1 modulo 3, small for 1.
ASSETS_SQL = "assets AS (SELECT concat(kind, '_', t, '.png') AS asset, CASE t % 3 WHEN 0 THEN 512 ELSE 100 END AS width, CASE t % 3 WHEN 0 THEN 512 ELSE 60 END AS height FROM range(0, 760) r(t), (VALUES ('Tiles'), ('Wall'), ('water')) v(kind) WHERE t % 3 < 2)"


def assets(spark):
    named = spark.range(760).where("id % 3 < 2").selectExpr("id", "explode(array('Tiles', 'Wall', 'water')) AS kind")
    return named.selectExpr("concat(kind, '_', id, '.png') AS asset", "IF(id % 3 = 0, 512, 100) AS width", "IF(id % 3 = 0, 512, 60) AS height")


_REPORT = f""", {ASSETS_SQL}, j AS (SELECT e.*, x // 100 AS world_id, s.asset IS NULL AS lost, sx < 0 OR sy < 0 OR sx + sw > width OR sy + sh > height AS bad FROM entries e LEFT JOIN assets s USING (asset)),
k AS (SELECT *, 'visible' AS report, '' AS key FROM j WHERE kind = 'tile' AND reason IS DISTINCT FROM 'invisible' UNION ALL SELECT *, 'planned', '' FROM j WHERE kind = 'tile' AND entry = 'command' UNION ALL SELECT *, 'commands', kind FROM j WHERE entry = 'command'
    UNION ALL SELECT *, 'unsupported types', type::VARCHAR FROM j WHERE entry = 'omitted' AND kind = 'tile' UNION ALL SELECT *, 'unsupported reasons', reason FROM j WHERE entry = 'omitted' AND kind = 'tile' UNION ALL SELECT *, 'hidden types', type::VARCHAR FROM j WHERE entry = 'hidden' AND kind = 'tile' AND reason <> 'invisible'
    UNION ALL SELECT *, 'liquid reasons', reason FROM j WHERE entry = 'omitted' AND kind = 'liquid' UNION ALL SELECT *, 'missing assets', asset FROM j WHERE entry = 'command' AND lost UNION ALL SELECT *, 'invalid crops', asset FROM j WHERE entry = 'command' AND bad UNION ALL SELECT *, 'required assets', asset FROM j WHERE entry = 'command'),
report AS (SELECT world_id, report, key, count(*) AS n, first(x ORDER BY x // 128, y // 128, x, y)::BIGINT AS x, first(y ORDER BY x // 128, y // 128, x, y)::BIGINT AS y FROM k GROUP BY world_id, report, key)"""
_WORLDS = ENTRIES.format(cells="g_tiles", part="x // 100, ") + _REPORT


def reports(spark, d):
    cells = views.g_tiles(spark, d).withColumn("world_id", F.expr("x div 100"))
    return planner.audit_report(planner.plan_cells(cells, ["world_id"]), assets(spark))


@query(_WORLDS + " SELECT * FROM report")
def dm11_audit_reports(spark, d):
    """Counts by type, reason, kind and asset with first examples, in worlds of 100 columns, from one pass."""
    return reports(spark, d)


@query(_WORLDS + """, t AS (SELECT world_id, coalesce(sum(n) FILTER (report = 'visible'), 0)::BIGINT AS visible, coalesce(sum(n) FILTER (report = 'planned'), 0)::BIGINT AS planned, coalesce(sum(n) FILTER (report = 'hidden types'), 0)::BIGINT AS hidden,
    coalesce(sum(n) FILTER (report = 'unsupported types'), 0)::BIGINT AS unsupported FROM report GROUP BY world_id) SELECT *, visible = planned + hidden + unsupported AS balanced FROM t""")
def dm11_audit_balance(spark, d):
    return planner.balance(reports(spark, d))
