"""Queries: windows, orders and sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridspark.operators import order, sets, windows
from gridspark.operators.ranks import with_place
from gridspark.plans.registry import at, query
from gridspark.sources import facts, views


@query("SELECT g.x, g.y, a.level AS above, b.level AS below FROM g_sparse g LEFT JOIN g_sparse a ON a.x = g.x AND a.y = g.y - 1 LEFT JOIN g_sparse b ON b.x = g.x AND b.y = g.y + 1")
def wn01_vertical_context(spark, d):
    return windows.vertical_context(views.g_sparse(spark, d), "level").select("x", "y", "above", "below")


@query("SELECT x, y, (n - 1)::INT AS idx FROM (SELECT x, y, row_number() OVER (ORDER BY x, y) AS n FROM g_dense WHERE kind = 1) WHERE n <= 500")
def wn02_register_capped(spark, d):
    return windows.register_capped(views.g_dense(spark, d).where("kind = 1"), 500)[0].select("x", "y", "idx")


@query("SELECT x // 100 AS world_id, count(*) AS eligible, least(count(*), 100) AS registered, count(*) - least(count(*), 100) AS capped FROM g_dense WHERE kind = 1 GROUP BY 1")
def wn02_register_report(spark, d):
    cells = views.g_dense(spark, d).where("kind = 1").withColumn("world_id", F.expr("x div 100"))
    return windows.register_capped(cells, 100, ["world_id"])[1]


@query(", c AS (SELECT seq, dx, dy, asset, lag(asset) OVER (PARTITION BY dx, dy ORDER BY seq) AS b FROM cmds) SELECT seq, (sum((b IS NOT NULL AND b <> asset)::INT) OVER (PARTITION BY dx, dy ORDER BY seq))::BIGINT AS stack FROM c")
def wn03_layer_stack(spark, d):
    return windows.layer_stack(views.cmds(spark, d), ["dx", "dy"], "seq").select("seq", "stack")


@query("SELECT asset, min(seq) AS first_seq, (dense_rank() OVER (ORDER BY min(seq)))::INT AS place FROM cmds GROUP BY asset")
def wn04_first_appearance_rank(spark, d):
    return windows.first_appearance_rank(views.cmds(spark, d), "asset").withColumn("place", F.col("place").cast("int"))


#: Wet, solid and half cells, with the liquids of world files.
WET_SQL = """, c AS (SELECT x, y, liquid, level, is_solid, shape = 1 AND type NOT IN (19, 427, 435, 436, 437, 438, 439) AS half, (level / 255.0::DOUBLE)::FLOAT AS v FROM g_tiles),
k AS (SELECT *, {'level': level, 'liquid': liquid, 'is_solid': is_solid, 'v': v} AS own FROM c),
n AS (SELECT *, @NEAR@ FROM k),
j AS (SELECT x, y, liquid, level, is_solid, v, half AND coalesce(u.level > 0, FALSE) AS whole, u.liquid AS uk, l.liquid AS lk,
    CASE WHEN u.level > 0 AND d.level > 0 AND u.liquid = d.liquid AND NOT u.is_solid AND NOT d.is_solid THEN u.v + d.v END AS down, CASE WHEN l.level > 0 AND r.level > 0 AND l.liquid = r.liquid AND NOT l.is_solid AND NOT r.is_solid THEN l.v + r.v END AS across FROM n),
s AS (SELECT x, y, (CASE WHEN whole THEN 1 WHEN level > 0 OR is_solid THEN v ELSE greatest(coalesce(down, 0::FLOAT), coalesce(across, 0::FLOAT)) * 0.5::FLOAT END)::FLOAT AS bridged, whole, is_solid,
    CASE WHEN whole AND level = 0 THEN uk WHEN whole OR level > 0 OR is_solid THEN liquid WHEN across IS NOT NULL THEN lk WHEN down IS NOT NULL THEN uk ELSE liquid END AS bridge_kind FROM j)""".replace("@NEAR@", ", ".join(f"{at('own', axis, step)} AS {name}" for name, axis, step in (("u", "y", -1), ("d", "y", 1), ("l", "x", -1), ("r", "x", 1))))


@query(WET_SQL + ' SELECT x, y, bridged, bridge_kind, whole AS "full" FROM s')
def wn05_bridge_levels(spark, d):
    return windows.bridge_levels(wet(spark, d)).select("x", "y", "bridged", "bridge_kind", "full")


def wet(spark, d):
    half = (F.col("shape") == 1) & ~facts.is_one_of(F.col("type"), facts.PLATFORMS)
    return views.g_tiles(spark, d).select("x", "y", "liquid", "level", "is_solid", half.alias("half"))


@query(
    """, c AS (SELECT x, y, CASE WHEN level > 180 THEN level ELSE 0 END AS level, kind = -2 AS solid FROM g_dense),
s AS (SELECT c.x, c.y, c.level AS own, c.solid, (SELECT max(s.y) FROM c s WHERE s.x = c.x AND s.level > 0 AND NOT s.solid AND s.y BETWEEN c.y - 10 AND c.y - 1) AS sy, (SELECT max(b.y) FROM c b WHERE b.x = c.x AND b.solid AND b.y BETWEEN c.y - 10 AND c.y - 1) AS wall FROM c)
SELECT s.x, s.y, CASE WHEN sy IS NOT NULL AND NOT s.solid AND own = 0 AND (wall IS NULL OR wall < sy) THEN floor(q.level * (11 - (s.y - sy)) / 11.0)::BIGINT ELSE 0 END AS fallen FROM s LEFT JOIN c q ON q.x = s.x AND q.y = s.sy"""
)
def wn06_fall_levels_single(spark, d):
    cells = views.g_dense(spark, d).selectExpr("x", "y", "CASE WHEN level > 180 THEN level ELSE 0L END AS level", "kind = -2 AS is_solid")
    return windows.fall_levels_single(cells).select("x", "y", "fallen")


#: Weights of sources by kind and distance: each a single-precision step less than the one before.
WEIGHTS = {k: [w := 1.0] + [w := float(np.float32(np.float32(w) - np.float32(1 / (n + 1)))) for _ in range(n)] for k, n in windows.FALL_LENGTH.items()}


@query(
    WET_SQL + f""", g(kind, weights) AS (VALUES {', '.join(f"({k}, [{', '.join(f'{v!r}::DOUBLE' for v in w[1:])}])" for k, w in WEIGHTS.items())}),
i AS (SELECT s.*, coalesce(g.weights, []::DOUBLE[]) AS weights FROM s LEFT JOIN g ON g.kind = s.bridge_kind),
t AS (SELECT x, y, bridged, bridge_kind, is_solid AND NOT whole AS shut, is_solid, whole, (CASE WHEN is_solid AND NOT whole THEN 1 ELSE bridged END)::FLOAT AS fallen, bridge_kind AS fall_kind, (CASE WHEN is_solid AND NOT whole OR bridged = 0 THEN 0 ELSE 1 END)::FLOAT AS opacity,
    [{{'seed': (CASE WHEN is_solid AND NOT whole THEN 0 ELSE bridged END)::FLOAT, 'total': (CASE WHEN is_solid AND NOT whole THEN 1 ELSE bridged END)::FLOAT, 'kind': bridge_kind, 'hard': is_solid, 'weights': weights}}] AS above FROM i WHERE y = 0
UNION ALL SELECT t.x, n.y, n.bridged, n.bridge_kind, n.shut, n.is_solid, n.whole, n.fallen, n.fall_kind, n.opacity,
    list_prepend({{'seed': (CASE WHEN n.shut THEN 0 ELSE n.bridged END)::FLOAT, 'total': n.fallen, 'kind': n.bridge_kind, 'hard': n.is_solid, 'weights': n.weights}}, t.above)[1:10]
FROM t JOIN LATERAL (SELECT *, (CASE WHEN shut THEN 1 WHEN bridged = 1 OR len(hits) = 0 THEN bridged ELSE greatest(bridged, list_max(list_transform(hits, lambda k: (t.above[k].total * t.above[k].weights[k]::FLOAT)::FLOAT))) END)::FLOAT AS fallen,
        CASE WHEN NOT shut AND bridged = 0 AND len(hits) > 0 THEN t.above[hits[1]].kind ELSE bridge_kind END AS fall_kind, (CASE WHEN shut THEN 0 WHEN bridged > 0 THEN 1 WHEN len(hits) > 0 THEN t.above[hits[1]].weights[hits[1]] ELSE 0 END)::FLOAT AS opacity
    FROM (SELECT i.*, i.is_solid AND NOT i.whole AS shut, list_filter(range(1, len(t.above) + 1), lambda k: t.above[k].seed > 0 AND k <= len(t.above[k].weights) AND NOT list_contains(list_transform(t.above[1:k - 1], lambda a: a.hard), TRUE)) AS hits FROM i WHERE i.x = t.x AND i.y = t.y + 1) q) n ON TRUE)
SELECT x, y, fallen, fall_kind::INT AS fall_kind, opacity FROM t"""
)
def wn06_fall_levels_chained(spark, d):
    """Falls that feed falls, from the bridged levels."""
    seeds = windows.bridge_levels(wet(spark, d)).select("x", "y", F.col("bridge_kind").alias("liquid"), F.col("bridged").alias("level"), "is_solid", "full")
    return windows.fall_levels(seeds).select("x", "y", "fallen", "fall_kind", "opacity")


@query(f", n AS (SELECT *, {at('level', 'x', -1)} AS a, {at('level', 'x', 1)} AS b FROM g_dense) SELECT x, y, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (2 * level + a + b) / 4.0::DOUBLE ELSE level::DOUBLE END AS smooth FROM n")
def wn07_smooth121(spark, d):
    return windows.smooth121(views.g_dense(spark, d), "level", "x").select("x", "y", "smooth")


@query("SELECT x, y, least(1.0::DOUBLE, (max(y) OVER (PARTITION BY x) - y + 1) / 10.0::DOUBLE) AS opacity FROM g_events")
def wn08_fade(spark, d):
    return windows.fade(views.g_events(spark, d), ["x"], "y").select("x", "y", "opacity")


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events")
def wn09_phase_delta(spark, d):
    return windows.phase_delta(views.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "delta", "peak")


@query("SELECT x, y, kind, level FROM g_dense ORDER BY x, y")
def so01_column_major(spark, d):
    return order.column_major(views.g_dense(spark, d))


@query(
    """, p AS (SELECT seq, dx, dy, CASE kind WHEN 'F' THEN 0 WHEN 'O' THEN 3 ELSE 11 END AS phase_no FROM cmds)
SELECT seq, phase_no, row_number() OVER (ORDER BY phase_no, dx, dy, seq) AS place FROM p"""
)
def so02_draw_order(spark, d):
    """The place of every command."""
    phase = F.expr("CASE kind WHEN 'F' THEN 'wall' WHEN 'O' THEN 'non-solid tile' END")
    keyed = order.draw_order(views.cmds(spark, d), phase, ["dx", "dy", "seq"]).select("seq", "phase_no", "dx", "dy")
    return with_place(keyed, ["phase_no", "dx", "dy", "seq"], "place").select("seq", "phase_no", (F.col("place") + 1).alias("place"))


@query("SELECT o_orderkey AS k, 1 AS source FROM orders UNION ALL SELECT event_id, 0 FROM events WHERE event_type = 'error'")
def so03_merge_ordered(spark, d):
    owners = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    specials = views.table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("k"))
    return order.merge_ordered(owners, specials, "k")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def so04_top_k(spark, d):
    counts = views.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return order.top_k(counts, [F.desc("n"), F.col("user_id")], 20)


@query("SELECT event_type, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id))::INT AS place FROM events QUALIFY place <= 10")
def so04_top_k_per_group(spark, d):
    events = views.table(spark, d, "events").select("event_type", "event_id", "value")
    return order.top_k_per_group(events, ["event_type"], [F.desc("value"), F.col("event_id")], 10)


@query("SELECT kind, count(*) AS n FROM cmds GROUP BY kind")
def so05_guard_budget(spark, d):
    """A budget that holds: the counts go through unchanged."""
    return order.guard_budget(views.cmds(spark, d).groupBy("kind").agg(F.count("*").alias("n")), 1000)


@query("SELECT seq, asset, 0 AS layer, NULL::BIGINT AS dw FROM cmds WHERE kind = 'F' UNION ALL SELECT seq, NULL, 1, dw FROM cmds WHERE kind = 'O'")
def st01_layered_union(spark, d):
    c = views.cmds(spark, d)
    return sets.layered_union([c.where("kind = 'F'").select("seq", "asset"), c.where("kind = 'O'").select("seq", "dw")])


@query(
    """, b AS (SELECT o_orderkey AS k, o_orderpriority AS reason FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 = 0),
f AS (SELECT o_orderkey AS k, min('failed ' || o_orderstatus) AS reason FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT b.k, coalesce(f.reason, b.reason) AS reason FROM b LEFT JOIN f USING (k) WHERE b.k NOT IN (SELECT k FROM r)
UNION ALL SELECT k, reason FROM f WHERE k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM r)"""
)
def st02_replace_omissions(spark, d):
    o = views.table(spark, d, "orders")
    base = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_orderpriority AS reason")
    failed = o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS k", "'failed ' || o_orderstatus AS reason")
    return sets.replace_omissions(base, o.where("o_orderkey % 6 = 0").selectExpr("o_orderkey AS k"), failed, ["k"])


@query("SELECT doc_id, 'missing' AS status FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'additional' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def st03_manifest_vs_actual(spark, d):
    return sets.manifest_vs_actual(views.table(spark, d, "documents"), views.table(spark, d, "labels"), "doc_id")


@query("SELECT text, count(*) AS rows, count(*) > 1 AS repeated FROM documents GROUP BY text")
def st04_distinct_rows(spark, d):
    return sets.distinct_rows(views.table(spark, d, "documents"), ["text"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def st05_common(spark, d):
    return sets.common(views.table(spark, d, "documents"), views.table(spark, d, "labels"), ["doc_id"])
