"""Queries: verification jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import checks
from gridspark.operators.joins import neighbors4
from gridspark.plans.registry import query
from gridspark.sources import views


@query(
    """, m AS (SELECT doc_id, octet_length(encode(text))::INT AS bytes, sha256(text) AS sha FROM documents WHERE doc_id % 31 <> 0),
a AS (SELECT doc_id, (octet_length(encode(text)) + (doc_id % 17 = 0)::INT)::INT AS bytes, CASE WHEN doc_id % 13 = 0 THEN sha256(source) ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 29 <> 0),
j AS (SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'additional' WHEN m.bytes <> a.bytes THEN 'bytes' WHEN m.sha <> a.sha THEN 'sha' END AS reason FROM m FULL JOIN a ON m.doc_id = a.doc_id)
SELECT * FROM j WHERE reason IS NOT NULL"""
)
def vf01_verify_manifest(spark, d):
    docs = views.table(spark, d, "documents")
    m = docs.where("doc_id % 31 <> 0").selectExpr("doc_id", "octet_length(cast(text AS binary)) AS bytes", "sha2(cast(text AS binary), 256) AS sha")
    a = docs.where("doc_id % 29 <> 0").selectExpr("doc_id", "octet_length(cast(text AS binary)) + cast(doc_id % 17 = 0 AS int) AS bytes", "CASE WHEN doc_id % 13 = 0 THEN sha2(cast(source AS binary), 256) ELSE sha2(cast(text AS binary), 256) END AS sha")
    return checks.verify_manifest(m, a, "doc_id", ["bytes", "sha"])


#: Pieces of 32 by 16 cells of the dense grid, some of them damaged by their number.
PIECES = """, g AS (SELECT x // 32 AS cx, y // 16 AS cy, min(x) AS wx, min(y) AS wy, max(x) - min(x) + 1 AS ww, max(y) - min(y) + 1 AS wh, sum(level)::BIGINT AS bytes FROM g_dense GROUP BY 1, 2), k AS (SELECT *, cx * 4 + cy AS k, concat('tile-', cx, '-', cy, '.png') AS file FROM g),
m AS (SELECT k, CASE k % 23 WHEN 1 THEN concat('piece-', cx, '-', cy, '.png') ELSE file END AS file, wx * 16 + CASE k % 23 WHEN 2 THEN 8 WHEN 3 THEN 16 ELSE 0 END AS x, wy * 16 AS y, ww * 16 AS width, wh * 16 AS height, wx AS world_x, wy AS world_y, ww AS world_width, wh AS world_height, bytes FROM k WHERE k % 23 <> 4
    UNION ALL SELECT k, file, wx * 16, wy * 16, ww * 16, wh * 16, wx, wy, ww, wh, bytes FROM k WHERE k % 23 = 5),
f AS (SELECT k, CASE k % 23 WHEN 1 THEN concat('piece-', cx, '-', cy, '.png') ELSE file END AS file, ww * 16 + CASE k % 23 WHEN 6 THEN 16 ELSE 0 END AS width, wh * 16 AS height, bytes + CASE k % 23 WHEN 7 THEN 1 ELSE 0 END AS bytes FROM k WHERE k % 23 <> 8)"""
PIECES_SPARK = PIECES.lstrip(", ").replace("x // 32", "x div 32").replace("y // 16", "y div 16").replace("::BIGINT", "")


@query(
    PIECES + """, r AS (SELECT m.file, CASE WHEN count(*) OVER (PARTITION BY m.file) > 1 THEN 'repeated' WHEN m.file LIKE 'piece%' THEN 'name' WHEN f.file IS NULL THEN 'missing' WHEN f.width <> m.width THEN 'dimensions' WHEN f.bytes <> m.bytes THEN 'bytes' WHEN m.x % 16 <> 0 THEN 'alignment'
    WHEN m.x <> world_x * 16 THEN 'position' WHEN m.x + m.width > (SELECT max(x) + 1 FROM g_dense) * 16 THEN 'outside' END AS reason FROM m LEFT JOIN f USING (file)),
t AS (SELECT gx AS x, gy AS y, count(*) AS times FROM m, LATERAL (SELECT unnest(range(m.x // 16, (m.x + m.width) // 16)) AS gx), LATERAL (SELECT unnest(range(m.y // 16, (m.y + m.height) // 16)) AS gy) WHERE m.x % 16 = 0 GROUP BY 1, 2)
SELECT file, NULL::BIGINT AS x, NULL::BIGINT AS y, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT file, NULL, NULL, 'additional' FROM f WHERE file NOT IN (SELECT file FROM m)
UNION ALL SELECT NULL, coalesce(g.x, t.x)::BIGINT, coalesce(g.y, t.y)::BIGINT, CASE WHEN times > 1 THEN 'overlap' ELSE 'hole' END FROM g_dense g FULL JOIN t ON g.x = t.x AND g.y = t.y WHERE coalesce(times, 0) <> 1 OR g.x IS NULL"""
)
def vf01_verify_pieces(spark, d):
    """The pieces of a grid with repeated, misnamed, missing, resized, changed, misaligned, moved and additional ones, and the cells that they cover wrongly."""
    grid = views.g_dense(spark, d)
    made = lambda name, *more: spark.sql(f"WITH {PIECES_SPARK} SELECT * FROM {name}".replace("FROM g_dense", "FROM {grid}"), grid=grid).selectExpr("file", "width", "height", "bytes", "sha2(cast(bytes AS string), 256) AS sha256", *more)
    place = ("x", "y", "world_x", "world_y", "world_width", "world_height")
    side = grid.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    files = made("f").withColumn("sha256", F.sha2(F.col("bytes").cast("string"), 256))
    return checks.verify_pieces(made("m", *place), files, (0, 0, side.x + 1, side.y + 1))


@query("SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'gone' WHEN doc_id % 31 = 0 THEN 'new' ELSE 'changed' END AS reason FROM documents WHERE (doc_id % 29 = 0) <> (doc_id % 31 = 0) OR (doc_id % 13 = 0 AND doc_id % 29 <> 0 AND doc_id % 31 <> 0)")
def vf02_verify_bindings(spark, d):
    docs = views.table(spark, d, "documents").selectExpr("doc_id", "sha2(cast(text AS binary), 256) AS sha")
    current = docs.where("doc_id % 29 <> 0").selectExpr("doc_id", "CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE sha END AS sha")
    return checks.verify_bindings(docs.where("doc_id % 31 <> 0"), current, "doc_id", "sha")




@query(
    """, r AS (SELECT user_id, count(*) FILTER (event_id % 2 = s) AS seconds, (sum(event_id) FILTER (event_id % 2 = s))::BIGINT AS bytes, count(*) FILTER (event_type = 'signup' AND event_id % 2 = s) // 8 AS signups, count(*) FILTER (event_type = 'error' AND event_id % 40 = s) AS errors, s FROM events, (VALUES (0), (1)) v(s) GROUP BY user_id, s)
SELECT b.user_id, CASE WHEN b.user_id % 7 = 3 THEN 'input' WHEN b.user_id % 11 = 5 THEN 'environment' WHEN b.signups <> c.signups THEN 'counts' WHEN b.errors > 0 OR c.errors > 0 THEN 'differences' END AS reason,
    b.seconds::DOUBLE - c.seconds::DOUBLE AS seconds_saved, CASE WHEN b.seconds > 0 THEN (b.seconds::DOUBLE - c.seconds::DOUBLE) / b.seconds::DOUBLE * 100 END AS percent, b.bytes - c.bytes AS bytes_saved, c.seconds < 32 AND c.bytes < 160000 AS goals_met
FROM r b JOIN r c ON b.user_id = c.user_id AND b.s = 0 AND c.s = 1"""
)
def vf03_compare_runs(spark, d):
    """Each user's even events are a base run, the odd ones a candidate."""
    e = views.table(spark, d, "events")

    def run(s: int):
        own = e.groupBy("user_id").agg(F.count_if(F.expr(f"event_id % 2 = {s}")).cast("double").alias("seconds"), F.expr(f"sum(event_id) FILTER (WHERE event_id % 2 = {s})").alias("bytes"), F.count_if(F.expr(f"event_type = 'signup' AND event_id % 2 = {s}")).alias("signups"), F.count_if(F.expr(f"event_type = 'error' AND event_id % 40 = {s}")).alias("differences"))
        return own.selectExpr("user_id", f"CASE WHEN user_id % 7 = 3 THEN {s} ELSE 9 END AS input", f"CASE WHEN user_id % 11 = 5 THEN {s} ELSE 9 END AS environment", "map('signups', signups div 8) AS counts", "differences", "seconds", "bytes")

    return checks.compare_runs(run(0), run(1), ["user_id"], 32.0, 160_000)


@query(
    """, w AS (SELECT max(x) AS most FROM pix), rois AS (SELECT concat('part ', k) AS name, k * 100 + k % 7 AS rx, k % 40 AS ry, 60 + k % 30 AS rw, 20 AS rh FROM w, range(0, most // 100 + 1) r(k))
SELECT name, count(*) AS compared, count(*) FILTER ((x * y) % 19 = 5) AS different FROM pix JOIN rois ON x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh GROUP BY name"""
)
def vf04_verify_patches(spark, d):
    """A rectangle in every hundred columns of the table."""
    a = views.pix(spark, d)
    b = a.withColumn("r", F.expr("CASE WHEN (x * y) % 19 = 5 THEN r + 1 ELSE r END"))
    rois = views.table(spark, d, "embeddings").selectExpr("vec_id div 100 AS k").distinct().selectExpr("concat('part ', k) AS name", "k * 100 + k % 7 AS rx", "k % 40 AS ry", "60 + k % 30 AS rw", "20 AS rh")
    return checks.verify_patches(a, b, rois, ["r", "g", "b", "a"])


@query("SELECT x, y, 0 AS mask, '' AS side FROM g_dense WHERE FALSE")
def vf05_chunk_invariance(spark, d):
    """The 4-mask by chunks of 16 with a halo of one: no rows differ."""
    return checks.check_chunk_invariance(views.g_dense(spark, d), lambda cells, world: neighbors4(cells, F.col("kind") >= 0, world).select(*world, "x", "y", "mask"), 16, 1)


@query(
    """, p AS (SELECT x, y FROM g_dense WHERE kind >= 0), m AS (SELECT g.x, g.y, coalesce((SELECT 2 FROM p WHERE p.x = g.x - 1 AND p.y = g.y), 0) AS w, coalesce((SELECT 4 FROM p WHERE p.x = g.x + 1 AND p.y = g.y), 0) AS e,
    coalesce((SELECT 1 FROM p WHERE p.x = g.x AND p.y = g.y - 1), 0) AS n, coalesce((SELECT 8 FROM p WHERE p.x = g.x AND p.y = g.y + 1), 0) AS s FROM g_dense g),
f AS (SELECT x, y, n + w + e + s AS whole, CASE WHEN x % 16 = 0 THEN 0 ELSE w END + CASE WHEN x % 16 = 15 THEN 0 ELSE e END + CASE WHEN y % 16 = 0 THEN 0 ELSE n END + CASE WHEN y % 16 = 15 THEN 0 ELSE s END AS parts FROM m)
SELECT x, y, whole::INT AS mask, 'whole' AS side FROM f WHERE whole <> parts UNION ALL SELECT x, y, parts::INT, 'chunks' FROM f WHERE whole <> parts"""
)
def vf05_chunk_seams(spark, d):
    """The same without a halo: the seams."""
    return checks.check_chunk_invariance(views.g_dense(spark, d), lambda cells, world: neighbors4(cells, F.col("kind") >= 0, world).select(*world, "x", "y", "mask"), 16, 0)
