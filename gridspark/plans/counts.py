"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import aggs, joins
from gridspark.plans.registry import query
from gridspark.sources import views

REASONS = [(1, "dy % 3 = 0"), (2, "dx % 5 = 0"), (4, "dw = 48"), (8, "asset = '5-LOW'")]


def omissions(spark, d):
    """An omission for each reason that a command has: cell, code and reason."""
    found = F.explode(F.filter(F.array(*[F.when(F.expr(p), F.lit(c)) for c, p in REASONS]), lambda c: c.isNotNull()))
    return views.cmds(spark, d).select(F.floor(F.col("dx") / F.lit(16)).alias("x"), F.floor(F.col("dy") / F.lit(16)).alias("y"), found.alias("code"))


OMISSIONS = ", om AS (" + " UNION ALL ".join(f"SELECT dx // 16 AS x, dy // 16 AS y, {c} AS code FROM cmds WHERE {p}" for c, p in REASONS) + ")"


@query("SELECT kind, count(*) AS cells, count(*) FILTER (kind >= 0) AS front, 0::BIGINT AS none FROM g_dense GROUP BY kind")
def ag01_inventory(spark, d):
    """Cells by kind from the runs, weighted by their length."""
    return aggs.inventory(views.r_dense(spark, d), ["kind"], {"front": F.col("kind") >= 0, "none": F.lit(False)})


@query("SELECT event_type AS kind, user_id % 4 AS layer, grouping_id(event_type, user_id % 4)::INT AS gid, count(*) AS cells FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), (event_type, user_id % 4), ())")
def ag02_inventory_cube(spark, d):
    runs = views.r_events(spark, d).withColumn("layer", F.col("x") % 4)
    return aggs.inventory_cube(runs, ["kind", "layer"], [["kind"], ["layer"], ["kind", "layer"], []])


@query(
    """SELECT count(*) FILTER (kind >= 0) AS active, count(*) FILTER (kind >= 0 AND level % 4 = 0) AS hidden, count(*) FILTER (level > 128) AS bright, count(*) FILTER (solid) AS solid, count(*) FILTER (solid IS NULL) AS unknown,
    count(*) FILTER (level % 2 = 1) AS painted, count(*) FILTER (layer = 'liquid') AS liquid, count(*) FILTER (family_mask & 2 <> 0) AS plants FROM g_dense LEFT JOIN d_kind USING (kind)"""
)
def ag03_support_counters(spark, d):
    cells = views.g_dense(spark, d).join(F.broadcast(views.d_kind(spark)), "kind", "left")
    tests = {"active": "kind >= 0", "hidden": "kind >= 0 AND level % 4 = 0", "bright": "level > 128", "solid": "solid", "unknown": "solid IS NULL", "painted": "level % 2 = 1", "liquid": "layer = 'liquid'", "plants": "(family_mask & 2) <> 0"}
    return aggs.support_counters(cells, {k: F.expr(v) for k, v in tests.items()})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ag04_sorted_counts(spark, d):
    return aggs.sorted_counts(views.table(spark, d, "events"), "event_type")


@query(OMISSIONS + " SELECT x, y, bit_or(code) AS code FROM om GROUP BY x, y")
def ag05_coverage_mask(spark, d):
    return aggs.coverage_mask(omissions(spark, d))


@query(OMISSIONS + ", m AS (SELECT x, y, bit_or(code) AS code FROM om GROUP BY x, y), c AS (SELECT i % 128 AS x, i // 128 AS y FROM range(0, 8192) t(i)) SELECT coalesce(code, 0) AS code, count(*) AS cells FROM c LEFT JOIN m USING (x, y) GROUP BY 1")
def ag06_coverage_histogram(spark, d):
    cells = spark.range(128 * 64).selectExpr("id % 128 AS x", "id div 128 AS y")
    return aggs.coverage_histogram(cells, omissions(spark, d))


@query("SELECT kind, first(x ORDER BY x // 128, y // 128, x, y) AS x, first(y ORDER BY x // 128, y // 128, x, y) AS y, count(*) AS n FROM (SELECT * FROM g_dense WHERE level > 20) GROUP BY kind")
def ag07_first_example(spark, d):
    return aggs.first_example(views.g_dense(spark, d).where("level > 20"), ["kind"])


@query("SELECT x // 50 AS part, min(x) FILTER (kind = 1) AS min_x, min(y) FILTER (kind = 1) AS min_y, max(x) FILTER (kind = 1) AS max_x, max(y) FILTER (kind = 1) AS max_y FROM g_dense GROUP BY 1")
def ag08_bounding_box(spark, d):
    cells = views.g_dense(spark, d).withColumn("part", F.expr("x div 50"))
    return aggs.bounding_box(cells, F.col("kind") == 1, ["part"])


@query(
    """SELECT x // 100 AS part, count(*) AS visible, count(*) FILTER (level % 3 = 0) AS planned, count(*) FILTER (level % 3 = 1) AS hidden, count(*) FILTER (level % 3 = 2 AND level % 5 <> 0) AS unsupported,
    count(*) FILTER (level % 3 = 2 AND level % 5 = 0) AS difference, count(*) FILTER (level % 3 = 2 AND level % 5 = 0) = 0 AS balanced FROM g_dense GROUP BY 1"""
)
def ag09_reconcile(spark, d):
    cells = views.g_dense(spark, d).withColumn("part", F.expr("x div 100"))
    tests = {"visible": "true", "planned": "level % 3 = 0", "hidden": "level % 3 = 1", "unsupported": "level % 3 = 2 AND level % 5 <> 0"}
    return aggs.reconcile(aggs.support_counters(cells, {k: F.expr(v) for k, v in tests.items()}, ["part"]), "visible", ["planned", "hidden", "unsupported"])


@query(
    """, p AS (SELECT DISTINCT x // 50 * 50 AS x0, y // 16 * 16 AS y0, CASE WHEN x // 50 = 3 THEN 51 ELSE 50 END AS w, CASE WHEN y // 16 = 1 THEN 15 ELSE 16 END AS h FROM g_dense),
c AS (SELECT g.x, g.y::BIGINT AS y, count(p.w) AS times FROM g_dense g LEFT JOIN p ON g.x >= x0 AND g.x < x0 + w AND g.y >= y0 AND g.y < y0 + h GROUP BY 1, 2)
SELECT * FROM c WHERE times <> 1"""
)
def ag10_exact_cover(spark, d):
    cells = views.g_dense(spark, d)
    pieces = cells.selectExpr("x div 50 * 50 AS x", "y div 16 * 16 AS y", "CASE WHEN x div 50 = 3 THEN 51 ELSE 50 END AS width", "CASE WHEN y div 16 = 1 THEN 15 ELSE 16 END AS height").distinct()
    return aggs.exact_cover(pieces, cells)


MEANS = """CASE WHEN sum(a) > 0 THEN ((sum(r * a) + sum(a) // 2) // sum(a))::BIGINT ELSE 0 END AS r, CASE WHEN sum(a) > 0 THEN ((sum(g * a) + sum(a) // 2) // sum(a))::BIGINT ELSE 0 END AS g,
    CASE WHEN sum(a) > 0 THEN ((sum(b * a) + sum(a) // 2) // sum(a))::BIGINT ELSE 0 END AS b, ((sum(a) + count(*) // 2) // count(*))::BIGINT AS a"""


@query(f"SELECT x // 8 AS x, (y // 8)::BIGINT AS y, {MEANS} FROM pix GROUP BY pix.x // 8, pix.y // 8")
def ag11_area_reduce(spark, d):
    return aggs.area_reduce(views.pix(spark, d), 8)


@query(f"SELECT f::INT AS factor, x // f AS x, (y // f)::BIGINT AS y, {MEANS} FROM pix, (VALUES (2), (4), (8), (16)) v(f) GROUP BY f, pix.x // f, pix.y // f")
def ag12_overview_levels(spark, d):
    return aggs.overview_levels(views.pix(spark, d), [2, 4, 8, 16])


CELLS = "SELECT dx // 16 + i AS cell_x, dy // 16 AS cell_y, seq, asset, kind FROM cmds, range(0, 3) t(i) WHERE i < dw // 16"


@query(f", c AS ({CELLS}) SELECT cell_x, cell_y, max(seq) AS seq, arg_max(asset, seq) AS asset FROM c GROUP BY cell_x, cell_y")
def ag13_last_touch(spark, d):
    return aggs.last_touch(views.cmds(spark, d))


@query(f", c AS ({CELLS}) SELECT seq FROM c GROUP BY seq HAVING bool_and((cell_x + cell_y) % 4 <> 0)")
def ag14_fully_covered(spark, d):
    safe = spark.range(130 * 64).selectExpr("id % 130 AS cell_x", "id div 130 AS cell_y").where("(cell_x + cell_y) % 4 <> 0")
    return aggs.fully_covered(views.cmds(spark, d), safe)


@query(
    f""", c AS ({CELLS}), o AS (SELECT cell_x, cell_y, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY seq) AS k, least(seq % 200, seq % 7 * 30) AS v, seq % 200 AS a FROM c),
s AS (SELECT cell_x, cell_y, k, v AS value, a AS alpha FROM o WHERE k = 1
    UNION ALL SELECT o.cell_x, o.cell_y, o.k, least(255, o.v + (s.value * (255 - o.a) * 2 + 255) // 510), least(255, o.a + (s.alpha * (255 - o.a) * 2 + 255) // 510) FROM s JOIN o ON o.cell_x = s.cell_x AND o.cell_y = s.cell_y AND o.k = s.k + 1)
SELECT cell_x, cell_y, arg_max(value, k) AS value, arg_max(alpha, k) AS alpha FROM s GROUP BY 1, 2"""
)
def ag15_compose(spark, d):
    samples = aggs.covered_cells(views.cmds(spark, d)).selectExpr("cell_x", "cell_y", "seq", "least(seq % 200, seq % 7 * 30) AS value", "seq % 200 AS alpha")
    return aggs.compose(samples, ["cell_x", "cell_y"])


@query("SELECT x, y, (sum(s) OVER (PARTITION BY y ORDER BY x))::BIGINT AS total FROM (SELECT x, y, sum(level) OVER (PARTITION BY x ORDER BY y) AS s FROM g_dense)")
def ag16_summed_area(spark, d):
    return aggs.summed_area(views.g_dense(spark, d), "level")


@query("SELECT 'x' AS field, count(x) AS n, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, TRUE AS whole, TRUE AS close FROM g_dense UNION ALL SELECT 'level', count(level), min(level), max(level), TRUE, TRUE FROM g_dense UNION ALL SELECT 'y', count(y), min(y), max(y), TRUE, TRUE FROM g_dense")
def ag20_profile_of_sketches(spark, d):
    """The profile of a grid from its chunks' sketches alone; ``close``: the estimated distinct values are within 5 % of the exact ones, and the median's rank is
    within 3 % of a half."""
    cells = views.g_dense(spark, d).select("x", "y", "level")
    sketches = aggs.column_sketches(cells.withColumn("cx", F.expr("x div 128")), ["x", "y", "level"], ["cx"])
    found = aggs.profile_of_sketches(sketches)
    true = cells.unpivot([], ["x", "y", "level"], "field", "v").groupBy("field").agg(F.count_distinct("v").alias("d"))
    both = found.join(true, "field")
    ranks = cells.unpivot([], ["x", "y", "level"], "field", "v").join(found.select("field", F.col("quantiles")[0].alias("m")), "field")
    ranked = ranks.groupBy("field").agg((F.count_if(F.col("v") <= F.col("m")) / F.count("*")).alias("up_to"), (F.count_if(F.col("v") < F.col("m")) / F.count("*")).alias("below"))
    close = (F.abs(F.col("distinct") - F.col("d")) <= 0.05 * F.col("d")) & (F.col("below") <= 0.53) & (F.col("up_to") >= 0.47)
    return both.join(ranked, "field").select("field", "n", "min", "max", "whole", close.alias("close"))


SMALL_RECTS = "SELECT event_id AS rect_id, event_id * 37 % 400 AS rx, user_id * 11 % 40 AS ry, 1 + event_id % 90 AS rw, 1 + event_id % 20 AS rh FROM {} WHERE event_type = 'error'"


@query(f", r AS ({SMALL_RECTS.format('events')}) SELECT rect_id, (SELECT sum(level)::BIGINT FROM g_dense WHERE x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh) AS total FROM r")
def ag16_rect_count(spark, d):
    return aggs.rect_count(ag16_summed_area(spark, d), spark.sql(SMALL_RECTS.format("{events}"), events=views.table(spark, d, "events")))


@query(
    """, c AS (SELECT x % 1000 AS part, kind, count(*) AS n FROM g_sparse WHERE kind <> 'N' GROUP BY 1, 2), p AS (SELECT DISTINCT x % 1000 AS part FROM g_sparse)
SELECT part, kind AS majority, coalesce(n, 0) AS n FROM p LEFT JOIN c USING (part) QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC NULLS LAST, kind DESC) = 1"""
)
def ag17_majority(spark, d):
    cells = views.g_sparse(spark, d).withColumn("part", F.col("x") % 1000)
    return aggs.majority(cells, ["part"], "kind", ["R", "A"])


@query("SELECT seq, (dense_rank() OVER (ORDER BY f) - 1)::INT AS frame_id FROM (SELECT seq, min(seq) OVER (PARTITION BY asset, kind, dw) AS f FROM cmds)")
def ag18_intern_frames(spark, d):
    return aggs.intern_frames(views.cmds(spark, d), ["asset", "kind", "dw"])[1].select("seq", F.col("frame_id").cast("int").alias("frame_id"))


@query("SELECT doc_id, (dense_rank() OVER (ORDER BY f) - 1)::INT AS id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS f FROM documents)")
def ag19_dictionary_encode(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("value"))
    return aggs.dictionary_encode(docs, "value", "doc_id")[1].select("doc_id", F.col("id").cast("int").alias("id"))


@query("SELECT doc_id, concat_ws('/', source, lang) AS value FROM documents")
def ag19_dictionary_decode(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("value"))
    return aggs.dictionary_decode(*aggs.dictionary_encode(docs, "value", "doc_id"), "value").select("doc_id", "value")


PROFILED = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_suppkey"]


@query(
    ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::DOUBLE AS v FROM lineitem" for c in PROFILED) + """), s AS (SELECT field, count(DISTINCT v) AS "distinct", min(v) AS min, max(v) AS max, bool_and(v = floor(v)) AS is_integer FROM l GROUP BY field)
SELECT *, "distinct" = 1 AS is_constant, CASE WHEN NOT is_integer THEN 'f64' WHEN min >= 0 AND max <= 255 THEN 'u8' WHEN min >= -128 AND max <= 127 THEN 'i8' WHEN min >= 0 AND max <= 65535 THEN 'u16'
    WHEN min >= -32768 AND max <= 32767 THEN 'i16' WHEN min >= -2147483648 AND max <= 2147483647 THEN 'i32' ELSE 'f64' END AS narrowest FROM s"""
)
def ag20_profile_columns(spark, d):
    return aggs.profile_columns(views.table(spark, d, "lineitem"), PROFILED)


@query("SELECT asset, count(*) AS commands FROM cmds GROUP BY asset")
def ag21_required_assets(spark, d):
    return aggs.required_assets(views.cmds(spark, d))


@query("SELECT count(DISTINCT dx) AS n FROM cmds")
def ag22_count_distinct(spark, d):
    return aggs.count_distinct(views.cmds(spark, d), "dx")


@query("SELECT x // 2 AS fx, (y // 2)::BIGINT AS fy, CASE WHEN min(a) = 255 THEN ((sum(r) + count(*) // 2) // count(*))::BIGINT END AS r, CASE WHEN min(a) = 255 THEN ((sum(g) + count(*) // 2) // count(*))::BIGINT END AS g, CASE WHEN min(a) = 255 THEN ((sum(b) + count(*) // 2) // count(*))::BIGINT END AS b FROM pix GROUP BY 1, 2")
def ag23_opaque_mean(spark, d):
    return aggs.opaque_mean(views.pix(spark, d), [F.floor(F.col("x") / F.lit(2)).alias("fx"), F.floor(F.col("y") / F.lit(2)).alias("fy")])


@query("SELECT octet_length(encode(text))::INT AS size, sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def ag24_content_dedupe(spark, d):
    return aggs.content_dedupe(views.table(spark, d, "documents"), "doc_id", F.col("text"))


@query(", p AS (SELECT x, y FROM g_dense WHERE kind >= 0), m AS (SELECT g.x, (CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.x = g.x AND p.y = g.y - 1) THEN 1 ELSE 0 END) AS up FROM g_dense g) SELECT x, sum(up)::BIGINT AS touching FROM m GROUP BY x")
def ag01_touching_by_column(spark, d):
    """Cells with a front cell above, by column."""
    masks = joins.neighbors4(views.g_dense(spark, d), F.col("kind") >= 0).withColumn("mask", F.col("mask").bitwiseAND(1))
    return masks.groupBy("x").agg(F.sum("mask").alias("touching"))
