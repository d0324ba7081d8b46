"""Queries: files. Each writes what the tables give to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions.scalars import harvestable
from gridspark.operators import project
from gridspark.operators.runs import expand_runs
from gridspark.operators.storage import new_dir
from gridspark.plans import audit
from gridspark.plans.composite import AUDIT_SQL
from gridspark.plans.registry import query
from gridspark.plans.scans import CONDITIONAL, types_sql
from gridspark.sources import facts, files, grids, views, world_index, worlds

C = F.col


@query(
    """, w AS (SELECT DISTINCT x // 100 AS world FROM g_tiles), h AS (SELECT s AS style, world * 7 % 64 AS y, world FROM w, range(0, 7) t(s))
SELECT world, style::INT AS style, y::INT AS y, [world % 50, world % 50 + 5, 80] AS tree_x, (world * 3 % 200)::INT AS top, world % 2 = 0 AS remix_world, CASE WHEN style IN (2, 6) THEN FALSE WHEN style = 0 THEN world % 3 = 0 WHEN style = 1 THEN world % 3 <> 0 WHEN style = 3 THEN world % 3 <> 0 AND world % 8 = 0
    WHEN style = 4 THEN world % 5 = 0 OR world % 4 > 0 WHEN style = 5 THEN (world % 5 <> 0 OR CASE WHEN world % 2 = 0 THEN y < 64 - 350 ELSE y > 20 END) AND 40000 + world * 100 > 40500 END AS ripe FROM h"""
)
def src01_scenes_of_worlds(spark, d):
    """Trees, flags and the state of herbs from the headers of written world files, and whether herbs are ripe by them."""
    path = new_dir(spark, "worlds")
    cells = views.g_tiles(spark, d).selectExpr("cast(x div 100 AS int) AS world", "cast(x % 100 AS int) AS x", "y", "active", "CASE WHEN active THEN type ELSE 0 END AS type")
    # all worlds are 100 wide: a header may name no column beyond its world, and the table's last world may have fewer
    columns = cells.select("world", "x").distinct()
    missing = columns.select("world").distinct().select("world", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("x")).join(columns, ["world", "x"], "left_anti")
    cells = cells.unionByName(missing.select("world", "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"), F.lit(False).alias("active"), F.lit(0).alias("type")))
    # a day has 86,400 ticks, so later worlds stand at its end
    scene = ("array(world % 50, world % 50 + 5, 80) AS tree_x", "transform(sequence(0, 12), k -> world * 3 % 200) AS tree_tops", "cast(world % 2 = 0 AS int) AS remix_world", "20D AS world_surface", "least(40000D + world * 100, 86400D) AS time", "cast(world % 3 = 0 AS int) AS day_time",
             "world % 8 AS moon_phase", "0 AS blood_moon", "cast(world % 5 = 0 AS int) AS raining", "cast(world % 4 AS float) / 4 AS cloud_alpha")
    worlds.write_worlds(cells, path, ["world"], cells.select("world").distinct().selectExpr("world", *scene))
    found, _, _ = worlds.ingest_worlds(spark, path, mode="failfast")
    herbs = found.withColumn("world", F.regexp_extract("world_id", r"world-(\d+)\.wld$", 1).cast("long")).withColumn("style", F.explode(F.array(*map(F.lit, range(7))))).withColumn("y", (C("world") * 7 % 64).cast("int"))
    state = {k: C(k) for k in (*worlds.HERB, "remix_world", "world_surface")} | {"world_height": C("height")}
    return herbs.select("world", "style", "y", "tree_x", C("tree_tops")[12].alias("top"), "remix_world", harvestable(C("style"), C("y"), state).alias("ripe"))


@query("SELECT x, y, kind, level FROM g_dense WHERE x >= 70 AND x < 198 AND y >= 10 AND y < 50 AND kind IN (0, 1)")
def src02_zoned_region(spark, d):
    """A rectangle of some kinds from files in Z-order, by their zone map."""
    path = new_dir(spark, "zoned")
    grids.write_zoned(views.g_dense(spark, d), path, square=16)
    return grids.read_zoned(spark, path, 70, 10, 128, 40, kinds=[0, 1]).select("x", "y", "kind", "level")


@query("SELECT count(*) AS cells, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, list_sort(list(DISTINCT kind)) AS kinds, TRUE AS apart FROM g_dense")
def snk01_zone_map(spark, d):
    """The zone map of a written grid, summed up; ``apart``: its files' rectangles cover little more than the grid, so they hardly overlap."""
    zones = grids.write_zoned(views.g_dense(spark, d), new_dir(spark, "zoned"), square=16)
    area = F.sum((C("max_x") - C("min_x") + 1) * (C("max_y") - C("min_y") + 1))
    return zones.agg(
        F.sum("cells").alias("cells"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
        (area <= 3 * F.sum("cells")).alias("apart"),
    )


def tile_worlds(spark, d) -> str:
    """The folder of world files of 100 columns each, written from the grid of tiles."""
    path = new_dir(spark, "worlds")
    cells = views.g_tiles(spark, d).selectExpr(
        "cast(x div 100 AS int) AS world", "cast(x % 100 AS int) AS x", "y", "active", "CASE WHEN active THEN type ELSE 0 END AS type", "CASE WHEN active THEN shape ELSE 0 END AS shape",
        "cast(level AS int) AS liquid", "CASE WHEN level > 0 THEN liquid ELSE 0 END AS liquid_kind", "wall",
    )
    worlds.write_worlds(cells, path, ["world"])
    return path


def number():
    """The world of a file's name."""
    return F.regexp_extract("world_id", r"world-(\d+)\.wld$", 1).cast("long").alias("world")


@query(
    """SELECT x % 100 AS x, x // 100 AS world, sum(1) AS cells, count(*) FILTER (active) AS active, count(*) FILTER (level > 0) AS wet, coalesce(sum(type) FILTER (active), 0)::BIGINT AS types, sum(level)::BIGINT AS levels,
    sum(CASE WHEN active THEN shape ELSE 0 END)::BIGINT AS shapes, sum(wall)::BIGINT AS walls FROM g_tiles GROUP BY 1, 2"""
)
def src01_ingest_worlds(spark, d):
    """World files of 100 columns each, written from the grid's runs and ingested again: counters of every column."""
    _, runs, _ = worlds.ingest_worlds(spark, tile_worlds(spark, d), mode="failfast")
    times = lambda v: F.sum(v.cast("long") * C("run_len"))
    counted = {"cells": F.lit(1), "active": C("active").cast("int"), "wet": (C("liquid") > 0).cast("int"), "types": F.when(C("active"), C("type")).otherwise(0), "levels": C("liquid"), "shapes": F.when(C("active"), C("shape")).otherwise(0), "walls": C("wall")}
    return runs.groupBy(C("x").cast("long").alias("x"), number()).agg(*[times(v).alias(name) for name, v in counted.items()])


WANTED = (1, 21, 57, 300, 379, 518, 700)


@query(
    """SELECT x // 100 AS world, x % 100 AS x, count(*) AS cells, count(*) FILTER (active) AS active, coalesce(sum(type) FILTER (active), 0)::BIGINT AS types, sum(level)::BIGINT AS levels, sum(wall)::BIGINT AS walls
FROM g_tiles WHERE x % 100 >= 30 AND x % 100 < 75 AND y >= 10 AND y < 50 GROUP BY 1, 2"""
)
def src01_indexed_region(spark, d):
    """Columns 30 to 74 and rows 10 to 49 of every world file, by the index of slices and byte ranges: counters of every column."""
    index = new_dir(spark, "index")
    world_index.index_worlds(spark, tile_worlds(spark, d), index)
    runs = world_index.read_columns(spark, index, x=30, width=45, y=10, height=40, fields=["active", "type", "liquid", "wall"])
    times = lambda v: F.sum(v.cast("long") * C("run_len"))
    counted = {"cells": F.lit(1), "active": C("active").cast("int"), "types": F.when(C("active"), C("type")).otherwise(0), "levels": C("liquid"), "walls": C("wall")}
    return runs.groupBy(number(), C("x").cast("long").alias("x")).agg(*[times(v).alias(name) for name, v in counted.items()])


@query(f"SELECT x // 100 AS world, x % 100 AS x, y, type, wall FROM g_tiles WHERE active AND type IN ({', '.join(map(str, WANTED))})")
def src01_indexed_types(spark, d):
    """All cells of some types in all world files: slices without them aren't opened."""
    index = new_dir(spark, "index")
    world_index.index_worlds(spark, tile_worlds(spark, d), index)
    runs = world_index.read_columns(spark, index, types=WANTED, fields=["type", "wall"])
    return expand_runs(runs).select(number(), C("x").cast("long").alias("x"), "y", "type", "wall")


@query(
    """, s AS (SELECT x // 100 AS world, x % 100 // 64 * 64 AS x0, count(DISTINCT x) AS columns, coalesce(list_sort(list(DISTINCT type) FILTER (active)), []) AS types, bool_or(level > 0) AS wet FROM g_tiles GROUP BY 1, 2)
SELECT world, x0::INT AS x0, columns::INT AS columns, len(types)::INT AS kinds, types[1] AS least, types[-1] AS most, wet FROM s"""
)
def src01_index_of_worlds(spark, d):
    """What the index says of each slice of columns."""
    slices = world_index.index_worlds(spark, tile_worlds(spark, d), new_dir(spark, "index"))
    return slices.select(number(), "x0", "columns", F.size("types").alias("kinds"), F.array_min("types").alias("least"), F.array_max("types").alias("most"), "wet")


@query("SELECT x, y::BIGINT AS y, printf('%02x%02x', (level % 64)::INT, kind + 3) AS raw FROM g_dense")
def snk02_src03_fragments(spark, d):
    """Fragments of 16 columns: written with dictionaries and checksums, read back, checked and decoded."""
    path = new_dir(spark, "fragments")
    cells = views.g_dense(spark, d).selectExpr("x", "y", "cast(x div 16 AS string) AS fragment_id", "cast(x % 16 * 64 + y AS int) AS index", "unhex(concat(lpad(hex(level % 64), 2, '0'), lpad(hex(kind + 3), 2, '0'))) AS raw")
    rect = F.struct((C("x0")).cast("int").alias("x"), F.lit(0).alias("y"), C("n").cast("int").alias("width"), F.lit(64).alias("height"))
    source = F.struct(F.lit(worlds.SIGNATURES[0].decode()).alias("signature"), F.lit("grid").alias("name"), F.lit(1).alias("id"), F.lit(1 << 30).alias("width"), F.lit(64).alias("height"), F.lit(None).cast("double").alias("worldSurface"))
    fragments = cells.groupBy("fragment_id").agg(F.min("x").alias("x0"), F.count_distinct("x").alias("n")).select("fragment_id", F.lit(300).alias("version"), rect.alias("rect"), source.alias("source"), F.array(F.lit(0), F.lit(1)).alias("important"))
    files.write_fragments(cells.select("fragment_id", "index", "raw"), fragments, path)
    return files.read_fragments(spark, path)[1].select(C("x").cast("long").alias("x"), C("y").cast("long").alias("y"), F.lower(F.hex("raw")).alias("raw"))


@query("SELECT fragment_id::BIGINT AS fragment_id, 'checksum' AS reason FROM (SELECT DISTINCT x // 16 AS fragment_id FROM g_dense) WHERE fragment_id % 3 = 0")
def src03_damaged_fragments(spark, d):
    """Every third fragment has another name than its checksum was made for: it is a violation and gives no cells."""
    path = new_dir(spark, "fragments")
    cells = views.g_dense(spark, d).selectExpr("cast(x div 16 AS string) AS fragment_id", "x", "cast(x % 16 * 64 + y AS int) AS index", "unhex(lpad(hex(level % 64), 2, '0')) AS raw")
    size = cells.groupBy("fragment_id").agg(F.min("x").alias("x0"), F.count_distinct("x").alias("n"))
    fragments = size.select("fragment_id", F.lit(300).alias("version"), F.struct(C("x0").cast("int").alias("x"), F.lit(0).alias("y"), C("n").cast("int").alias("width"), F.lit(64).alias("height")).alias("rect"),
        F.struct(F.lit(worlds.SIGNATURES[0].decode()).alias("signature"), F.concat(F.lit("part-"), "fragment_id").alias("name"), F.lit(1).alias("id"), F.lit(1 << 30).alias("width"), F.lit(64).alias("height"), F.lit(None).cast("double").alias("worldSurface")).alias("source"), F.array(F.lit(0)).alias("important"))
    lines = files.fragment_json(cells.select("fragment_id", "index", "raw"), fragments)
    damaged = F.when(C("fragment_id").cast("long") % 3 == 0, F.replace("json", F.lit('"name":"part-'), F.lit('"name":"Part-'))).otherwise(C("json"))
    lines.select(damaged.alias("value")).write.text(path)
    names = spark.read.text(path).select(F.sha2(C("value").cast("binary"), 256).alias("fragment_id"), F.regexp_extract("value", "[Pp]art-([0-9]+)", 1).cast("long").alias("number"))
    return files.read_fragments(spark, path)[2].join(names, "fragment_id").select(C("number").alias("fragment_id"), "reason")


@query(
    """, t AS (SELECT p_partkey, concat('p', p_partkey // 2 * 2 + (p_partkey % 10 > 1)::INT * (p_partkey % 2), '.png') AS file, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 100 END AS bytes, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE sha256(p_name) END AS sha FROM part),
k AS (SELECT file, count(*) AS copies FROM t GROUP BY file)
SELECT file, CASE WHEN copies > 1 THEN 'duplicate' WHEN bytes = 0 THEN 'size' WHEN sha = 'x' THEN 'hash' ELSE 'ok' END AS reason FROM t JOIN k USING (file)"""
)
def src04_asset_manifests(spark, d):
    """A manifest for each size of part, all read back: good assets and violations."""
    path = new_dir(spark, "manifests")
    t = views.table(spark, d, "part").selectExpr(
        "p_size", "concat('p', p_partkey div 2 * 2 + cast(p_partkey % 10 > 1 AS int) * (p_partkey % 2), '.png') AS file", "cast(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 100 END AS bigint) AS bytes",
        "CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE sha2(p_name, 256) END AS sha256", "16 AS width", "16 AS height",
    )
    manifests = t.groupBy("p_size").agg(F.to_json(F.struct(F.collect_list(F.struct("file", "bytes", "sha256", "width", "height")).alias("textures"))).alias("value"))
    manifests.repartition("p_size").write.partitionBy("p_size").text(path)
    good, bad = files.read_asset_manifest(spark, path)
    return good.select("file", F.lit("ok").alias("reason")).unionByName(bad)


@query(
    """SELECT concat('s', s_suppkey, '.png') AS file, CASE WHEN s_suppkey % 5 = 0 THEN 6 ELSE 24 + strlen(s_name) END::BIGINT AS bytes, CASE WHEN s_suppkey % 5 > 0 THEN 1 + s_suppkey % 40 END AS width, CASE WHEN s_suppkey % 5 > 0 THEN 1 + s_nationkey END::BIGINT AS height,
    CASE WHEN s_suppkey % 5 > 0 THEN 'ok' ELSE 'not an image' END AS status FROM supplier"""
)
def src05_asset_catalogue(spark, d):
    """An image file for each supplier (every fifth is none), catalogued from its header."""
    path = new_dir(spark, "images")
    size = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(1 + C("s_suppkey") % 40), size(1 + C("s_nationkey")), C("s_name").cast("binary"))
    blobs = views.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".png")).alias("file"), F.when(C("s_suppkey") % 5 == 0, F.lit("GIF89a").cast("binary")).otherwise(png).alias("content"))
    files.write_blobs(blobs, path)
    return files.catalog_assets(spark, path).select("file", "bytes", "width", "height", "status")


@query("SELECT user_id, count(*) / 4.0::DOUBLE AS seconds, max(event_id) AS peak, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type <> 'click') AS others FROM events GROUP BY user_id")
def src06_bench_runs(spark, d):
    """A report file for each user's events, read back with the declared schema."""
    path = new_dir(spark, "reports")
    runs = views.table(spark, d, "events").groupBy("user_id").agg((F.count("*") / 4).alias("seconds"), F.max("event_id").alias("peak"), F.count_if(C("event_type") == "click").alias("clicks"), F.count_if(C("event_type") != "click").alias("others"))
    timing = F.struct(C("seconds").alias("endToEndSeconds"), C("peak").alias("conservativeAggregatePeakRssBytes"), F.lit(True).alias("targetPassed"))
    render = F.struct(C("user_id").cast("string").alias("worldSha256"), F.create_map(F.lit("click"), "clicks", F.lit("other"), "others").alias("commandCounts"))
    reports = runs.select(F.format_string("user-%d.json", "user_id").alias("file"), F.to_json(F.struct(timing.alias("timing"), render.alias("render"))).cast("binary").alias("content"))
    files.write_blobs(reports.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file"), path)  # small rows, but a file each: dealt to all tasks
    counts = C("render.commandCounts")
    return files.read_bench_runs(spark, path).select(C("render.worldSha256").cast("long").alias("user_id"), C("timing.endToEndSeconds").alias("seconds"), C("timing.conservativeAggregatePeakRssBytes").alias("peak"), counts["click"].alias("clicks"), counts["other"].alias("others"))


@query(AUDIT_SQL)
def snk03_report(spark, d):
    """The audit as a JSON report, read back."""
    path = new_dir(spark, "report")
    found = audit.audit_query(spark, d)
    grids.write_report(found, path)
    return spark.read.schema(found.schema).json(path)


@query("SELECT x, y, kind, level, TRUE AS refused FROM g_dense")
def snk04_refuses_existing(spark, d):
    """A second write to the same place is refused, and what the first one committed stays as it is."""
    path = new_dir(spark, "once")
    cells = views.g_dense(spark, d)
    grids.write_chunked(cells, path, 128, 64)
    try:
        grids.write_chunked(cells.limit(1), path, 128, 64)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).select("x", "y", "kind", "level", F.lit(refused).alias("refused"))


@query("SELECT x, y, printf('%02x%02x', (level & 63)::INT, kind + 3) AS raw FROM g_dense")
def prj08_canonical_raw(spark, d):
    raw = F.unhex(F.concat(F.lpad(F.hex("level"), 2, "0"), F.lpad(F.hex(C("kind") + 3), 2, "0")))
    return views.g_dense(spark, d).select("x", "y", F.lower(F.hex(project.canonical_raw(raw))).alias("raw"))


@query(
    f""", c AS (SELECT x, y, x // 100 AS world, active, type, shape, active AND wall % 5 <> 0 AS shown FROM g_tiles), {types_sql("cond", CONDITIONAL)}, {types_sql("plain", facts.ORDINARY)},
v AS (SELECT world, type, shape, (coalesce((SELECT 1 FROM c p WHERE p.shown AND p.world = g.world AND p.x = g.x AND p.y = g.y - 1), 0) + coalesce((SELECT 2 FROM c p WHERE p.shown AND p.world = g.world AND p.x = g.x - 1 AND p.y = g.y), 0)
    + coalesce((SELECT 4 FROM c p WHERE p.shown AND p.world = g.world AND p.x = g.x + 1 AND p.y = g.y), 0) + coalesce((SELECT 8 FROM c p WHERE p.shown AND p.world = g.world AND p.x = g.x AND p.y = g.y + 1), 0)) AS mask FROM c g WHERE shown),
j AS (SELECT *, CASE WHEN type IN (373, 374, 375, 461, 709) THEN 'hidden' WHEN type IN (SELECT type FROM cond) OR type IN (SELECT type FROM plain) OR type = 353 THEN 'planned' ELSE 'unsupported' END AS state, type IN (SELECT type FROM plain) AS plain FROM v),
k AS (SELECT *, state = 'planned' AND plain AND type % 3 = 0 AS missing, state = 'planned' AND plain AND type % 3 > 0 AND ([{', '.join(str(a) for a, _ in facts.BLOCK_FRAMES)}][mask + 1] + 16 > 180 OR [{', '.join(str(b) for _, b in facts.BLOCK_FRAMES)}][mask + 1] + 16 > 72) AS invalid FROM j)
SELECT world, count(*) AS visible, count(*) FILTER (state = 'planned') AS planned, count(*) FILTER (state = 'hidden') AS hidden, count(*) FILTER (state = 'unsupported') AS unsupported, count(*) FILTER (missing) AS missing, count(*) FILTER (invalid) AS invalid,
    count(*) FILTER (state = 'planned') - count(*) FILTER (missing) - count(*) FILTER (invalid) AS rendered, TRUE AS balanced FROM k GROUP BY world"""
)
def dm11_audit_of_files(spark, d):
    """From world files to runs, cells, masks, frames and assets, to a JSON report that is read back."""
    path, report = new_dir(spark, "worlds"), new_dir(spark, "report")
    cells = views.g_tiles(spark, d).selectExpr("cast(x div 100 AS int) AS world", "cast(x % 100 AS int) AS x", "y", "active", "CASE WHEN active THEN type ELSE 0 END AS type", "CASE WHEN active THEN shape ELSE 0 END AS shape", "wall % 5 = 0 AS invisible_block")
    worlds.write_worlds(cells, path, ["world"])
    assets = spark.range(facts.TYPES).where("id % 3 > 0").select(F.format_string("Tiles_%d.png", "id").alias("asset"), F.lit(180).alias("width"), F.lit(72).alias("height"))
    found = audit.audit_files(spark, path, assets)
    number = F.regexp_extract("world_id", r"world-(\d+)\.wld$", 1).cast("long").alias("world")
    found = found.select(number, *found.columns[1:])
    grids.write_report(found, report)
    return spark.read.schema(found.schema).json(report)
