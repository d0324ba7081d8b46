"""Verification jobs: manifests, bindings, benchmark runs, patches and chunk invariance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggs import exact_cover
from .joins import diff_cells, halo_exchange
from .project import in_rect


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Pieces that don't agree: key and ``reason``: missing, additional, repeated, or the first column that differs."""
    once = lambda df: df.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in columns])
    both = once(manifest).alias("m").join(once(actual).alias("a"), key, "full_outer")
    reason = F.when(F.col("a._n").isNull(), "missing").when(F.col("m._n").isNull(), "additional").when((F.col("a._n") > 1) | (F.col("m._n") > 1), "repeated")
    for c in columns:
        reason = reason.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"a.{c}")), c)
    return both.select(key, reason.alias("reason")).where("reason is not null")


#: Pixels of a cell, the largest piece, and the names that pieces may have.
CELL, LARGEST_WIDTH, LARGEST_HEIGHT, PIECE_NAME = 16, 4032, 512, r"^tile-\d+-\d+\.png$"


def verify_pieces(manifest: DataFrame, files: DataFrame, world: tuple[int, int, int, int]) -> DataFrame:
    """Whether pieces make up a whole: (file, x, y, reason). ``world`` is the whole's x, y, width and height in cells.

    ``manifest (file, x, y, width, height, world_x, world_y, world_width, world_height, bytes, sha256)`` has pixels and cells of each piece, ``files (file,
    width, height, bytes, sha256)`` what is there. The first reason of a piece counts: repeated, name, missing, dimensions, bytes, sha256, alignment (of pixels
    to cells), size (none, or too large), position (pixels that aren't the cells' place), outside; files that no piece names are additional.
    Cells that pieces cover twice or not at all are ``overlap`` or ``hole`` at their x and y, without a file: the cover is counted in one
    shuffle of the cells.
    """
    left, top, width, height = world
    there = files.select("file", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "bytes", "sha256")]).withColumn("_there", F.lit(True))
    named = manifest.withColumn("_n", F.count("*").over(Window.partitionBy("file"))).join(there, "file", "left")
    c = F.col
    differs = lambda *names: ~reduce(lambda a, b: a & b, [c(n).eqNullSafe(c(f"_{n}")) for n in names])
    aligned = reduce(lambda a, b: a & b, [F.coalesce(c(n) % CELL == 0, F.lit(False)) for n in ("x", "y", "width", "height")])
    sized = c("width").between(1, LARGEST_WIDTH) & c("height").between(1, LARGEST_HEIGHT)
    placed = (c("x") == (c("world_x") - left) * CELL) & (c("y") == (c("world_y") - top) * CELL) & (c("width") == c("world_width") * CELL) & (c("height") == c("world_height") * CELL)
    inside = (c("x") >= 0) & (c("y") >= 0) & (c("x") + c("width") <= width * CELL) & (c("y") + c("height") <= height * CELL)
    no = lambda test: ~F.coalesce(test, F.lit(False))
    reason = (
        F.when(c("_n") > 1, "repeated").when(no(c("file").rlike(PIECE_NAME)), "name").when(c("_there").isNull(), "missing").when(differs("width", "height"), "dimensions").when(differs("bytes"), "bytes").when(differs("sha256"), "sha256")
        .when(~aligned, "alignment").when(no(sized), "size").when(no(placed), "position").when(no(inside), "outside")
    )
    nowhere = F.lit(None).cast("long")
    bad = named.select("file", nowhere.alias("x"), nowhere.alias("y"), reason.alias("reason")).where("reason is not null")
    more = files.join(manifest.select("file"), "file", "left_anti").select("file", nowhere.alias("x"), nowhere.alias("y"), F.lit("additional").alias("reason"))
    in_cells = manifest.where(aligned & sized).selectExpr(f"x div {CELL} AS x", f"y div {CELL} AS y", f"width div {CELL} AS width", f"height div {CELL} AS height")
    all_cells = manifest.sparkSession.range(width * height).selectExpr(f"id div {height} AS x", f"id % {height} AS y")
    cover = exact_cover(in_cells, all_cells).select(F.lit(None).cast("string").alias("file"), c("x").cast("long").alias("x"), c("y").cast("long").alias("y"), F.when(c("times") > 1, "overlap").otherwise("hole").alias("reason"))
    return bad.unionByName(more).unionByName(cover)


def verify_bindings(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """What makes a stored result stale: key and ``reason``: changed, gone or new."""
    r, c = recorded.select(key, F.col(digest).alias("_r")), current.select(key, F.col(digest).alias("_c"))
    both = r.withColumn("_in_r", F.lit(True)).join(c.withColumn("_in_c", F.lit(True)), key, "full_outer")
    reason = F.when(F.col("_in_c").isNull(), "gone").when(F.col("_in_r").isNull(), "new").when(~F.col("_r").eqNullSafe(F.col("_c")), "changed")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def compare_runs(base: DataFrame, candidate: DataFrame, keys: Sequence[str], goal_seconds: float, goal_bytes: int) -> DataFrame:
    """Pairs of runs (keys, input, environment, counts map, differences, seconds, bytes): whether they may be compared, and what was saved.

    ``reason`` is null where input, environment and counts agree and nothing differs.
    """
    ordered = lambda c: F.array_sort(F.map_entries(c))
    pairs = base.alias("b").join(candidate.alias("c"), list(keys))
    reason = (
        F.when(~F.col("b.input").eqNullSafe(F.col("c.input")), "input")
        .when(~F.col("b.environment").eqNullSafe(F.col("c.environment")), "environment")
        .when(~ordered(F.col("b.counts")).eqNullSafe(ordered(F.col("c.counts"))), "counts")
        .when((F.col("b.differences") > 0) | (F.col("c.differences") > 0), "differences")
    )
    saved = F.col("b.seconds") - F.col("c.seconds")
    percent = F.when(F.col("b.seconds") > 0, saved / F.col("b.seconds") * 100)
    met = (F.col("c.seconds") < goal_seconds) & (F.col("c.bytes") < goal_bytes)
    return pairs.select(*keys, reason.alias("reason"), saved.alias("seconds_saved"), percent.alias("percent"), (F.col("b.bytes") - F.col("c.bytes")).alias("bytes_saved"), met.alias("goals_met"))


def verify_patches(a: DataFrame, b: DataFrame, rois: DataFrame, columns: Sequence[str], bucket: int = 64) -> DataFrame:
    """For each rectangle of ``rois (name, rx, ry, rw, rh)``: compared cells and how many differ. Cells and rectangles meet by buckets of the
    grid with an exact test; rectangles without cells give no row."""
    spread = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / F.lit(bucket)), F.floor((F.col(at) + F.col(size) - 1) / F.lit(bucket))))
    wanted = rois.where("rw > 0 AND rh > 0").withColumn("_bx", spread("rx", "rw")).withColumn("_by", spread("ry", "rh"))
    value = F.struct(*columns)
    both = a.select("x", "y", F.lit(0).alias("_side"), value.alias("_v")).union(b.select("x", "y", F.lit(1), value))
    cells = both.groupBy("x", "y").agg(*[F.collect_list(F.when(F.col("_side") == k, F.col("_v"))).alias(f"_{k}") for k in (0, 1)])
    differs = ~F.array_sort("_0").eqNullSafe(F.array_sort("_1"))
    placed = cells.select("x", "y", differs.alias("_d"), F.floor(F.col("x") / F.lit(bucket)).alias("_bx"), F.floor(F.col("y") / F.lit(bucket)).alias("_by"))
    inside = placed.join(wanted, ["_bx", "_by"]).where("x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh")
    return inside.groupBy("name").agg(F.count("*").alias("compared"), F.count_if("_d").alias("different"))


def check_chunk_invariance(cells: DataFrame, fn: Callable[[DataFrame, Sequence[str]], DataFrame], chunk: int, pad: int) -> DataFrame:
    """Rows by which ``fn(cells, world)`` differs between chunks with a halo of ``pad`` and the whole: empty if it has no seams.

    ``fn`` returns x, y and its columns, and keeps the keys in ``world``.
    """
    whole = fn(cells, [])
    parts = halo_exchange(cells, chunk, pad)
    core = parts.where("is_core").select("cx", "cy", "x", "y")
    found = fn(parts.drop("is_core"), ["cx", "cy"]).join(core, ["cx", "cy", "x", "y"], "left_semi").select(*whole.columns)
    return whole.exceptAll(found).withColumn("side", F.lit("whole")).unionByName(found.exceptAll(whole).withColumn("side", F.lit("chunks")))
