"""Coverage maps, overviews at several scales, viewports and frame lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalars import recipe_id
from gridspark.operators.aggs import coverage_mask, majority, overview_levels
from gridspark.operators.joins import rect_overlap
from gridspark.operators.project import in_rect


def coverage_map(cells: DataFrame, omissions: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Combined code of each cell and its legend: the names of its reasons, or covered."""
    coded = cells.select("x", "y").join(coverage_mask(omissions), ["x", "y"], "left").withColumn("code", F.coalesce("code", F.lit(0)))
    parts = F.concat_ws("+", *[F.when(F.col("code").bitwiseAND(bit) != 0, name) for bit, name in names.items()])
    return coded.withColumn("legend", F.when(F.col("code") == 0, "covered").otherwise(parts))


def overview(pixels: DataFrame, factors: Sequence[int], rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Reductions of all pixels, or of those in a rectangle, by ``factor``."""
    return overview_levels(pixels.where(in_rect(*rect)) if rect else pixels, factors)


def overview_kinds(cells: DataFrame, factor: int, precedence: Sequence) -> DataFrame:
    """The most frequent listed kind of each block; null where none occurs."""
    blocks = cells.select(F.floor(F.col("x") / F.lit(factor)).alias("bx"), F.floor(F.col("y") / F.lit(factor)).alias("by"), "kind")
    return majority(blocks, ["bx", "by"], "kind", precedence).select(F.col("bx").alias("x"), F.col("by").alias("y"), "majority")


def query_viewports(requests: DataFrame, cells: DataFrame, commands: DataFrame, pixels: int = 16) -> DataFrame:
    """For each request (request_id, rx, ry, rw, rh in cells): number and level of its cells, number and top-most of its commands.

    Cells are summed down each column once; a request takes the difference of the sums at its two edges in each of its columns, so
    that cells aren't copied to requests. Commands of one rectangle are counted first, and come from the bucket join; requests without
    either stay.
    """
    rects = requests.withColumnRenamed("request_id", "rect_id")
    none = F.lit(None).cast(rects.schema["rect_id"].dataType)
    points = cells.select("x", (F.col("y") * 2).cast("long").alias("at"), none.alias("rect_id"), F.lit(0).alias("sign"), F.lit(1).alias("n"), F.col("level"))
    edge = F.explode(F.array(F.struct((F.col("ry") * 2 - 1).cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(((F.col("ry") + F.col("rh")) * 2 - 1).cast("long").alias("at"), F.lit(1).alias("sign"))))
    sides = rects.where("rw > 0 AND rh > 0").select("rect_id", F.explode(F.sequence("rx", F.col("rx") + F.col("rw") - 1)).alias("x"), "ry", "rh").select("rect_id", "x", edge.alias("e")).select("x", "e.at", "rect_id", "e.sign", F.lit(0).alias("n"), F.lit(0).cast(cells.schema["level"].dataType).alias("level"))
    down = Window.partitionBy("x").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = points.union(sides).withColumns({"n": F.sum("n").over(down), "level": F.sum("level").over(down)}).where("sign <> 0")
    found = sums.groupBy("rect_id").agg(F.sum(F.col("sign") * F.col("n")).alias("cells"), F.sum(F.col("sign") * F.col("level")).alias("level"))
    found = found.where("cells > 0")
    scaled = rects.select("rect_id", *[(F.col(c) * pixels).alias(c) for c in ("rx", "ry", "rw", "rh")])
    places = commands.groupBy("dx", "dy", "dw", "dh").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))  # commands of one rectangle meet the same requests
    drawn = rect_overlap(places, scaled, bucket=256).groupBy("rect_id").agg(F.sum("n").alias("commands"), F.max("seq").alias("top"))
    joined = rects.select("rect_id").join(found, "rect_id", "left").join(drawn, "rect_id", "left")
    return joined.select(F.col("rect_id").alias("request_id"), F.coalesce("cells", F.lit(0)).alias("cells"), "level", F.coalesce("commands", F.lit(0)).alias("commands"), "top")


def compile_frames(parts: DataFrame, present: DataFrame, variants: int, shapes: int, paints: int, kind: int = 2) -> DataFrame:
    """All frames of the assets that are there: ``parts (asset, type)``, ``present (asset)``. The recipes of an asset are exploded from
    fixed ranges, so nothing but the parts grows with the input."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    frames = parts.join(present, "asset", "left_semi").withColumn("variant", each(variants)).withColumn("shape", each(shapes)).withColumn("paint", each(paints))
    recipe = recipe_id(kind=F.lit(kind), type=F.col("type"), variant=F.col("variant"), shape=F.col("shape"), paint=F.col("paint"))
    return frames.select("asset", "variant", "shape", "paint", recipe.alias("recipe"))
