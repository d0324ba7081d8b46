"""Composite operators on cells: masks, connections, liquids, sources and ground."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalars import fill_height, wall_variant

from .joins import DIRECTIONS, beside, neighbor_masks, neighbor_values, with_ring, zone_join
from .windows import register_capped

#: A side must hold more than this to feed a source, and above it less than that.
FEEDS, THIN = 160, 16
#: The liquids that set a source's fall, first to last, with the fall; other falls are 0. Cloud types and their falls.
FALLS = ((2, 1), (3, 14), (4, 25))
CLOUDS = {196: 11, 460: 22, 717: 26}


def terrain_masks(cells: DataFrame, tile: Column, wall: Column, world: Sequence[str] = ()) -> DataFrame:
    """Tile and wall 4-masks of each cell and the wall's variant (see wall_variant); both masks come from one shuffle."""
    masks = neighbor_masks(cells, {"tile_mask": tile, "wall_mask": wall}, world=world)
    return masks.withColumn("wall_variant", wall_variant(F.col("wall_mask"), F.col("x"), F.col("y")).cast("int"))


def _seen(cells: DataFrame, directions: Sequence[str], columns: Sequence[str], world: Sequence[str] = ()) -> DataFrame:
    """``cells`` with a struct of ``columns`` for each of the directions n, s, w, e, null where there is no cell: one shuffle."""
    seen = with_ring(cells, world).withColumns({f"at_{d}": F.max(F.struct(*columns)).over(beside(d, world)) for d in sorted(directions, key="nswe".index)})
    return seen.where("_core").drop("_cx", "_cy", "_core")


def connect8(cells: DataFrame, rules: DataFrame, attaches: Column, world: Sequence[str] = ()) -> DataFrame:
    """4-mask of the sides that connect and ``corners``, the diagonal bits whose two sides connect as well.

    ``cells (x, y, family, shape, hidden)``; ``rules (family, dir, shape, connects)`` says whether a cell of a family connects towards
    ``dir`` with a neighbour of a shape. Neighbours that don't attach, or whose visibility differs, never connect.
    """
    value = F.struct("family", "shape", "hidden", attaches.alias("attaches"))
    seen = neighbor_values(cells, value, list(DIRECTIONS), world)
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(bit).alias("bit"), F.col(d).alias("o")) for d, (_, _, bit) in DIRECTIONS.items()]))
    asked = seen.select(*world, "x", "y", F.col("own.family").alias("family"), F.col("own.hidden").alias("hidden"), sides.alias("s"))
    asked = asked.select(*world, "x", "y", "family", "s.dir", "s.bit", F.col("s.o.shape").alias("shape"), F.coalesce(F.col("s.o.attaches") & (F.col("s.o.hidden") == F.col("hidden")), F.lit(False)).alias("fits"))
    judged = asked.join(rules, ["family", "dir", "shape"], "left")
    bits = judged.groupBy(*world, "x", "y").agg(F.bit_or(F.when(F.col("fits") & F.col("connects"), F.col("bit")).otherwise(0)).alias("_b"))
    corner = lambda sides, bit: F.when(F.col("_b").bitwiseAND(sides) == sides, F.col("_b").bitwiseAND(bit)).otherwise(0)
    return bits.select(*world, "x", "y", F.col("_b").bitwiseAND(15).alias("mask"), (corner(3, 16) + corner(5, 32) + corner(10, 64) + corner(12, 128)).alias("corners"))


def liquid_atlas(left: Column, right: Column, top: Column, y: Column) -> tuple[Column, Column]:
    """Column and row of a flat liquid's source rectangle by its open sides."""
    sx = F.when(left & right, 16).when(left, 0).when(right, 32).otherwise(16)
    by_row = F.when(F.pmod(y, F.lit(2)) == 0, 32).otherwise(16)
    return sx, F.when(left & right, F.when(top, 16).otherwise(32)).when(top, 0).when(left | right, by_row).otherwise(48)


def at_surface(sx: Column, base: Column, y: Column, surface: float | None) -> Column:
    """Whether a flat liquid is the world's surface: middle column, open above, below 40 rows over ``surface``; none is where that isn't known."""
    return (sx == 16) & (base == 0) & (y > surface - 40) if surface is not None else F.lit(False)


def liquid_surface(cells: DataFrame, world: Sequence[str] = (), surface: float | None = None) -> DataFrame:
    """Wet cells: liquid, openings, the atlas' column and row (``sx``, ``base``), fill height and whether they are the world's surface (whose row is
    ``surface``, if known). ``cells (x, y, level, liquid, is_solid)``.

    A side is closed by a solid cell and by liquid of the same kind; dry cells, other liquids and the grid's edge leave it open.
    """
    seen = _seen(cells, ["w", "e", "n"], ["level", "liquid", "is_solid"], world).where("level > 0")
    closed = lambda d: F.col(f"at_{d}.is_solid") | ((F.col(f"at_{d}.level") > 0) & (F.col(f"at_{d}.liquid") == F.col("liquid")))
    opened = seen.withColumns({f"open_{name}": ~F.coalesce(closed(d), F.lit(False)) for name, d in (("left", "w"), ("right", "e"), ("top", "n"))})
    sx, base = liquid_atlas(F.col("open_left"), F.col("open_right"), F.col("open_top"), F.col("y"))
    shown = opened.withColumns({"sx": sx, "base": base}).withColumn("surface", at_surface(F.col("sx"), F.col("base"), F.col("y"), surface))
    return shown.select(*world, "x", "y", "liquid", "level", "open_left", "open_right", "open_top", "sx", "base", fill_height(F.col("level")).alias("height"), "surface")


def liquid_candidates(cells: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Class of each cell (dry, occluded, full rules, ordinary) and bits of wet neighbours: 1 above, 2 left, 4 right.

    ``cells (x, y, level, is_solid, half)``: half cells, and cells over one, need the full rules.
    """
    seen = _seen(cells, ["n", "s", "w", "e"], ["level", "half"], world)
    wet = {d: F.coalesce(F.col(f"at_{d}.level") > 0, F.lit(False)) for d in ("n", "w", "e")}
    kind = F.when((F.col("level") == 0) & ~(wet["n"] | wet["w"] | wet["e"]), "dry").when(F.col("is_solid") & ~F.col("half"), "occluded")
    kind = kind.when(F.col("half") | F.coalesce(F.col("at_s.half"), F.lit(False)), "full rules").otherwise("ordinary")
    bits = sum((wet[d].cast("int") * b for d, b in (("w", 2), ("e", 4))), wet["n"].cast("int"))
    return seen.select(*world, "x", "y", kind.alias("class"), bits.alias("bits"))


def detect_sources(cells: DataFrame, cap: int | None, world: Sequence[str] = ()) -> DataFrame:
    """Cells that liquids spring from: world, x, y, fall (the kind of fall), source and ``idx`` in column-major order of the cells that
    cause them, at most ``cap`` a world (the cap is the feature; None: all).

    ``halfbrick``: an active half cell under less than ``THIN`` of liquid or under a whole solid, with more than ``FEEDS`` on one
    side and an open side (dry, not a whole solid, no slope); its fall by the liquids above and beside, first of ``FALLS``.
    ``cloud``: the cell under an active cloud type, if open. ``cells (x, y, active, type, shape, level, liquid, is_solid)``, where
    is_solid is the material's. Cells without the neighbours that their rule needs are no sources.
    """
    marked = cells.withColumn("_whole", F.col("is_solid") & (F.col("shape") == 0))
    seen = _seen(marked, ["n", "s", "w", "e"], ["level", "liquid", "shape", "_whole"], world).where("active")
    open_ = lambda d: (F.col(f"at_{d}.level") == 0) & ~F.col(f"at_{d}._whole") & (F.col(f"at_{d}.shape") <= 1)
    capped = (F.col("at_n.level") < THIN) | F.col("at_n._whole")
    fed = (F.col("at_w.level") > FEEDS) | (F.col("at_e.level") > FEEDS)
    half = (F.col("shape") == 1) & capped & fed & (open_("w") | open_("e")) & F.col("at_w").isNotNull() & F.col("at_e").isNotNull()
    near = F.array("at_n.liquid", "at_w.liquid", "at_e.liquid")
    fall = F.coalesce(*[F.when(F.array_contains(near, liquid), kind) for liquid, kind in FALLS], F.lit(0))
    clouds = F.create_map(*[F.lit(v) for pair in CLOUDS.items() for v in pair])
    cloud = F.when(open_("s"), F.try_element_at(clouds, F.col("type")))
    spot = lambda when, fall, dy, name, k: F.when(when, F.struct(F.col("x").alias("by_x"), F.col("y").alias("by_y"), F.lit(k).alias("k"), (F.col("y") + dy).alias("to_y"), fall.alias("fall"), F.lit(name).alias("source")))
    both = F.array_compact(F.array(spot(F.coalesce(half, F.lit(False)), fall, 0, "halfbrick", 0), spot(cloud.isNotNull(), cloud, 1, "cloud", 1)))
    found = seen.select(*world, F.explode(both).alias("s")).select(*world, F.col("s.by_x").alias("x"), F.col("s.by_y").alias("y"), "s.k", "s.to_y", "s.fall", "s.source")
    kept = register_capped(found, cap, world, ["x", "y", "k"])[0]
    return kept.select(*world, "x", F.col("to_y").alias("y"), "fall", "source", "idx")


def attribute_ground(cells: DataFrame, zones: DataFrame, most: int, world: Sequence[str] = ()) -> DataFrame:
    """Ground under each cell: the first cell of another kind at most ``most`` rows below, its kind, the zone and the style (``none``
    without ground). ``zones``: see zone_join."""
    column = Window.partitionBy(*world, "x")
    change = F.when(F.lag("kind").over(column.orderBy("y")) != F.col("kind"), F.struct("y", "kind"))
    next_ = F.last("_change", ignorenulls=True).over(column.orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, -1))
    found = cells.withColumn("_change", change).withColumn("_g", next_).withColumn("_g", F.when(F.col("_g.y") - F.col("y") <= most, F.col("_g"))).drop("_change")
    zoned = zone_join(found, zones, world)
    style = F.when(F.col("_g").isNull(), "none").otherwise(F.concat_ws("-", F.col("_g.kind"), F.col("style")))
    return zoned.select(*world, "x", "y", F.col("_g.y").alias("ground_y"), F.col("_g.kind").alias("ground"), "zone", style.alias("style"))
