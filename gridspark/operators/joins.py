"""Joins: type facts, neighbours, halos, intervals, overlapping rectangles, as-of and range look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Side of the smallest buckets of the rectangle join, and how many times as wide those of the next level are.
BUCKET, SPREAD = 64, 8

#: Commands of one rectangle that a list holds at most: a multiple of eight, so that a list takes whole bytes of a file, however many bits a value has.
COPIES = 128

#: More tasks than any join has.
APART = 1 << 20

#: Direction: (dx, dy, bit). The first four make the 4-mask.
DIRECTIONS = {"n": (0, -1, 1), "w": (-1, 0, 2), "e": (1, 0, 4), "s": (0, 1, 8), "nw": (-1, -1, 16), "ne": (1, -1, 32), "sw": (-1, 1, 64), "se": (1, 1, 128)}


def classify_material(cells: DataFrame, dim: DataFrame, active: Column | None = None, actuated: Column | None = None) -> DataFrame:
    """Adds ``is_solid``: false where not active or actuated, else the kind's fact; null where that is unknown."""
    off = F.lit(False)
    for part in ([~active] if active is not None else []) + ([actuated] if actuated is not None else []):
        off = off | part
    facts = dim.select("kind", F.col("solid").alias("_solid"))
    return cells.join(facts, "kind", "left").withColumn("is_solid", F.when(off, F.lit(False)).otherwise(F.col("_solid"))).drop("_solid")


#: Families by falling precedence, each with its bit.
FAMILIES = [("special", 1), ("plant", 2), ("furniture", 4), ("misc", 8), ("tree", 16), ("nature", 32), ("object", 64), ("block", 128)]


def dispatch_family(cells: DataFrame, dim: DataFrame, stored_frame: Column, rope: Column, ordinary: Column) -> DataFrame:
    """Adds ``family``: the first family whose bit is set in the kind's mask, else stored, rope, ordinary or unsupported."""
    joined = cells.join(dim.select("kind", "family_mask"), "kind", "left")
    mask = F.coalesce(F.col("family_mask"), F.lit(0))
    family = F.when(mask.bitwiseAND(FAMILIES[0][1]) != 0, FAMILIES[0][0])
    for name, bit in FAMILIES[1:]:
        family = family.when(mask.bitwiseAND(bit) != 0, name)
    family = family.when(stored_frame, "stored").when(rope, "rope").when(ordinary, "ordinary").otherwise("unsupported")
    return joined.withColumn("family", family).drop("family_mask")


#: Side of the chunks that neighbourhoods are made in.
CHUNK = 256


def with_ring(cells: DataFrame, world: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """``cells`` by chunk (_cx, _cy), each with the ring of cells around it (``_core`` false): one shuffle of little more than the grid.
    Windows and groups whose keys hold the chunk's then need none."""
    return halo_exchange(cells, chunk, 1, world=world, names=("_cx", "_cy", "_core")).repartition(*world, "_cx", "_cy")


def beside(direction: str, world: Sequence[str] = ()) -> WindowSpec:
    """The window over the cell next to each one, in the chunks of with_ring: a range, so that holes and repeated cells do no harm."""
    dx, dy, _ = DIRECTIONS[direction]
    along, across, step = ("y", "x", dy) if dx == 0 else ("x", "y", dx)
    return Window.partitionBy(*world, "_cx", "_cy", across).orderBy(along).rangeBetween(step, step)


def _words(cells: DataFrame, predicates: Mapping[str, Column], world: Sequence[str]) -> DataFrame:
    """One row for 64 cells of a column: keys, x, _yb, the bits of the cells that are there, and for each predicate and direction those of
    the cells whose neighbour meets it.

    Cells become bits before anything is shuffled, so the exchanges hold a 64th of the grid; holes are zeros, repeated cells one bit.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("y").bitwiseAND(63).cast("int"))
    names = {name: f"_p{k}" for k, name in enumerate(predicates)}
    flags = [F.bit_or(F.when(p, bit).otherwise(F.lit(0).cast("long"))).alias(names[name]) for name, p in predicates.items()]
    keys = [*world, "x", "_yb"]
    words = cells.withColumn("_yb", F.shiftright("y", 6)).groupBy(*keys).agg(F.bit_or(bit).alias("_here"), *flags)
    far = [("own", 0, 0), ("n", 0, 1), ("s", 0, -1), ("w", 1, 0), ("e", -1, 0)]  # to the word that sees this one in that direction
    sent = words.withColumn("_to", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, dx, dy in far])))
    sent = sent.withColumns({"x": F.col("x") + F.col("_to.dx"), "_yb": F.col("_yb") + F.col("_to.dy")})
    of = lambda d, c: F.coalesce(F.max(F.when(F.col("_to.d") == d, F.col(c))), F.lit(0).cast("long")).alias(f"{c}_{d}")
    seen = sent.groupBy(*keys).agg(of("own", "_here"), *[of(d, c) for c in names.values() for d, _, _ in far]).where("_here_own <> 0")
    sides = {}
    for c in names.values():
        sides[f"{c}_n"] = F.shiftleft(f"{c}_own", 1).bitwiseOR(F.shiftrightunsigned(f"{c}_n", 63))
        sides[f"{c}_s"] = F.shiftrightunsigned(f"{c}_own", 1).bitwiseOR(F.shiftleft(f"{c}_s", 63))
    return seen.withColumns(sides)


def _mask_bits(name: str, bit: Column) -> Column:
    """The 4-mask of the cell at a bit of a word."""
    on = lambda d: F.call_function("shiftright", F.col(f"{name}_{d}"), bit).bitwiseAND(1).cast("int")
    return sum((on(d) * DIRECTIONS[d][2] for d in "wes"), on("n"))


def with_masks(cells: DataFrame, predicates: Mapping[str, Column], world: Sequence[str] = ()) -> DataFrame:
    """``cells`` with a column for each predicate: the bits of the neighbours that meet it (N=1, W=2, E=4, S=8). No neighbour: no bit.

    A cell that occurs more than once counts once as a neighbour, and each of its rows gets the mask.
    """
    keys = [*world, "x", "_yb"]
    words = _words(cells, predicates, world).select(*keys, *[f"_p{k}_{d}" for k in range(len(predicates)) for d in "nwes"])
    joined = cells.withColumn("_yb", F.shiftright("y", 6)).join(words.hint("shuffle_hash"), keys)  # each word stands for 64 cells: the small side
    bit = F.col("y").bitwiseAND(63).cast("int")
    return joined.select(*cells.columns, *[_mask_bits(f"_p{k}", bit).alias(name) for k, name in enumerate(predicates)])


def neighbor_masks(cells: DataFrame, predicates: Mapping[str, Column], world: Sequence[str] = ()) -> DataFrame:
    """The masks of with_masks, one row for each distinct cell: world, x, y, one column for each predicate. The cells themselves don't move."""
    words = _words(cells, predicates, world).withColumn("_bit", F.explode(F.array(*map(F.lit, range(64)))))
    here = words.where(F.call_function("shiftright", F.col("_here_own"), F.col("_bit")).bitwiseAND(1) == 1)
    y = (F.shiftleft("_yb", 6) + F.col("_bit")).cast(cells.schema["y"].dataType)
    return here.select(*world, F.col("x").cast(cells.schema["x"].dataType).alias("x"), y.alias("y"), *[_mask_bits(f"_p{k}", F.col("_bit")).alias(name) for k, name in enumerate(predicates)])


def neighbors4(cells: DataFrame, predicate: Column, world: Sequence[str] = ()) -> DataFrame:
    """``mask`` with N=1, W=2, E=4, S=8."""
    return neighbor_masks(cells, {"mask": predicate}, world=world)


def neighbor_values(cells: DataFrame, value: Column, directions: Sequence[str], world: Sequence[str] = ()) -> DataFrame:
    """One row for each cell: keys, x, y, ``own`` (the value there) and the value of the neighbour in each direction, null where there is
    none; of repeated cells the largest. Sent to the neighbours inside the chunks of with_ring, so without a further shuffle."""
    far = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for d, (dx, dy, _) in [("own", (0, 0, 0)), *((d, DIRECTIONS[d]) for d in directions)]]))
    ring = with_ring(cells.select(*world, "x", "y", value.alias("_v")), world)
    sent = ring.select(*world, "_cx", "_cy", "x", "y", "_v", "_core", far.alias("_far"))
    own = F.col("_far.d") == "own"
    sent = sent.select(*world, "_cx", "_cy", (F.col("x") + F.col("_far.dx")).alias("x"), (F.col("y") + F.col("_far.dy")).alias("y"), "_v", F.col("_far.d").alias("_d"), (own & F.col("_core")).alias("_own"))
    seen = sent.groupBy(*world, "_cx", "_cy", "x", "y").agg(F.bool_or("_own").alias("_here"), *[F.max(F.when(F.col("_d") == d, F.col("_v"))).alias(d) for d in ("own", *directions)])
    return seen.where("_here").select(*world, "x", "y", "own", *directions)


def neighbors8(cells: DataFrame, value: str, world: Sequence[str] = ()) -> DataFrame:
    """The value of each of the eight neighbours, in columns n, w, e, s, nw, ne, sw, se; null where there is none."""
    return neighbor_values(cells, F.col(value), list(DIRECTIONS), world).drop("own")


def halo_exchange(cells: DataFrame, chunk: int, pad: int, most_x: int | None = None, most_y: int | None = None, world: Sequence[str] = (), names: tuple[str, str, str] = ("cx", "cy", "is_core")) -> DataFrame:
    """Each chunk's cells and the ring of width ``pad`` around it: cx, cy and ``is_core``. Chunks beyond the bounds aren't made."""

    def targets(c: str, most: int | None) -> Column:
        low, high = F.floor((F.col(c) - pad) / F.lit(chunk)), F.floor((F.col(c) + pad) / F.lit(chunk))
        low = F.greatest(low, F.lit(0)) if most is not None else low
        high = F.least(high, F.lit((most - 1) // chunk)) if most is not None else high
        return F.sequence(low, high)

    across, down, is_core = names
    sent = cells.withColumn(across, F.explode(targets("x", most_x))).withColumn(down, F.explode(targets("y", most_y)))
    core = (F.floor(F.col("x") / F.lit(chunk)) == F.col(across)) & (F.floor(F.col("y") / F.lit(chunk)) == F.col(down))
    return sent.withColumn(is_core, core)


def runs_join(a: DataFrame, b: DataFrame, value: str = "kind", stride: int = 16, world: Sequence[str] = ()) -> DataFrame:
    """Pairs of runs of two lists that share cells: keys, x, y0, run_len (of the shared part), a_value, b_value.

    Runs meet in the bands that they touch; a pair counts in the band of the later start only.
    """
    from .runs import with_bands

    left = with_bands(a, stride).select(*world, "x", "band", F.col("y0").alias("_a0"), (F.col("y0") + F.col("run_len")).alias("_a1"), F.col(value).alias(f"a_{value}"))
    right = with_bands(b, stride).select(*world, "x", "band", F.col("y0").alias("_b0"), (F.col("y0") + F.col("run_len")).alias("_b1"), F.col(value).alias(f"b_{value}"))
    start, end = F.greatest("_a0", "_b0"), F.least("_a1", "_b1")
    pairs = left.join(right, [*world, "x", "band"]).where((start < end) & (F.col("band") == F.floor(start / F.lit(stride))))
    return pairs.select(*world, "x", start.alias("y0"), (end - start).cast("int").alias("run_len"), f"a_{value}", f"b_{value}")


def rect_overlap(commands: DataFrame, rects: DataFrame, bucket: int = BUCKET, world: Sequence[str] = (), sizes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Commands (dx, dy, dw, dh, ...) that meet each rectangle (rect_id, rx, ry, rw, rh), with local_x and local_y. Empty ones meet nothing.

    Buckets have levels: those of the next are ``SPREAD`` times as wide. A rectangle lies on the first level where it is no longer than SPREAD buckets,
    so it touches (SPREAD + 1) squared at most, however large it is. Pairs meet on the larger one's level, where the smaller touches fewer: each side is also
    sent to the higher levels that the other side has. A pair counts in the bucket of its overlap's top left corner, so no distinct is needed.
    Coordinates may be below zero. Both sides are shuffled: their sizes after the spread aren't known beforehand. ``sizes`` has the commands' sizes where they
    are found with less work than in ``commands``. With ``parts`` there are so many tasks, which go through commands one by one and aren't put together by the size of what they read.
    """

    def sized(df: DataFrame, w: str, h: str) -> DataFrame:
        longest = F.greatest(F.col(w), F.col(h)).cast("double")
        return df.where((F.col(w) > 0) & (F.col(h) > 0)).withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log(longest / (bucket * SPREAD)) / F.log(F.lit(float(SPREAD))) - 1e-9)).cast("int"))

    left, right = sized(commands, "dw", "dh"), sized(rects, "rw", "rh")
    levels = lambda df: sorted(r._own for r in df.select("_own").distinct().collect())  # noqa: E731  # a few numbers: logarithms of sizes
    have = levels(left if sizes is None else sized(sizes, "dw", "dh")), levels(right)

    def spread(df: DataFrame, x: str, y: str, w: str, h: str, others: list[int]) -> DataFrame:
        """A row for each bucket of the own level, and of the higher ones that the other side has."""
        higher = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_own"))
        placed = df.withColumn("_level", F.explode(F.array_union(F.array("_own"), higher))).withColumn("_side", F.pow(F.lit(float(SPREAD)), F.col("_level")).cast("long") * bucket)
        cells = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / F.col("_side")), F.floor((F.col(at) + F.col(size) - 1) / F.col("_side"))))
        return placed.withColumn("_bx", cells(x, w)).withColumn("_by", cells(y, h))

    keys = [*world, "_level", "_bx", "_by"]
    a = spread(left, "dx", "dy", "dw", "dh", have[1]).withColumnRenamed("_own", "_a")
    b = spread(right, "rx", "ry", "rw", "rh", have[0]).withColumnRenamed("_own", "_b").drop("_side")
    if parts is None:
        a = a.hint("shuffle_hash")
    else:
        a, b = a.repartition(parts, *keys), b.repartition(parts, *keys)
    pairs = a.join(b.hint("shuffle_hash"), keys).where(F.col("_level") == F.greatest("_a", "_b"))
    x0, y0 = F.greatest("dx", "rx"), F.greatest("dy", "ry")
    meets = (x0 < F.least(F.col("dx") + F.col("dw"), F.col("rx") + F.col("rw"))) & (y0 < F.least(F.col("dy") + F.col("dh"), F.col("ry") + F.col("rh")))
    once = (F.floor(x0 / F.col("_side")) == F.col("_bx")) & (F.floor(y0 / F.col("_side")) == F.col("_by"))
    return pairs.where(meets & once).withColumns({"local_x": F.col("dx") - F.col("rx"), "local_y": F.col("dy") - F.col("ry")}).drop("_bx", "_by", "_level", "_side", "_a", "_b")


def copies_overlap(commands: DataFrame, rects: DataFrame, bucket: int = BUCKET, world: Sequence[str] = (), copies: int = COPIES) -> DataFrame:
    """rect_overlap for commands many of which have one rectangle, with the same rows.

    Those are kept in lists of ``copies`` at most, which meet a rectangle once and are taken apart behind the join. So less is tested and shuffled, and rows of the
    result follow each other in repeats: in files with dictionaries and run lengths a pair takes a small part of what it takes in another order.
    As pairs may be many more than what is read, there are as many tasks as shuffle partitions, and the join ends before its lists are taken apart: in one loop with
    it, all rows of a list and the rectangles that it meets would be copied and held before the first is handed on. Lists are cut from sorted ranges, so that no task or list holds all commands of a rectangle; the commands' columns must be such as can be sorted.
    """
    place = [*world, "dx", "dy", "dw", "dh"]
    own = [c for c in commands.columns if c not in place]
    if not own:  # nothing to keep in a list
        return rect_overlap(commands, rects, bucket, world)
    ranges = commands.where("dw > 0 AND dh > 0").repartitionByRange(*place, *own).sortWithinPartitions(*place, *own)
    lists = ranges.withColumn("_part", F.floor(F.monotonically_increasing_id() / (16 * copies))).groupBy(*place, "_part").agg(F.collect_list(F.struct(*own)).alias("_own_of"))
    last = F.floor((F.size("_own_of") - 1) / copies).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("_own_of", k * copies + 1, F.lit(copies)))
    parts = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = lists.select(*place, F.explode(cut).alias("_own_of"))
    if len(own) == 1:  # plain values are taken out with less work than structs, which were needed to keep nulls
        pieces = pieces.withColumn("_own_of", F.col("_own_of").getField(own[0]))
    met = rect_overlap(pieces, rects, bucket, world, sizes=commands, parts=parts).coalesce(APART)  # moves nothing and leaves all tasks: ends the join's loop
    kept = [c for c in met.columns if c not in (*place, "_own_of")]
    one = F.col("_one")
    return met.withColumn("_one", F.explode("_own_of")).select(*place, *[(one if len(own) == 1 else one.getField(c)).alias(c) for c in own], *kept)


def has_origin(cells: DataFrame, origins: DataFrame, complete: bool = True, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``has_origin``: whether the cell is an origin; where none is found and the scan was incomplete, null."""
    found = origins.select(*world, "x", "y").distinct().withColumn("_hit", F.lit(True))
    absent = F.lit(False) if complete else F.lit(None).cast("boolean")
    return cells.join(found, [*world, "x", "y"], "left").withColumn("has_origin", F.coalesce(F.col("_hit"), absent)).drop("_hit")


def missing_assets(commands: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that commands need and ``assets (asset)`` lacks: asset, commands."""
    return commands.groupBy("asset").agg(F.count("*").alias("commands")).join(assets.select("asset"), "asset", "left_anti")


def invalid_crops(commands: DataFrame, assets: DataFrame) -> DataFrame:
    """Commands whose source rectangle (sx, sy, sw, sh) isn't inside their asset (asset, width, height). Missing assets are no crop error."""
    inside = (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sw") > 0) & (F.col("sh") > 0) & (F.col("sx") + F.col("sw") <= F.col("width")) & (F.col("sy") + F.col("sh") <= F.col("height"))
    return commands.join(assets.select("asset", "width", "height"), "asset").where(~inside)


def overlay(base: DataFrame, patch: DataFrame, dx: int, dy: int, columns: Sequence[str], world: Sequence[str] = ()) -> DataFrame:
    """``base`` with the cells of ``patch`` moved by (dx, dy) in place of its own; patch cells outside the base are left out."""
    own = patch.select(*world, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.struct(*columns).alias("_patch"))
    both = base.select(*world, "x", "y", F.struct(*columns).alias("_base")).join(own, [*world, "x", "y"], "left")
    return both.select(*world, "x", "y", F.coalesce("_patch", "_base").alias("_cell")).select(*world, "x", "y", *[F.col(f"_cell.{c}").alias(c) for c in columns])


def diff_cells(a: DataFrame, b: DataFrame, columns: Sequence[str], world: Sequence[str] = ()) -> DataFrame:
    """Cells that differ: keys, in_a, in_b and ``differs``, the names of the columns that are not equal (nulls are equal)."""
    keys = [*world, "x", "y"]
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    names = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    both = left.join(right, keys, "full_outer").select(*keys, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"), names.alias("differs"))
    return both.where((F.size("differs") > 0) | ~F.col("in_a") | ~F.col("in_b"))


def resolve_anchor(cells: DataFrame, offset_x: Column, offset_y: Column, columns: Sequence[str] = ("kind",), world: Sequence[str] = ()) -> DataFrame:
    """Anchor of each part of a multi-cell object: the cell at (x - offset_x, y - offset_y). Adds anchor_x, anchor_y and ``reason``:
    null, no anchor, or other object where the anchor differs in ``columns``."""
    parts = cells.withColumns({"anchor_x": F.col("x") - offset_x, "anchor_y": F.col("y") - offset_y})
    anchors = cells.select(*world, F.col("x").alias("anchor_x"), F.col("y").alias("anchor_y"), F.struct(*columns).alias("_anchor"))
    joined = parts.join(anchors, [*world, "anchor_x", "anchor_y"], "left")
    reason = F.when(F.col("_anchor").isNull(), "no anchor").when(~F.col("_anchor").eqNullSafe(F.struct(*columns)), "other object")
    return joined.withColumn("reason", reason).drop("_anchor")


def nearest_below(cells: DataFrame, predicate: Column, most: int | None = None, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``below_y``: the first y at or under each cell, within ``most`` rows (this one included), that meets the predicate."""
    order = Window.partitionBy(*world, "x").orderBy("y").rangeBetween(0, Window.unboundedFollowing if most is None else most - 1)
    return cells.withColumn("below_y", F.min(F.when(predicate, F.col("y"))).over(order))


def bracketed(cells: DataFrame, match: Column, gap: Column, up: int = 5, span: int = 6, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``bracketed``: a match d rows above (1 to ``up``), another at most ``span - d`` rows below, and no gap between them."""
    column = Window.partitionBy(*world, "x").orderBy("y")
    above, below = column.rangeBetween(-up, -1), column.rangeBetween(1, span - 1)
    a, b = F.max(F.when(match, F.col("y"))).over(above), F.min(F.when(match, F.col("y"))).over(below)
    ga, gb = F.max(F.when(gap, F.col("y"))).over(above), F.min(F.when(gap, F.col("y"))).over(below)
    ok = a.isNotNull() & b.isNotNull() & (b - a <= span) & (ga.isNull() | (ga < a)) & (gb.isNull() | (gb > b)) & ~gap
    return cells.withColumn("bracketed", F.coalesce(ok, F.lit(False)))


def zone_join(points: DataFrame, zones: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``zone`` (0 to 3) and ``style``: ``zones (world..., cuts array, styles array)`` has one small row a world."""
    zone = F.aggregate("cuts", F.lit(0), lambda n, cut: n + F.when(F.col("x") >= cut, 1).otherwise(0))
    one = {c: zones.select(c).scalar() for c in ("cuts", "styles")} if not world else {}
    joined = points.join(zones, list(world)) if world else points.withColumns(one)
    return joined.withColumn("zone", zone).withColumn("style", F.element_at("styles", F.col("zone") + 1)).drop("cuts", "styles")


def frame_lookup(masks: DataFrame, frames: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds the source rectangle of each mask from ``frames (mask, sx, sy)``; null where there is none."""
    return masks.join(frames.withColumnRenamed("mask", mask), mask, "left")


def neighbor_priority(cells: DataFrame, value: str, order: Sequence[str], connects: Column, none=None, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``chosen``: the value of the first neighbour in ``order`` that is there and isn't ``none``; null where the cell doesn't connect."""
    seen = neighbors8(cells, value, world)
    picks = [F.nullif(F.col(d), F.lit(none)) if none is not None else F.col(d) for d in order]
    own = cells.select(*world, "x", "y", connects.alias("_connects"))
    return own.join(seen, [*world, "x", "y"]).select(*world, "x", "y", F.when(F.col("_connects"), F.coalesce(*picks)).alias("chosen"))
