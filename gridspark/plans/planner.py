"""The layered planner: every cell emits its wall, its liquid and its tile, each as a command, as hidden, or as an omission with its reason.

Facts of types come from one broadcast table. What a cell's neighbours must know of it is one packed number; numbers travel once, with
the chunks' rings, and are read by two window sorts inside the chunks: up and down first, then the column of three sideways. A cell's entries
are an array, exploded once, so commands, omissions and counters come from the same pass and one shuffle of the cells.

Blocks and thorns that join their like, glowing ones with an overlay, and objects of saved frames are drawn by family. Other families with sprites of their own, and liquids beside shapes that need surface geometry, aren't drawn: they are omitted by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalars import asset_name, fill_height, wall_variant
from gridspark.operators.joins import FAMILIES, with_ring
from gridspark.operators.order import draw_order
from gridspark.operators.project import visible_block, visible_wall
from gridspark.operators.terrain import at_surface, liquid_atlas
from gridspark.sources import facts

#: Particle emitters have no body; types that liquids need more context for; textures of water, lava and honey.
EMITTERS = (373, 374, 375, 461, 709)
LIQUID_CONTEXT = (379, 518, 546)
TEXTURES = {1: 0, 2: 1, 3: 11}
SHIMMER = 4
#: Liquid reasons of a neighbouring cell, numbered from 1.
NEAR_REASONS = ("invalid-shape-neighborhood", "special-tile-neighborhood", "unknown-solid-neighborhood")
#: Rows of stored frames with a higher sprite: type, modulus of frame_y (0: none), its value there.
TALL_ROWS = ((14, 0, 18), (21, 0, 18), (15, 40, 18), (27, 74, 54), (172, 38, 18))
DRAWABLE_ROPE, TORCH, BENCH = 353, 4, 18
#: Crystals and gems that hang, long moss, and two piles whose frames wrap: at so many pixels, so far down (small piles in their second row alone).
STALACTITE, GEM, MOSS, SMALL_PILE, LARGE_PILE = 165, 178, 184, 185, 187
WRAPS = {BENCH: (2016, 20), SMALL_PILE: (1908, 18), LARGE_PILE: (1890, 36)}
#: Reasons of entries that are no faults, and those of what isn't drawn here.
INVISIBLE, EMITTER = "invisible", "particle-emitter-without-tile-body"
INSIDE = "inside-solid"
UNKNOWN_TYPE, SHAPED_OBJECT, LIQUID_SHAPE = "unimplemented-type", "shaped-static-object", "liquid-shape-geometry"
FRAMED_BLOCK, SHAPED_THORN, UNFRAMED_OBJECT, UNKNOWN_SIDE = "framed-static-block", "shaped-thorn", "object-without-frame", "unknown-attachment"

#: Fields of a cell and what an absent one, or a null, stands for.
DEFAULTS = {
    "active": False, "type": 0, "shape": 0, "level": 0, "liquid": 0, "wall": 0, "paint": 0, "wall_paint": 0, "inactive": False, "invisible_block": False, "invisible_wall": False,
}
#: The packed number: name, first bit, bits.
PACKED = {
    "type": (0, 11), "wall": (11, 1), "level": (12, 8), "liquid": (20, 3), "solid": (23, 1), "shaped": (24, 1), "near": (25, 2), "rope": (27, 1), "side_rope": (28, 1), "side_block": (29, 1), "ceiling": (30, 1), "here": (31, 1),
}
NEIGHBOURS = ("n", "s", "w", "e", "nw", "ne", "sw", "se")

ENTRY = (
    "struct<entry: string, kind: string, type: int, phase: string, asset: string, sx: int, sy: int, sw: int, sh: int, dx: bigint, dy: bigint, dw: int, dh: int, shape: int, paint: int, fidelity: string, flip: boolean, tint: array<int>, reason: string>"
)


def _bits(name: str, at: str) -> Column:
    """A part of the packed number of a neighbour; 0 where there is no cell."""
    first, width = PACKED[name]
    return F.expr(f"coalesce(cast(shiftrightunsigned({at}, {first}) & {(1 << width) - 1} AS int), 0)")


def _flag(name: str, at: str) -> Column:
    first, width = PACKED[name]
    return F.expr(f"coalesce(shiftrightunsigned({at}, {first}) & {(1 << width) - 1} = 1, false)")


def with_neighbours(cells: DataFrame, own: Column, world: Sequence[str]) -> DataFrame:
    """``cells`` with ``own`` (a long) as ``_o`` and that of the eight neighbours as ``_n``, ``_s``, ..., null where there is none. Cells are distinct by
    (world, x, y)."""
    ring = with_ring(cells.withColumn("_o", own), world)
    up_down = Window.partitionBy(*world, "_cx", "_cy", "x").orderBy("y")
    across = Window.partitionBy(*world, "_cx", "_cy", "y").orderBy("x")
    beside = lambda f, along, step, value: F.when(f(along).over(_of[along]) == F.col(along) + step, f(value).over(_of[along]))
    _of = {"y": up_down, "x": across}
    tall = ring.withColumns({"_n": beside(F.lag, "y", -1, "_o"), "_s": beside(F.lead, "y", 1, "_o")}).withColumn("_three", F.struct(F.col("_n").alias("n"), F.col("_o").alias("o"), F.col("_s").alias("s")))
    wide = tall.withColumns({"_west": beside(F.lag, "x", -1, "_three"), "_east": beside(F.lead, "x", 1, "_three")})
    sides = {"_w": "_west.o", "_e": "_east.o", "_nw": "_west.n", "_ne": "_east.n", "_sw": "_west.s", "_se": "_east.s"}
    return wide.where("_core").withColumns({k: F.col(v) for k, v in sides.items()}).drop("_cx", "_cy", "_core", "_three", "_west", "_east")


def _entry(kind: str, type_: Column, form: Column, reason: Column, quiet: Sequence[str], **fields: Column | str | int) -> Column:
    """The entry of one kind: a command where it has a form, else hidden (for a quiet reason) or omitted."""
    drawn = form.isNotNull()
    entry = F.when(drawn, "command").when(reason.isin(*quiet), "hidden").otherwise("omitted")
    given = {"entry": entry, "kind": F.lit(kind), "type": type_, "reason": reason} | {k: F.when(drawn, v if isinstance(v, Column) else F.lit(v)) for k, v in fields.items()}
    parts = [part.split(": ") for part in ENTRY[len("struct<") : -1].split(", ")]
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts])


def _mask(test: Mapping[str, Column]) -> Column:
    return sum((F.when(test[d], bit).otherwise(0) for d, bit in (("w", 2), ("e", 4), ("s", 8))), F.when(test["n"], 1).otherwise(0))


def _frame(mask: str, frames: Sequence[tuple[int, int]], k: int, scale: int = 1) -> Column:
    return F.expr(f"element_at(array({', '.join(str(f[k] * scale) for f in frames)}), cast({mask} + 1 AS int))")


def _with_walls(cells: DataFrame, reveal: bool) -> DataFrame:
    """Adds ``_wall``: the entry of a wall, by the 4-mask of the walls around it."""
    mask = cells.withColumn("_wm", _mask({d: _flag("wall", f"_{d}") for d in "nwes"})).withColumn("_wm", wall_variant(F.col("_wm"), F.col("x"), F.col("y")))
    shown = visible_wall(F.col("wall"), F.col("invisible_wall"), reveal)
    entry = _entry(
        "wall", F.col("wall"), F.when(shown, "approximate"), F.when(~shown, INVISIBLE), (INVISIBLE,), phase="wall", asset=asset_name(F.lit("Wall"), F.col("wall")), sx=_frame("_wm", facts.WALL_FRAMES, 0, 36), sy=_frame("_wm", facts.WALL_FRAMES, 1, 36),
        sw=32, sh=32, dx=F.col("x") * 16 - 8, dy=F.col("y") * 16 - 8, dw=32, dh=32, shape=0, paint=F.col("wall_paint"), fidelity="approximate",
    )
    return mask.withColumn("_wall", F.when(F.col("wall") > 0, entry)).drop("_wm")


def _with_liquids(cells: DataFrame, water_style: int, surface: float | None) -> DataFrame:
    """Adds ``_pool``: the entry of a cell's liquid, or of a dry solid shape's beside wet cells: refused by the first reason around it, full beside
    shapes, or flat."""
    level, shape, kind = F.col("level"), F.col("shape"), F.col("_k")
    wet_near = F.coalesce(*[F.when(_bits("level", f"_{d}") > 0, _bits("liquid", f"_{d}")) for d in "nwes"])
    dry_shape = (level == 0) & (shape != 0) & F.col("_solid")
    known = cells.withColumn("_k", F.when(level > 0, F.col("liquid")).when(dry_shape, wet_near))
    around = [f"_{d}" for d in ("nw", "w", "sw", "n", "o", "s", "ne", "e", "se")]
    others = [at for at in around if at != "_o"]
    like = lambda at: F.shiftrightunsigned(F.col(at), PACKED["level"][0]).bitwiseAND(0x7FF) == (F.shiftleft(kind, 8) + 255)
    wet = lambda at: _bits("level", at) > 0
    # the first reason around a cell, by its own number, or 4 for another liquid
    near = F.coalesce(*[F.nullif(F.greatest(_bits("near", at), F.when((_bits("near", at) == 0) & wet(at) & (_bits("liquid", at) != kind), 4).otherwise(0)), F.lit(0)) for at in around])
    any_ = lambda tests: F.exists(F.array(*tests), lambda t: t)
    no = lambda c: F.coalesce(c, F.lit(False))
    wetted = kind.isNotNull()
    known = known.withColumns({
        "_near": F.when(wetted, near), "_missing": wetted & any_([F.col(at).isNull() for at in others]), "_shaped": wetted & any_([_flag("shaped", at) for at in around]),
        "_stable": wetted & ~any_([~(_flag("solid", at) | no(like(at))) for at in others]), **{f"_open_{d}": ~(_flag("solid", f"_{d}") | (wet(f"_{d}") & (_bits("liquid", f"_{d}") == kind))) for d in "nwe"},
    })
    above_full = _bits("level", "_n") == 255
    known = known.withColumn("_full", F.col("_shaped") & ~F.col("_missing") & F.col("_stable") & ((level == 255) | ((level == 0) & (shape == 1) & above_full)))
    sx, base = liquid_atlas(F.col("_open_w"), F.col("_open_e"), F.col("_open_n"), F.col("y"))
    own_shape = F.col("active") & ~F.col("inactive") & (shape != 0)
    upper = own_shape & (shape == 1) & F.col("_full") & (F.col("wall") > 0) & above_full
    reasons = F.element_at(F.array(*[F.lit(r) for r in (*NEAR_REASONS, "mixed-liquid-neighborhood")]), F.col("_near"))
    why = (
        F.when((level > 255) | (level < 0), "invalid-liquid-level").when(kind == SHIMMER, "shimmer").when(~kind.isin(*TEXTURES), "unknown-liquid-kind").when(F.col("_near").isNotNull(), reasons)
        .when(own_shape & ~F.col("_solid"), F.when(F.col("_missing"), "shape-non-solid").otherwise(LIQUID_SHAPE)).when(own_shape & F.col("_missing"), "shape-missing-context").when(upper, None).when(own_shape, LIQUID_SHAPE)
        .when(F.col("_solid"), INSIDE).when(F.col("_shaped") & F.col("_full"), None).when(F.col("_shaped") & F.col("_missing"), "shape-missing-context").when(F.col("_shaped"), LIQUID_SHAPE)
    )
    known = known.withColumns({"_lx": sx, "_ly": base, "_h": fill_height(level), "_why": why})
    form = F.when(wetted & F.col("_why").isNull(), F.when(F.col("_full") & own_shape, "static-wet-halfbrick-top").when(F.col("_full"), "static-full-liquid-near-shape").otherwise("flat-fill-approximation"))
    known = known.withColumn("_form", form)
    by = lambda flat, whole, top: F.when(~F.col("_full"), flat).when(~own_shape, whole).otherwise(top)
    inset = F.lit(16) - F.col("_h")
    texture = F.coalesce(*[F.when(kind == k, F.lit(water_style if k == 1 else t)) for k, t in TEXTURES.items()])
    top_row = F.when(at_surface(F.col("_lx"), F.col("_ly"), F.col("y"), surface), 1280).otherwise(F.col("_ly") + inset)
    entry = _entry(
        "liquid", kind, F.col("_form"), F.col("_why"), (INSIDE,), phase="foreground liquid", asset=F.format_string("water_%d.png", texture), sx=by(F.col("_lx"), 16, 16), sy=by(top_row, 48, 56), sw=16, sh=by(F.col("_h"), 16, 8),
        dx=F.col("x") * 16, dy=F.col("y") * 16 + by(inset, 0, 0), dw=16, dh=by(F.col("_h"), 16, 8), shape=0, paint=0, fidelity=F.col("_form"),
    )
    return known.withColumn("_pool", F.when(wetted, entry)).drop("_k", "_near", "_missing", "_shaped", "_stable", "_full", "_open_n", "_open_w", "_open_e", "_lx", "_ly", "_h", "_why", "_form")


def _with_tiles(cells: DataFrame, reveal: bool) -> DataFrame:
    """Adds ``_tile``: the entry of an active cell: a block by the 4-mask of its like, an object or another stored frame, a rope, or why it is none; and
    ``_glow``: the overlay of a block that glows, which is drawn right after it."""
    type_, shape, mask = F.col("type"), F.col("shape"), F.coalesce(F.col("family_mask"), F.lit(0))
    framed = F.coalesce((F.col("frame_x") >= 0) & (F.col("frame_y") >= 0), F.lit(False))
    in_family = lambda *names: mask.bitwiseAND(sum(bit for name, bit in FAMILIES if name in names)) != 0
    first = F.coalesce(*[F.when(mask.bitwiseAND(bit) != 0, f"family-{name}") for name, bit in FAMILIES])
    block = (mask == 0) & F.col("ordinary") & ~framed
    of = lambda name: F.coalesce(first == f"family-{name}", F.lit(False))
    joining, object_, thorn = of("block"), of("object"), type_.isin(*facts.THORN_GROUND)
    why = (
        F.when(~visible_block(F.col("active"), F.col("invisible_block"), reveal), INVISIBLE).when(~shape.between(0, 5), UNKNOWN_TYPE).when(block, None).when(type_.isin(*EMITTERS), EMITTER)
        .when(in_family("object") & ~in_family("special", "plant", "furniture", "misc", "tree", "nature") & (shape != 0), SHAPED_OBJECT).when(joining & (F.col("frame_x").isNotNull() | F.col("frame_y").isNotNull()), FRAMED_BLOCK)
        .when(joining & thorn & (shape != 0), SHAPED_THORN).when(object_ & ~framed, UNFRAMED_OBJECT).when(object_ & (type_ == MOSS) & (F.col("frame_y") >= 4 * 54), UNKNOWN_SIDE).when(joining | object_, None).when(mask != 0, first).when(framed & F.col("stored"), None).when(~framed & (type_ == DRAWABLE_ROPE), None)
        .otherwise(UNKNOWN_TYPE)
    )
    up = _flag("rope", "_n")
    side = lambda d: _flag("side_rope", d) | (~up & _flag("side_block", d))
    roped = _mask({"n": up, "w": side("_w"), "e": side("_e"), "s": _flag("rope", "_s")})
    wraps = {t: (type_ == t) & ((F.col("frame_y") == 18) if t == SMALL_PILE else F.lit(True)) for t in WRAPS}
    wrap = F.coalesce(*[F.when(wraps[t], F.floor(F.col("frame_x") / F.lit(at))) for t, (at, _) in WRAPS.items()], F.lit(0)).cast("int")
    wrapped = lambda k: F.coalesce(*[F.when(wraps[t], F.col("_wrap") * by[k]) for t, by in WRAPS.items()], F.lit(0))
    like = {d: _bits("type", f"_{d}") == type_ + 1 for d in "nwes"}
    like["s"] = like["s"] | F.coalesce(_bits("type", "_s") == F.coalesce(*[F.when(type_ == t, under) for t, under in facts.THORN_GROUND.items()]) + 1, F.lit(False))
    known = cells.withColumns({"_why": F.when(F.col("active"), why), "_bm": F.when(type_ == DRAWABLE_ROPE, roped).otherwise(_mask(like)), "_wrap": wrap})
    form = F.when(F.col("active") & F.col("_why").isNull(), F.when(block, "approximate").when(joining & thorn, "approximate-static-thorn").when(joining, "approximate-static-block")
        .when(object_ & type_.isin(*facts.TALL_PLANTS, MOSS), "static-zero-wind").when(object_, "static-stored-frame").when(framed, "stored-frame").otherwise("approximate-rope"))
    known = known.withColumns({"_form": form, "_fx": F.col("frame_x") - wrapped(0), "_fy": F.col("frame_y") + wrapped(1)})
    stored, half = F.col("_form") == "stored-frame", F.col("_form").isin("approximate", "approximate-static-block") & (shape == 1)
    saved = F.col("_form").isin("stored-frame", "static-stored-frame", "static-zero-wind")
    tall, moss, gem = (object_ & type_.isin(*facts.TALL_PLANTS)), object_ & (type_ == MOSS), object_ & (type_ == GEM)
    side = F.floor(F.col("frame_y") / F.lit(54))  # what long moss hangs on
    pull = F.when(F.col("frame_y") <= 36, 2).when(F.col("frame_y") <= 108, -2).otherwise(0)
    torch = stored & (type_ == TORCH)
    high = F.exists(F.array(*[(type_ == t) & ((F.col("_fy") % every if every else F.col("_fy")) == row) for t, every, row in TALL_ROWS]), lambda t: t)
    height = F.when(half, 8).when(torch, 20).when((stored & high) | (F.col("_form") == "approximate-static-thorn"), 18).when(tall, 32).otherwise(16)
    width = F.when(torch | moss, 20).otherwise(16)
    left = F.when(torch | (moss & (side != 3)), -2).when(moss, 2).otherwise(0)
    down = (
        F.when(half, 8).when(torch & _flag("ceiling", "_n"), 4).when(tall, -12).when(moss, F.when(side < 2, pull).otherwise(pull / 2)).when(gem, F.when(F.col("frame_y") <= 36, 2).otherwise(0)).when(object_ & (type_ != STALACTITE), 2).otherwise(0)
    )
    phase = F.when(F.col("draw_layer") == "solid", "solid tile").otherwise("non-solid tile")
    place = dict(
        phase=phase, sx=F.when(saved, F.col("_fx")).otherwise(_frame("_bm", facts.BLOCK_FRAMES, 0)), sy=F.when(saved, F.col("_fy")).otherwise(_frame("_bm", facts.BLOCK_FRAMES, 1)), sw=width, sh=height,
        dx=F.col("x") * 16 + left, dy=F.col("y") * 16 + down, dw=width, dh=height, shape=shape,
    )
    flip = F.when(tall, F.col("x") % 2 == 0).otherwise(False)
    entry = _entry("tile", type_, F.col("_form"), F.col("_why"), (INVISIBLE, EMITTER), asset=asset_name(F.lit("Tiles"), type_), paint=F.col("paint"), fidelity=F.col("_form"), flip=flip, **place)
    number = F.coalesce(*[F.when(type_ == t, n) for t, (n, _) in facts.GLOW.items()])
    tint = F.coalesce(*[F.when(type_ == t, F.array(*map(F.lit, color))) for t, (_, color) in facts.GLOW.items()])
    glow = _entry("tile overlay", type_, F.col("_form"), F.lit(None), (), asset=asset_name(F.lit("Glow"), number), paint=0, fidelity="static-glow-mask", flip=False, tint=tint, **place)
    lit = F.col("_form").isNotNull() & joining & type_.isin(*facts.GLOW)
    return known.withColumns({"_tile": F.when(F.col("active"), entry), "_glow": F.when(lit, glow)})


def plan_cells(cells: DataFrame, world: Sequence[str] = (), reveal: bool = False, water_style: int = 0, surface: float | None = None) -> DataFrame:
    """One row for each entry: world, x, y and the fields of ENTRY. ``entry`` is command (with its rectangles and ``phase``), hidden or omitted (with a
    ``reason``); ``kind`` is wall, liquid, tile or tile overlay (always a command, with the vertex color ``tint``).

    ``cells (world, x, y, ...)`` are distinct and have the fields of DEFAULTS, frame_x and frame_y; absent ones and nulls stand for their default.
    Cells beyond the grid are no neighbours. ``reveal`` shows invisible blocks and walls; ``surface`` is the row of the world's surface.
    """
    spark = cells.sparkSession
    known = facts.materials(spark).select("type", "solid", "platform", "draw_layer").join(facts.families(spark), "type")
    given = {k: F.coalesce(F.col(k), F.lit(v)) if k in cells.columns else F.lit(v) for k, v in DEFAULTS.items()}
    frames = {k: F.col(k) if k in cells.columns else F.lit(None).cast("int") for k in ("frame_x", "frame_y")}
    own = cells.select(*world, "x", "y", *[v.alias(k) for k, v in (given | frames).items()]).join(F.broadcast(known), "type", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    in_the_way = F.col("active") & ~F.col("inactive")
    platform, ordinary = no(F.col("platform")), no(F.col("ordinary"))
    own = own.withColumns({"ordinary": ordinary, "stored": no(F.col("stored")), "_solid": in_the_way & ~platform & no(F.col("solid"))})
    seen = visible_block(F.col("active"), F.col("invisible_block"), reveal)
    near = (
        F.when(~in_the_way, 0).when(~F.col("shape").between(0, 5), 1).when(F.col("type").isin(*LIQUID_CONTEXT), 2).when(F.col("solid").isNull() & ~platform, 3).otherwise(0)
    )
    ordinary_here = seen & F.col("ordinary") & ~F.col("inactive")
    parts = {
        "type": F.when(seen & F.col("type").between(0, 2046), F.col("type") + 1).otherwise(0), "wall": visible_wall(F.col("wall"), F.col("invisible_wall"), reveal), "level": F.col("level").bitwiseAND(255), "liquid": F.col("liquid").bitwiseAND(7),
        "solid": F.col("_solid"), "shaped": in_the_way & (F.col("shape") != 0), "near": near, "rope": seen & ~F.col("inactive") & (no(F.col("rope")) | (F.col("ordinary") & (F.col("shape") == 0))), "side_rope": seen & (F.col("type") == DRAWABLE_ROPE),
        "side_block": ordinary_here, "ceiling": ordinary_here & (F.col("shape") == 0), "here": F.lit(1),
    }
    packed = sum((F.shiftleft(v.cast("long"), PACKED[k][0]) for k, v in parts.items()), F.lit(0).cast("long"))
    near_by = with_neighbours(own, packed, world)
    layered = _with_tiles(_with_liquids(_with_walls(near_by, reveal), water_style, surface), reveal)
    entries = F.explode(F.array_compact(F.array("_wall", "_pool", "_tile", "_glow")))
    return layered.select(*world, "x", "y", entries.alias("e")).select(*world, "x", "y", "e.*")


def commands_in_order(entries: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """The commands of ``plan_cells`` with ``seq``, their place in their world's drawing order: by phase, x, y. Each column of a phase is numbered
    apart and starts where the rows before it end."""
    keyed = draw_order(entries.where("entry = 'command'"), F.col("phase"), ["x", "y"]).drop("draw_key", "entry", "reason")
    return numbered(keyed, world, ("y", "kind"))


def numbered(keyed: DataFrame, world: Sequence[str] = (), down: Sequence[str] = ("y",)) -> DataFrame:
    """``keyed (world, phase_no, x, y, ...)``, one row at most for each phase, column and ``down``, with ``seq`` in the order of phase_no, x, ``down``."""
    sized = keyed.groupBy(*world, "phase_no", "x").agg(F.count("*").alias("_n"))  # one row a phase and column
    phases = sized.groupBy(*world, "phase_no").agg(F.sum("_n").alias("_p"))  # one row a phase
    earlier = Window.partitionBy(*(world or [F.lit(0)])).orderBy("phase_no").rowsBetween(Window.unboundedPreceding, -1)
    phases = phases.withColumn("_base", F.coalesce(F.sum("_p").over(earlier), F.lit(0))).drop("_p")
    before = Window.partitionBy(*world, "phase_no").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(phases, [*world, "phase_no"])
    place = F.row_number().over(Window.partitionBy(*world, "phase_no", "x").orderBy(*down)) - 1
    joined = keyed.withColumn("_place", place).join(starts.drop("_n"), [*world, "phase_no", "x"])
    return joined.withColumn("seq", F.col("_base") + F.col("_start") + F.col("_place")).drop("_base", "_start", "_place", "phase_no")


#: Side of the chunks whose order examples follow.
EXAMPLE_CHUNK = 128


def audit_report(entries: DataFrame, assets: DataFrame, world: Sequence[str] = ("world_id",)) -> DataFrame:
    """Many reports from one pass: world, ``report``, ``key``, ``n`` and the first example (x, y; by chunks of EXAMPLE_CHUNK, then x, y).

    Entries are counted by all that any report asks for: types, reasons, assets and source rectangles, all of them bounded by the facts, with the
    example as a mergeable minimum. Assets (``assets (asset, width, height)``) are looked up in that small table only; reports regroup it.
    Reports: visible, planned, commands by kind, unsupported by type and by reason, hidden by type, liquids by reason, missing and
    invalid and required by asset.
    """
    cell = F.struct(F.floor(F.col("x") / EXAMPLE_CHUNK).alias("cx"), F.floor(F.col("y") / EXAMPLE_CHUNK).alias("cy"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    keys = [*world, "entry", "kind", "type", "reason", "asset", "sx", "sy", "sw", "sh"]
    small = entries.groupBy(*keys).agg(F.count("*").alias("n"), F.min(cell).alias("first"))
    known = assets.select("asset", F.lit(True).alias("_known"), "width", "height")
    judged = small.join(known, "asset", "left")
    is_ = lambda entry, kind=None: (F.col("entry") == entry) & (F.col("kind") == kind if kind else F.lit(True))
    bad = F.coalesce((F.col("sx") < 0) | (F.col("sy") < 0) | (F.col("sx") + F.col("sw") > F.col("width")) | (F.col("sy") + F.col("sh") > F.col("height")), F.lit(False))
    type_ = F.col("type").cast("string")
    tile = F.col("kind") == "tile"
    emitter = is_("hidden", "tile") & (F.col("reason") != INVISIBLE)
    reports = {
        "visible": (tile & (is_("command") | is_("omitted") | emitter), F.lit("")),
        "planned": (is_("command", "tile"), F.lit("")),
        "commands": (is_("command"), F.col("kind")),
        "unsupported types": (is_("omitted", "tile"), type_),
        "unsupported reasons": (is_("omitted", "tile"), F.col("reason")),
        "hidden types": (emitter, type_),
        "liquid reasons": (is_("omitted", "liquid"), F.col("reason")),
        "missing assets": (is_("command") & F.col("_known").isNull(), F.col("asset")),
        "invalid crops": (is_("command") & bad, F.col("asset")),
        "required assets": (is_("command"), F.col("asset")),
    }
    rows = F.explode(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("report"), key.alias("key"))) for name, (when, key) in reports.items()])))
    found = judged.select(*world, "n", "first", rows.alias("r")).groupBy(*world, "r.report", "r.key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return found.select(*world, "report", "key", "n", F.col("first.x").alias("x"), F.col("first.y").alias("y"))


def balance(report: DataFrame, world: Sequence[str] = ("world_id",)) -> DataFrame:
    """One row a world: visible, planned, hidden, unsupported, and whether the first is the sum of the others."""
    total = lambda name, *reports: F.coalesce(F.sum(F.when(F.col("report").isin(*reports), F.col("n"))), F.lit(0)).alias(name)
    sums = report.groupBy(*world).agg(total("visible", "visible"), total("planned", "planned"), total("hidden", "hidden types"), total("unsupported", "unsupported types"))
    return sums.withColumn("balanced", F.col("visible") == F.col("planned") + F.col("hidden") + F.col("unsupported"))
