"""Scalar functions: all are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, _lit(high)), _lit(low))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def f32(x: Column) -> Column:
    return x.cast("float")


#: Sizes of the parts of a recipe id, lowest part first.
RECIPE = (("paint", 32), ("shape", 6), ("variant", 32), ("type", 1024), ("kind", 8))


def recipe_id(**parts: Column) -> Column:
    """One integer for (kind, type, variant, shape, paint)."""
    return reduce(lambda left, part: left * part[1] + parts[part[0]].cast("long"), RECIPE[-2::-1], parts["kind"].cast("long"))


def recipe_decode(recipe: Column) -> dict[str, Column]:
    """The parts of a recipe id."""
    out, rest = {}, recipe
    for name, size in RECIPE:
        out[name] = rest % size
        rest = F.floor(rest / F.lit(size))
    return out


def asset_name(kind: Column, type_: Column) -> Column:
    return F.format_string("%s_%d.png", kind, type_)


def parse_asset(name: Column) -> tuple[Column, Column]:
    """Kind and type of an asset's name; null if it isn't one."""
    kind, number = F.regexp_extract(name, r"^(\w+)_(\d+)\.png$", 1), F.regexp_extract(name, r"^(\w+)_(\d+)\.png$", 2)
    return F.when(kind != "", kind), F.when(number != "", number).cast("int")


def frame_key(columns: Sequence[str]) -> Column:
    """Colon-joined identity of a frame; nulls are empty."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def unknown_keys(text: Column, allowed: Sequence[str]) -> Column:
    """Keys of a JSON object that aren't allowed, sorted; null if it isn't an object."""
    return F.array_sort(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, allowed))))


#: Which of the strongest channel (a), the weakest (b) and their mean (c) a hue paint puts into red, green and blue;
#: paints 1 to 12, and 13 to 24 as their deep forms.
PAINT_CHANNELS = ("abb", "acb", "aab", "cab", "bab", "bac", "baa", "bca", "bba", "cba", "aba", "abc")
#: Types whose hue paints spare pixels by hue and saturation, with the least and most of both, the offset of the hue and
#: whether the range is what is spared; and the types that hue paints can't do.
MASKED_TYPES = (((0, 2, 23, 109, 199, 477, 492, 633), (0.03, 0.08, 0.38, 0.53, 0.0, True)), ((59, 60, 70), (0.42, 0.55, 0.2, 0.27, 0.5, True)))
UNPAINTED_TYPES = (5, 323, 583, 584, 585, 586, 587, 588, 589, 595, 596, 615, 616, 634)


def _single(value: float) -> Column:
    """A constant in single precision, as a double."""
    return F.lit(value).cast("float").cast("double")


def paint_color(r: Column, g: Column, b: Column, paint: Column, wall: bool = False, spared: Column | None = None) -> Column:
    """Recoloured opaque pixel as a struct (r, g, b) of bytes; paints 0 and 31 leave it.

    Paints 1 to 12 and their deep forms 13 to 24 deal the strongest channel, the weakest (deep: 0.4 of it) and the mean of both out
    to the channels. 25, 26, 27 and 29 are greys of their own strength, 28 a brown, 30 the negative (walls: a darker one; black
    stays). Pixels that are ``spared`` (see paint_spares) keep their colour under paints 1 to 12. Unknown paints give a null.
    """
    x, y, z = (v / F.lit(255.0) for v in (r, g, b))
    high, low = F.greatest(x, y, z), F.least(x, y, z)
    byte = lambda v: half_up(clamp(v, 0.0, 1.0) * 255).cast("int")
    pixel = lambda *values: F.struct(*[v.alias(name) for name, v in zip("rgb", values)])
    same = pixel(*(v.cast("int") for v in (r, g, b)))
    weak = F.when(paint <= 12, low).otherwise(_single(0.4) * low)
    parts = F.array(high, weak, (high + weak) * 0.5)
    place = F.pmod(paint - 1, F.lit(12)).cast("int") + 1
    dealt = lambda k: F.element_at(parts, F.element_at(F.array(*[F.lit("abc".index(letters[k]) + 1) for letters in PAINT_CHANNELS]), place))
    grey = F.when(paint == 25, _single(0.15) * (high + low)).when(paint == 26, (high * 7 + low * 3) * _single(0.1) * (F.lit(2.0) - (high + low) * 0.5))
    grey = byte(grey.when(paint == 27, (high + low) * 0.5).when(paint == 29, _single(0.025) * (high + low)))
    negative = lambda v: byte(F.lit(0.75) - v * 2 if wall else F.lit(1.0) - v)
    left = paint.isin(0, 31) | ((paint == 30) & (high == 0))
    if spared is not None:
        left = left | (paint.between(1, 12) & spared)
    out = F.when(left, same).when(paint.between(1, 24), pixel(*(byte(dealt(k)) for k in range(3)))).when(paint.isin(25, 26, 27, 29), pixel(grey, grey, grey))
    return out.when(paint == 28, pixel(*(byte(v) for v in (high, _single(0.7) * high, _single(0.49) * high)))).when(paint == 30, pixel(negative(x), negative(y), negative(z)))


def hue_sat_mask(r: Column, g: Column, b: Column, min_hue, max_hue, min_sat, max_sat, hue_offset=0.0, invert=False) -> Column:
    """Whether a pixel's hue (0 to 1, grey: 0) plus the offset, and its saturation, lie in range; a sum of one or more loses its
    whole part, a negative one keeps its sign."""
    x, y, z = (v / F.lit(255.0) for v in (r, g, b))
    high = F.greatest(x, y, z)
    span = high - F.least(x, y, z)
    part = F.nullif(span, F.lit(0.0))
    sector = F.when(high == x, (y - z) / part).when(high == y, (z - x) / part + 2).otherwise((x - y) / part + 4) / 6
    hue = (F.coalesce(sector - F.floor(sector), F.lit(0.0)) + hue_offset) % F.lit(1.0)
    sat = F.coalesce(span / F.nullif(high, F.lit(0.0)), F.lit(0.0))
    hit = (hue >= min_hue) & (hue <= max_hue) & (sat >= min_sat) & (sat <= max_sat)
    return hit != _lit(invert)


def paint_spares(r: Column, g: Column, b: Column, type_: Column) -> Column:
    """Whether hue paints spare a tile's pixel: types with a mask, outside of it."""
    out = F.when(F.lit(False), F.lit(False))
    for types, (*bounds, offset, invert) in MASKED_TYPES:
        out = out.when(type_.isin(*types), ~hue_sat_mask(r, g, b, *map(_single, bounds), offset, invert))
    return out.otherwise(F.lit(False))


def paint_reason(type_: Column, paint: Column, wall: bool = False) -> Column:
    """Why a paint can't be put on a type; null where it can."""
    reason = F.when(~F.coalesce(paint.between(0, 31), F.lit(False)), "unknown paint")
    if wall:
        return reason
    hue = paint.between(1, 12)
    return reason.when(hue & (type_.isNull() | (type_ < 0)), "unknown type").when(hue & type_.isin(*UNPAINTED_TYPES), "tree")


def multiply_color(a: Column, b: Column) -> Column:
    """Product of two byte channels, rounded half up."""
    return half_up(a * b / F.lit(255.0)).cast("int")


def split_premultiplied(value: Column, alpha: Column) -> tuple[Column, Column]:
    """Source-over part (at most alpha) and additive rest of a premultiplied channel."""
    over = F.least(value, alpha)
    return over, value - over


def fill_height(level: Column) -> Column:
    """Rows of 16 that a liquid of ``level`` (0 to 255) fills."""
    return F.ceil(level / F.lit(255.0) * 16).cast("int")


#: The three-by-three position table of walls that touch on all four sides.
WALL_TABLE = ((2, 0, 0), (0, 1, 4), (0, 3, 0))


def wall_variant(mask: Column, x: Column, y: Column) -> Column:
    """15 plus the place's number in the table where all four neighbours touch, else the mask: 20 variants."""
    at = (F.pmod(x, F.lit(3)) * 3 + F.pmod(y, F.lit(3)) + 1).cast("int")
    return F.when(mask == 15, F.lit(15) + F.element_at(F.array(*[F.lit(v) for row in WALL_TABLE for v in row]), at)).otherwise(mask)


def harvestable(style: Column, y: Column, state: Mapping[str, Column]) -> Column:
    """Whether a herb is ripe. Style 0 by day, 1 by night, 2 and 6 never, 3 at night with a blood moon or full moon, 4 in rain or under
    clouds, 5 after 40,500 ticks unless rain falls on it. ``state``: day_time, blood_moon, raining, remix_world, moon_phase, time,
    cloud_alpha, world_surface, world_height. Null for unknown styles, and for others than 2 and 6 where any of the state is unknown."""
    s = state
    valid = s["moon_phase"].between(0, 7) & (s["time"] >= 0) & s["cloud_alpha"].between(0, 1)
    for name in ("day_time", "blood_moon", "raining", "remix_world", "world_surface", "world_height"):
        valid = valid & s[name].isNotNull()
    sheltered = F.when(s["remix_world"], y < s["world_height"] - 350).otherwise(y > s["world_surface"])
    ripe = F.when(style == 0, s["day_time"]).when(style == 1, ~s["day_time"]).when(style == 3, ~s["day_time"] & (s["blood_moon"] | (s["moon_phase"] == 0)))
    ripe = ripe.when(style == 4, s["raining"] | (s["cloud_alpha"] > 0)).when(style == 5, (~s["raining"] | sheltered) & (s["time"] > 40_500))
    return F.when(style.isin(2, 6), F.lit(False)).when(F.coalesce(valid, F.lit(False)), ripe)


#: Corner points of each sloped shape in a cell of 16 by 16.
POLYGONS = {2: ((0, 0), (16, 16), (0, 16)), 3: ((0, 16), (16, 0), (16, 16)), 4: ((0, 0), (16, 0), (0, 16)), 5: ((0, 0), (16, 0), (16, 16))}


def polygon_of(shape: Column) -> Column:
    """Points of a slope as array<array<int>>; null for other shapes."""
    points = lambda p: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in p])
    return reduce(lambda c, s: c.when(shape == s, points(POLYGONS[s])), POLYGONS, F.when(F.lit(False), points(POLYGONS[2])))


#: SQL functions with these bodies; they stay Catalyst expressions.
SQL_FUNCTIONS = {
    "grid_clamp": "(v DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN greatest(least(v, high), low)",
    "grid_half_up": "(v DOUBLE) RETURNS BIGINT RETURN floor(v + 0.5)",
    "grid_recipe_id": f"(kind INT, type INT, variant INT, shape INT, paint INT) RETURNS BIGINT RETURN {reduce(lambda left, part: f'({left} * {part[1]} + {part[0]})', RECIPE[-2::-1], 'cast(kind AS BIGINT)')}",
    "grid_asset_name": "(kind STRING, type INT) RETURNS STRING RETURN concat(kind, '_', type, '.png')",
    "grid_fill_height": "(level INT) RETURNS INT RETURN cast(ceil(level / 255.0D * 16) AS INT)",
    "grid_multiply": "(a INT, b INT) RETURNS INT RETURN cast(floor(a * b / 255.0D + 0.5) AS INT)",
    "grid_wall_variant": "(mask INT, x BIGINT, y BIGINT) RETURNS INT RETURN CASE WHEN mask = 15 THEN 15 + element_at(array(" + ", ".join(str(v) for row in WALL_TABLE for v in row) + "), cast(pmod(x, 3) * 3 + pmod(y, 3) + 1 AS INT)) ELSE mask END",
    "grid_recipe_part": f"(recipe BIGINT, part STRING) RETURNS BIGINT RETURN CASE part {' '.join(f"WHEN '{name}' THEN recipe div {prod(n for _, n in RECIPE[:k])}" + f' % {size}' * (name != 'kind') for k, (name, size) in enumerate(RECIPE))} END",
    "grid_frame_key": "(asset STRING, sx INT, sy INT, sw INT, sh INT) RETURNS STRING RETURN concat_ws(':', coalesce(asset, ''), coalesce(cast(sx AS STRING), ''), coalesce(cast(sy AS STRING), ''), coalesce(cast(sw AS STRING), ''), coalesce(cast(sh AS STRING), ''))",
    "grid_saturation": "(r INT, g INT, b INT) RETURNS DOUBLE RETURN CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / cast(greatest(r, g, b) AS DOUBLE) ELSE 0D END",
    "grid_hue": "(r INT, g INT, b INT) RETURNS DOUBLE RETURN CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0D ELSE pmod(CASE greatest(r, g, b) WHEN r THEN (g - b) / cast(greatest(r, g, b) - least(r, g, b) AS DOUBLE) WHEN g THEN 2 + (b - r) / cast(greatest(r, g, b) - least(r, g, b) AS DOUBLE) ELSE 4 + (r - g) / cast(greatest(r, g, b) - least(r, g, b) AS DOUBLE) END, 6D) / 6 END",
    "grid_source_over": "(value INT, alpha INT) RETURNS INT RETURN least(value, alpha)",
    "grid_additive": "(value INT, alpha INT) RETURNS INT RETURN value - least(value, alpha)",
    "grid_harvestable": """(style INT, y INT, day BOOLEAN, blood BOOLEAN, raining BOOLEAN, remix BOOLEAN, moon INT, time DOUBLE, clouds DOUBLE, surface DOUBLE, height INT) RETURNS BOOLEAN RETURN
        CASE WHEN style IN (2, 6) THEN false WHEN day IS NULL OR blood IS NULL OR raining IS NULL OR remix IS NULL OR surface IS NULL OR height IS NULL OR NOT coalesce(moon BETWEEN 0 AND 7 AND time >= 0 AND clouds BETWEEN 0 AND 1, false) THEN NULL
        WHEN style = 0 THEN day WHEN style = 1 THEN NOT day WHEN style = 3 THEN NOT day AND (blood OR moon = 0) WHEN style = 4 THEN raining OR clouds > 0
        WHEN style = 5 THEN (NOT raining OR CASE WHEN remix THEN y < height - 350 ELSE y > surface END) AND time > 40500 END""",
}


def _paint_body(channel: str) -> str:
    """SQL of one channel of paint_color (for tiles without a mask)."""
    high, low, x = "(greatest(r, g, b) / 255D)", "(least(r, g, b) / 255D)", f"({channel} / 255D)"
    single = lambda v: f"cast({v}F AS DOUBLE)"
    cases = [f"paint IN (0, 31) THEN {x}"]
    for letter in "abc":
        own = [n + 1 for n, letters in enumerate(PAINT_CHANNELS) if letters["rgb".index(channel)] == letter]
        for shift, weak in ((0, low), (12, f"({single(0.4)} * {low})")):
            cases.append(f"paint IN ({', '.join(str(n + shift) for n in own)}) THEN " + {"a": high, "b": weak, "c": f"({high} + {weak}) * 0.5D"}[letter])
    brown = {"r": high, "g": f"{single(0.7)} * {high}", "b": f"{single(0.49)} * {high}"}[channel]
    cases += [f"paint = 25 THEN {single(0.15)} * ({high} + {low})", f"paint = 26 THEN ({high} * 7 + {low} * 3) * {single(0.1)} * (2D - ({high} + {low}) * 0.5D)", f"paint = 27 THEN ({high} + {low}) * 0.5D"]
    cases += [f"paint = 28 THEN {brown}", f"paint = 29 THEN {single(0.025)} * ({high} + {low})", f"paint = 30 THEN CASE WHEN {high} = 0 THEN {x} ELSE 1D - {x} END"]
    return f"(r INT, g INT, b INT, paint INT) RETURNS INT RETURN cast(floor(greatest(0D, least(1D, CASE WHEN {' WHEN '.join(cases)} END)) * 255 + 0.5D) AS INT)"


SQL_FUNCTIONS |= {f"grid_paint_{name}": _paint_body(name[0]) for name in ("red", "green", "blue")}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL of this session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(SQL_FUNCTIONS)
