"""Paths down a grid: straight falls by one window, winding ones by tables of moves.

What a path does in a cell depends on the cell's neighbourhood alone, so every cell gets the number of its move first, by windows inside
chunks with a ring. A move, a direction and a count of turns give the next state by a fixed table. A chunk's moves are one array, and an open
state walks in it inside the JVM (a higher-order function that looks the next cell up) until it ends, leaves the chunk, or has taken as many steps as
the chunk is wide; then it is handed on. Rounds are chunks crossed, not steps, and each is written to the shared folder: a lost
executor repeats one at most. Doubling the successor of every state would take the logarithm of the steps in rounds, but each of them a shuffle
of six states for every cell of the grid, where here the cells move once and later rounds move open states alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import with_ring
from .storage import discard, stored

#: Side of the chunks that states walk in, and the most steps of a state in one round.
SIDE = 64


def trace_vertical(origins: DataFrame, cells: DataFrame, height: int, most: int, world: Sequence[str] = ()) -> DataFrame:
    """Straight falls from ``origins (idx, x, y)``: idx, x, y, step and the path's end ``reason``: solid, liquid, end (of the world) or limit.

    ``cells (x, y, level, is_solid)``. Origins and stops of a column are sorted together, and each origin takes the next stops under it:
    one window, no rounds.
    """
    keys = [*world, "x"]
    none = F.lit(None)
    stops = cells.where("is_solid or level > 0").select(*keys, F.col("y").cast("long").alias("y"), none.cast("long").alias("idx"), "is_solid")
    both = stops.unionByName(origins.select(*keys, F.col("y").cast("long").alias("y"), F.col("idx").cast("long").alias("idx"), none.cast("boolean").alias("is_solid")))
    under = Window.partitionBy(*keys).orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, -1)
    near = lambda solid: F.min(F.when(F.col("is_solid") == solid, F.col("y"))).over(under)
    found = both.withColumns({"_wall": near(True), "_pool": near(False)}).where("idx is not null")
    stop = F.least(F.coalesce("_wall", F.lit(height)), F.coalesce("_pool", F.lit(height)), F.lit(height), F.col("y") + most + 1)
    reason = F.when(F.col("_stop") == F.col("_wall"), "solid").when(F.col("_stop") == F.col("_pool"), "liquid").when(F.col("_stop") == height, "end").otherwise("limit")
    paths = found.withColumn("_stop", stop).withColumn("reason", reason).where("_stop > y + 1")
    paths = paths.withColumn("step", F.explode(F.sequence(F.lit(1), (F.col("_stop") - F.col("y") - 1).cast("int"))))
    return paths.select(*world, "idx", "x", (F.col("y") + F.col("step")).cast("long").alias("y"), "step", "reason")


def _beside(cells: DataFrame, value: Column, directions: Sequence[str], world: Sequence[str]) -> DataFrame:
    """``cells`` with ``_o`` (``value``) and that of the neighbours as ``_w``, ``_e``, ``_s`` and the diagonals ``_sw``, ``_se``, null where there is none.
    Of repeated cells one counts."""
    ring = with_ring(cells.dropDuplicates([*world, "x", "y"]).withColumn("_o", value), world)
    down = Window.partitionBy(*world, "_cx", "_cy", "x").orderBy("y")
    along = Window.partitionBy(*world, "_cx", "_cy", "y").orderBy("x")
    ring = ring.withColumn("_s", F.when(F.lead("y").over(down) == F.col("y") + 1, F.lead("_o").over(down))).withColumn("_two", F.struct("_o", "_s"))
    ring = ring.withColumns({"_left": F.when(F.lag("x").over(along) == F.col("x") - 1, F.lag("_two").over(along)), "_right": F.when(F.lead("x").over(along) == F.col("x") + 1, F.lead("_two").over(along))})
    parts = {"_w": "_left._o", "_e": "_right._o", "_sw": "_left._s", "_se": "_right._s"}
    return ring.where("_core").select(*[c for c in ring.columns if c not in ("_cx", "_cy", "_core", "_two", "_left", "_right")], *[F.col(parts[d]).alias(d) for d in directions])


def _chunked(cells: DataFrame, world: Sequence[str], side: int) -> DataFrame:
    """(world, cx, cy, codes): one row a chunk, with the ``code`` (at most 127) of each place, column by column, as bytes; -1 where there is no cell."""
    keys = [*world, "cx", "cy"]
    at = lambda c: F.floor(F.col(c) / F.lit(side))
    place = F.pmod(F.col("x"), F.lit(side)) * side + F.pmod(F.col("y"), F.lit(side))
    own = cells.select(*world, at("x").alias("cx"), at("y").alias("cy"), place.cast("int").alias("place"), F.col("code").cast("int").alias("code")).repartition(*keys)
    blank = own.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("place"), F.lit(-1).alias("code"))
    full = own.union(blank).groupBy(*keys, "place").agg(F.max("code").alias("code"))
    return full.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("p")).select(*keys, F.expr("transform(p, q -> cast(q.code AS tinyint))").alias("codes"))


def _walk(states: DataFrame, chunks: DataFrame, state: str, step: str, world: Sequence[str], side: int, most_rounds: int) -> DataFrame:
    """``states (world, own, s)`` when they are done. ``s`` is a struct as in ``state``, with x, y, done and open; ``step`` is the SQL of the state after ``s``
    in a cell with the code ``c``. States that leave their chunk, or aren't done after ``side`` steps, go on in another round. Chunks are the whole grid, though small
    as files: they are shuffled to the states, never collected to be broadcast in every round."""
    keys = [*world, "cx", "cy"]
    inside = f"floor(s.x / {side}) = cx AND floor(s.y / {side}) = cy"
    code = f"codes[cast(pmod(s.x, {side}) * {side} + pmod(s.y, {side}) AS int)]"
    walked = F.expr(f"aggregate(sequence(1, {side}), s0, (s, i) -> IF(s.done OR NOT ({inside}), s, element_at(transform(array({code}), c -> cast({step} AS {state})), 1)))")
    chunks = stored(chunks)
    open_, done = states, []
    for _ in range(most_rounds):
        placed = open_.withColumns({"cx": F.expr(f"floor(s.x / {side})"), "cy": F.expr(f"floor(s.y / {side})")}).withColumnRenamed("s", "s0")
        # a chunk without any cell: one place without a cell decides
        joined = placed.join(chunks.hint("merge"), keys, "left").withColumn("codes", F.expr(f"coalesce(codes, array_repeat(cast(-1 AS tinyint), {side * side}))"))
        done.append(stored(joined.withColumn("s", walked).select(*states.columns)))
        open_ = done[-1].where("NOT s.done")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"open after {most_rounds} rounds")
    discard(chunks)
    return reduce(DataFrame.unionByName, done).where("s.done")


#: Types beside a path that lengthen it; the type that never stops one; the platform that turns none.
LENGTHENING, NEVER_SOLID, LEVEL_PLATFORM = (189, 196), 546, 19

#: The moves by falling precedence: when (over the cell _t and its neighbours _w, _e, _s), columns and rows gone, the direction afterwards and what becomes of the
#: turns (kept, forgotten, or one more if the direction was the one named). ``d`` is the direction before.
MOVES = (
    ("_s.ramp = 1 AND _t.deep AND NOT _s.flat", "1", "1", "1", "kept"),
    ("_s.ramp = -1 AND _t.deep AND NOT _s.flat", "-1", "1", "-1", "kept"),
    ("_t.deep AND (_s.void OR NOT _s.active)", "0", "1", "d", "forgotten"),
    ("_w.barrier AND NOT _e.shut", "1", "0", "1", "-1"),
    ("_e.barrier AND NOT _w.shut", "-1", "0", "-1", "1"),
    ("NOT _w.shut AND _t.ramp = 0 AND NOT _e.sunk", "d", "0", "d", "kept"),
    ("true", "0", "0", "d", "any"),
)
#: Bits of a cell's code above the number of its move.
_HARD, _EDGE, _WET, _LONG = 8, 16, 32, 64


def move_table() -> list[int]:
    """The state after each move, direction (-1, 0, 1) and count of turns (0, 1), as dx + 1, dy, direction + 1 and turns in 2, 1, 2 and 2 bits. A second turn takes
    the other way."""
    out = []
    for _, dx, dy, after, turns in MOVES:
        for d in (-1, 0, 1):
            for had in (0, 1):
                now = {"kept": had, "forgotten": 0, "any": had + 1}.get(turns)
                now = had + (d == int(turns)) if now is None else now
                back = -1 if now >= 2 else 1
                go, to = (back * (d if v == "d" else int(v)) for v in (dx, after))
                out.append((go + 1) | int(dy) << 2 | (to + 1) << 3 | now << 5)
    return out


PATH = "struct<x: bigint, y: bigint, step: int, dir: int, turns: int, most: int, done: boolean, reason: string, rows: array<struct<step: int, x: bigint, y: bigint, reason: string>>>"


def trace_paths(origins: DataFrame, cells: DataFrame, max_steps: int, world: Sequence[str] = (), longest: int | None = None, side: int = SIDE) -> DataFrame:
    """Winding paths from ``origins (idx, x, y)``: world, idx, step, x, y and, on the last row of each path, ``reason``.

    At each cell the first of MOVES that fits is taken: down a slope (no platform, not in a half cell); down, where the cell below is open; away
    from a barrier (a whole solid, a slope's top, or liquid) to a free side; on in its direction if the left is free; else it stays. Turning back and
    staying count as turns, which a fall forgets. A second turn takes it one step the other way, and ends it there (``reversed``). It ends
    in a whole solid cell (``solid``), in liquid (``liquid``, not in half cells), where it stays (``stationary``), and after ``max_steps``
    (``distance``), or ``longest`` once it passed a type that lengthens it. A path that needs a cell beyond the grid has no rows but its
    first, with the reason ``edge``.

    ``cells (x, y, active, type, shape, level, is_solid)``, is_solid being the material's; null and absent facts count as none.
    """
    col = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in cells.columns else F.lit(default)
    shape, type_, active, wet = col("shape", 0), col("type", -1), col("active", True), col("level", 0) > 0
    hard = col("is_solid", False) & (shape == 0) & (type_ != NEVER_SOLID)
    ramp = F.when(shape == 2, 1).when(shape == 3, -1).otherwise(0)
    facts = {
        "hard": hard, "wet": wet, "ramp": ramp, "deep": shape != 1, "flat": type_ == LEVEL_PLATFORM, "active": active, "void": ~(hard | shape.isin(4, 5)), "shut": hard | wet, "barrier": hard | wet | (ramp != 0), "sunk": hard & wet,
        "long": active & type_.isin(*LENGTHENING),
    }
    coded = _beside(cells.select(*world, "x", "y", F.struct(*[v.alias(k) for k, v in facts.items()]).alias("_f")), F.col("_f"), ["_w", "_e"], world).withColumnRenamed("_o", "_t")
    number = "CASE " + " ".join(f"WHEN {when} THEN {k}" for k, (when, *_) in enumerate(MOVES)) + " END"
    edge = "_w IS NULL OR _e IS NULL OR _s IS NULL"
    code = f"IF({edge}, {_EDGE}, {number} + IF(_t.wet AND _t.deep, {_WET}, 0) + IF(_w.long OR _e.long OR _s.long, {_LONG}, 0)) + IF(_t.hard, {_HARD}, 0)"
    chunks = _chunked(coded.select(*world, "x", "y", F.expr(code).alias("code")), world, side)
    extended = max_steps if longest is None else longest
    after = f"array({', '.join(map(str, move_table()))})[(c & 7) * 6 + (s.dir + 1) * 2 + s.turns]"
    why = (
        f"CASE WHEN s.step >= s.most THEN 'distance' WHEN s.turns >= 2 THEN 'reversed' WHEN c = -1 THEN 'edge' WHEN c & {_HARD} <> 0 THEN 'solid' WHEN c & {_EDGE} <> 0 THEN 'edge' WHEN n & 7 = 1 THEN 'stationary' WHEN c & {_WET} <> 0 THEN 'liquid' END"
    )
    last = "r IS NOT NULL"
    moved = (
        f"struct(IF({last}, s.x, s.x + (n & 3) - 1) AS x, IF({last}, s.y, s.y + (shiftright(n, 2) & 1)) AS y, IF({last}, s.step, s.step + 1) AS step, IF({last}, s.dir, (shiftright(n, 3) & 3) - 1) AS dir, IF({last}, s.turns, shiftright(n, 5)) AS turns,"
        f" IF(c & {_LONG} <> 0, {extended}, s.most) AS most, {last} AS done, r AS reason, concat(s.rows, array(struct(s.step AS step, s.x AS x, s.y AS y, r AS reason))) AS rows)"
    )
    one = f"element_at(transform(array(IF(c < 0 OR s.turns > 1, 0, {after})), n -> element_at(transform(array({why}), r -> {moved}), 1)), 1)"
    first = f"cast(struct(x, y, 0 AS step, 0 AS dir, 0 AS turns, {max_steps} AS most, false AS done, cast(NULL AS string) AS reason, array() AS rows) AS {PATH})"
    start = origins.select(*world, F.col("idx").cast("long").alias("idx"), F.expr(first).alias("s"))
    found = _walk(start, chunks, PATH, one, world, side, max(max_steps, extended) + 2)
    rows = found.withColumn("rows", F.expr("IF(s.reason = 'edge', array(named_struct('step', 0, 'x', s.rows[0].x, 'y', s.rows[0].y, 'reason', 'edge')), s.rows)"))
    return rows.select(*world, "idx", F.explode("rows").alias("r")).select(*world, "idx", "r.step", "r.x", "r.y", "r.reason")


ROOT = "struct<x: bigint, y: bigint, steps: int, done: boolean, complete: boolean>"


def trace_root(starts: DataFrame, cells: DataFrame, classes: Mapping[int, str], max_steps: int, world: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Root of each connected stack from ``starts (x0, y0, kind)``: down cells of the same kind. Where the cell below is of another kind the stack goes on
    one column beside, left first, if both the cell beside and the one under it are of its kind, and never more than one column from its start.
    Gives root_x, root_y, steps and the class of the kind under the root; null for unlisted kinds and nothing.

    A stack that goes on after ``max_steps`` has no root: ``complete`` is false, the place is where the walk ended, the class is null.
    """
    near = _beside(cells.select(*world, "x", "y", F.col("kind").cast("int").alias("kind")), F.col("kind"), ["_w", "_e", "_sw", "_se"], world)
    bit = lambda same, value: F.when(F.coalesce(same, F.lit(False)), value).otherwise(0)
    own = F.col("kind")
    code = bit(F.col("_s") == own, 1) + bit((F.col("_w") == own) & (F.col("_sw") == own), 2) + bit((F.col("_e") == own) & (F.col("_se") == own), 4)
    chunks = _chunked(near.select(*world, "x", "y", code.alias("code")), world, side)
    go = "CASE WHEN c & 1 = 1 THEN 0 WHEN c & 2 = 2 AND s.x >= x0 THEN -1 WHEN c & 4 = 4 AND s.x <= x0 THEN 1 END"
    one = f"element_at(transform(array(IF(c < 0, NULL, {go})), d -> IF(d IS NULL OR s.steps >= {max_steps}, struct(s.x AS x, s.y AS y, s.steps AS steps, true AS done, d IS NULL AS complete), struct(s.x + d AS x, s.y + 1 AS y, s.steps + 1 AS steps, false AS done, false AS complete))), 1)"
    first = f"cast(struct(x0 AS x, y0 AS y, 0 AS steps, false AS done, false AS complete) AS {ROOT})"
    start = starts.select(*world, F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"), F.expr(first).alias("s"))
    found = _walk(start, chunks, ROOT, one, world, side, max_steps + 2)
    under = cells.select(*world, F.col("x").alias("root_x"), (F.col("y") - 1).alias("root_y"), F.col("kind").cast("int").alias("_base")).dropDuplicates([*world, "root_x", "root_y"])
    rooted = found.select(*world, "x0", "y0", F.col("s.x").alias("root_x"), F.col("s.y").alias("root_y"), F.col("s.steps").alias("steps"), F.col("s.complete").alias("complete")).join(under, [*world, "root_x", "root_y"], "left")
    names = F.create_map(*[F.lit(v) for pair in classes.items() for v in pair])
    return rooted.select(*world, "x0", "y0", "root_x", "root_y", "steps", F.when(F.col("complete"), F.try_element_at(names, F.col("_base"))).alias("class"), "complete")


def stack_ground(cells: DataFrame, stack: Column, solid: Column, most: int = 20, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``ground_y``: the first solid cell at or under the first cell of a stack, both at most ``most`` rows below a cell (which counts itself); null
    without. The grounds of plants are looked up so."""
    down = Window.partitionBy(*world, "x").orderBy("y")
    next_solid = F.min(F.when(solid, F.col("y"))).over(down.rangeBetween(0, most))
    found = F.min(F.when(stack, F.struct(F.col("y").alias("at"), F.col("_solid").alias("ground")))).over(down.rangeBetween(0, most))
    marked = cells.withColumn("_solid", next_solid).withColumn("_found", found)
    return marked.withColumn("ground_y", F.when(F.col("_found.ground") <= F.col("y") + most, F.col("_found.ground"))).drop("_solid", "_found")
