"""Window operators over columns, commands, paths and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import beside, with_ring
from .ranks import with_place
from .storage import discard, stored

#: Rows over which a falling liquid fades, by kind.
FALL_LENGTH = {1: 10, 2: 3, 3: 2, 4: 10}
#: Rows of a column that chained falls are folded over at once.
FALL_ROWS = 256


def vertical_context(cells: DataFrame, value: str, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``above`` and ``below``: the value directly above and below, null where that cell is missing."""
    order = Window.partitionBy(*world, "x").orderBy("y")
    near = lambda f, d: F.when(f("y").over(order) == F.col("y") + d, f(value).over(order))
    return cells.withColumns({"above": near(F.lag, -1), "below": near(F.lead, 1)})


def register_capped(candidates: DataFrame, cap: int | None, world: Sequence[str] = (), order: Sequence[str] = ("x", "y")) -> tuple[DataFrame, DataFrame]:
    """(registered, report): candidates with ``idx`` in column-major order, the first ``cap`` of each world (None: all); eligible, registered, capped."""
    counts = candidates.groupBy(*world).agg(F.count("*").alias("eligible"))
    least = F.least(F.col("eligible"), F.lit(cap)) if cap is not None else F.col("eligible")
    report = counts.withColumns({"registered": least, "capped": F.col("eligible") - least})
    if cap is None:
        return with_place(candidates, list(order), "idx", world), report  # by ranges, not in one window
    column_major = Window.partitionBy(*(world or [F.lit(0)])).orderBy(*order)
    few = candidates if world else candidates.orderBy(*order).limit(cap)  # then the one window holds no more than the cap
    kept = few.withColumn("idx", F.row_number().over(column_major) - 1)
    return kept.where(F.col("idx") < cap), report


def layer_stack(commands: DataFrame, origin: Sequence[str], order: str, asset: str = "asset") -> DataFrame:
    """Adds ``stack``: grows where the asset changes, and starts anew with each origin."""
    w = Window.partitionBy(*origin).orderBy(order)
    change = F.when(F.lag(asset).over(w).eqNullSafe(F.col(asset)) | F.lag(order).over(w).isNull(), 0).otherwise(1)
    return commands.withColumn("_change", change).withColumn("stack", F.sum("_change").over(w)).drop("_change")


def first_appearance_rank(commands: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Each value of ``key`` with its first use and its place (from 1) in the order of first uses."""
    first = commands.groupBy(key).agg(F.min(order).alias("first_seq"))
    return with_place(first, ["first_seq"], "place").withColumn("place", F.col("place") + 1)


def bridge_levels(cells: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Adds ``bridged`` (0 to 1, single precision), ``bridge_kind`` and ``full``: a cell's own level, or what its neighbours lend to an empty one.

    A half cell under a wet one is ``full``, of its own kind if wet, else of that above. Other wet or solid cells have their own
    level. An empty cell between two wet cells of one kind that aren't solid, above and below or left and right, gets half
    their sum, the larger of both ways; left and right set the kind before above and below. ``cells (x, y, liquid, level,
    is_solid, half)``: level 0 to 255, half without platforms. The grid's edge lends nothing.
    """
    level = (F.col("level") / F.lit(255.0)).cast("float")
    value = F.struct(F.col("level").alias("amount"), level.alias("level"), F.col("liquid").alias("liquid"), F.col("is_solid").alias("solid"))
    seen = with_ring(cells.withColumn("_value", value), world).withColumns({f"_{d}": F.max("_value").over(beside(d, world)) for d in ("n", "s", "w", "e")})

    def lent(a: str, b: str) -> Column:
        wet = (F.col(f"_{a}.amount") > 0) & (F.col(f"_{b}.amount") > 0) & ~F.col(f"_{a}.solid") & ~F.col(f"_{b}.solid")
        return F.when(wet & (F.col(f"_{a}.liquid") == F.col(f"_{b}.liquid")), (F.col(f"_{a}.level") + F.col(f"_{b}.level")).cast("float"))

    down, across = lent("n", "s"), lent("w", "e")
    full = F.coalesce(F.col("half") & (F.col("_n.amount") > 0), F.lit(False))
    both = F.greatest(F.coalesce(down, F.lit(0.0).cast("float")), F.coalesce(across, F.lit(0.0).cast("float"))) * F.lit(0.5).cast("float")
    own = (F.col("level") > 0) | F.col("is_solid")
    bridged = F.when(full, F.lit(1.0).cast("float")).when(own, level).otherwise(both).cast("float")
    kind = F.when(full & (F.col("level") == 0), F.col("_n.liquid")).when(full | own, F.col("liquid")).when(across.isNotNull(), F.col("_w.liquid")).when(down.isNotNull(), F.col("_n.liquid")).otherwise(F.col("liquid"))
    return seen.where("_core").withColumns({"bridged": bridged, "bridge_kind": kind, "full": full}).drop("_value", "_n", "_s", "_w", "_e", "_cx", "_cy", "_core")


def fall_levels_single(cells: DataFrame, length: int = 10, world: Sequence[str] = ()) -> DataFrame:
    """One hop of fall_levels in whole numbers. Adds ``fallen``: what the nearest of the sources at most ``length`` rows above leaves after linear fading, with no solid cell
    between. ``cells (x, y, level, is_solid)``: a cell with a level is a source."""
    w = Window.partitionBy(*world, "x").orderBy("y").rangeBetween(-length, -1)
    source = F.max(F.when((F.col("level") > 0) & ~F.col("is_solid"), F.struct("y", "level"))).over(w)
    solid = F.max(F.when(F.col("is_solid"), F.col("y"))).over(w)
    marked = cells.withColumns({"_s": source, "_b": solid})
    apart = F.col("y") - F.col("_s.y")
    fading = F.floor(F.col("_s.level") * (length + 1 - apart) / F.lit(length + 1))
    open_ = F.col("_s").isNotNull() & (F.col("_b").isNull() | (F.col("_b") < F.col("_s.y"))) & ~F.col("is_solid") & (F.col("level") == 0)
    return marked.withColumn("fallen", F.when(open_, fading).otherwise(F.lit(0).cast("long"))).drop("_s", "_b")


FALL_CELL = "struct<seed: float, total: float, kind: int, hard: boolean>"
FALL_STATE = f"struct<last: bigint, above: array<{FALL_CELL}>, out: array<struct<fallen: float, kind: int, opacity: float>>>"


def _weights(lengths: Mapping[int, int]) -> str:
    """SQL of the weights by kind and distance: one less one equal step a row, each rounded to single precision."""
    rows = []
    for kind in range(max(lengths, default=0) + 1):
        weight, out = np.float32(1), []
        step = np.float32(1 / (lengths[kind] + 1)) if kind in lengths else None
        for _ in range(lengths.get(kind, 0)):
            weight = np.float32(weight - step)
            out.append(f"float('{weight}')")
        rows.append(f"array({', '.join(out)})" if out else "cast(array() AS array<float>)")
    return f"array({', '.join(rows)})"


def fall_levels(cells: DataFrame, lengths: Mapping[int, int] = FALL_LENGTH, world: Sequence[str] = (), rows: int = FALL_ROWS) -> DataFrame:
    """Chained falls. Adds ``fallen`` (0 to 1, single precision), ``fall_kind`` and ``opacity``.

    Every cell with a seed is a source for the ``lengths`` (by kind) rows under it, down to the first solid; what it gives is its own
    level, with what it got from above, times a weight that falls in equal steps. A cell has the largest of its seed and of all
    that it is given. An empty cell has the kind and the weight of the nearest source, other cells have their own kind and weight
    1. Solid cells that aren't full are at level 1 with opacity 0 and give nothing; a full seed takes nothing.

    ``cells (world, x, y, liquid, level, is_solid, full)`` with the seed ``level`` (0 to 1) and ``liquid``, its kind (see bridge_levels). A hole stops
    falls. What a cell gives depends on all above it, so this is a scan, in bands of ``rows`` rows: each is folded in the JVM, first as if nothing fell into
    it, then again with what the band above hands on (its last rows that still give), as long as that changes. A solid, a full cell or a few rows without
    a seed end what is handed on, so there are few rounds, and no column is in one task.
    """
    reach = max(lengths.values(), default=0)
    keys = [*world, "x", "_band"]
    names = ["y", *[c for c in cells.columns if c not in {*world, "x", "y"}]]
    own = F.floor(F.col("y") / F.lit(rows)).alias("_band")
    bands = stored(cells.select(*world, "x", own, F.struct(*names).alias("_c")).groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_cells")))
    hits = (
        "filter(transform(slice(above, 1, coalesce(nullif(array_position(transform(above, a -> a.hard), true), 0), size(above))),"
        f" (a, i) -> struct(cast(a.total * get(get({_weights(lengths)}, a.kind), i) AS float) AS v, get(get({_weights(lengths)}, a.kind), i) AS w, a.kind AS k, a.seed AS seed)), h -> h.seed > 0 AND h.w IS NOT NULL)"
    )
    fall = "IF(shut, float(1), IF(seed = 1, seed, greatest(seed, array_max(transform(hits, h -> h.v)))))"
    lent = "NOT shut AND seed = 0 AND size(hits) > 0"
    made = f"struct({fall} AS fallen, IF({lent}, hits[0].k, c.liquid) AS kind, IF(shut, float(0), IF({lent}, hits[0].w, IF(seed <> 0, float(1), float(0)))) AS opacity)"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    after = f"cast(struct(c.y AS last, slice(concat(array(struct(IF(shut, float(0), seed) AS seed, m.fallen AS total, c.liquid AS kind, c.is_solid AS hard)), above), 1, {max(reach, 1)}) AS above, concat(s.out, array(m)) AS out) AS {FALL_STATE})"
    step = let("above", f"IF(s.last = c.y - 1, s.above, cast(array() AS array<{FALL_CELL}>))", let("seed", "cast(c.level AS float)", let("shut", "c.is_solid AND NOT c.full", let("hits", hits, let("m", made, after)))))
    folded = F.expr(f"aggregate(_cells, cast(struct(_band * {rows} - 1 AS last, _in AS above, array() AS out) AS {FALL_STATE}), (s, c) -> {step})")
    # what still gives below a band: its last rows down to the first solid, if any of them is a source
    gives = "transform(slice(above, 1, coalesce(nullif(array_position(transform(above, a -> a.hard), true), 0), size(above))), a -> a)"
    handed = f"IF(_s.last = (_band + 1) * {rows} - 1 AND exists({gives.replace('above', '_s.above')}, a -> a.seed > 0), _s.above, cast(array() AS array<{FALL_CELL}>))"
    run = lambda df: df.withColumn("_s", folded).select(*keys, "_in", F.col("_s.out").alias("_out"), F.expr(handed).alias("_on"))
    nothing = F.expr(f"cast(array() AS array<{FALL_CELL}>)")
    done = stored(run(bands.withColumn("_in", nothing)))
    while True:
        into = done.where("size(_on) > 0").select(*world, "x", (F.col("_band") + 1).alias("_band"), F.col("_on").alias("_now"))
        due = done.drop("_out", "_on").join(into, keys, "left").where(~F.coalesce("_now", nothing).eqNullSafe(F.col("_in"))).select(*keys, F.coalesce("_now", nothing).alias("_in"))
        again = stored(run(bands.join(due, keys)))
        if again.isEmpty():
            discard(again)
            break
        last, done = done, stored(done.join(again.select(*keys), keys, "left_anti").unionByName(again))
        discard(last, again)
    both = bands.join(done.select(*keys, "_out"), keys).select(*world, "x", F.explode(F.arrays_zip("_cells", "_out")).alias("_z"))
    added = [F.col("_z._out.fallen").alias("fallen"), F.col("_z._out.kind").alias("fall_kind"), F.col("_z._out.opacity").alias("opacity")]
    return both.select(*[F.col(c) if c in {*world, "x"} else F.col(f"_z._cells.{c}").alias(c) for c in cells.columns], *added)


def smooth121(cells: DataFrame, value: str, axis: str = "y", world: Sequence[str] = ()) -> DataFrame:
    """Adds ``smooth``: (2v + a + b) / 4 along an axis where both neighbours are there, else v."""
    other = "x" if axis == "y" else "y"
    w = Window.partitionBy(*world, other).orderBy(axis)
    both = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lead(axis).over(w) == F.col(axis) + 1)
    mean = (F.col(value) * 2 + F.lag(value).over(w) + F.lead(value).over(w)) / F.lit(4.0)
    return cells.withColumn("smooth", F.when(both, mean).otherwise(F.col(value).cast("double")))


def fade(paths: DataFrame, origin: Sequence[str], step: str, tail: int = 10) -> DataFrame:
    """Adds ``opacity``: 1, falling in equal parts over the last ``tail`` steps of each path."""
    last = F.max(step).over(Window.partitionBy(*origin))
    return paths.withColumn("opacity", F.least(F.lit(1.0), (last - F.col(step) + 1) / F.lit(float(tail))))


def phase_delta(samples: DataFrame, run: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``delta`` (from the sample before) and ``peak`` (so far) of a value in each run."""
    w = Window.partitionBy(*run).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumns({"delta": F.col(value) - F.lag(value).over(w), "peak": F.max(value).over(so_far)})


def top_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``place``; Spark limits each partition before the exchange."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


