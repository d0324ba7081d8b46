"""Aggregations: inventories, coverage, area reduction, hidden commands, dictionaries, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_place


def inventory(runs: DataFrame, by: Sequence[str], counters: Mapping[str, Column] | None = None) -> DataFrame:
    """Cells, weighted by run length, for each value of ``by``; runs are never expanded. ``counters``: conditions to count."""
    sums = [F.sum(F.when(p, F.col("run_len")).otherwise(0)).alias(name) for name, p in (counters or {}).items()]
    return runs.groupBy(*by).agg(F.sum("run_len").alias("cells"), *sums)


def inventory_cube(runs: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """The inventories of several sets of columns in one pass, with ``gid`` (a bit for each column that is summed over)."""
    grouped = runs.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns))
    return grouped.agg(F.grouping_id().cast("int").alias("gid"), F.sum("run_len").alias("cells"))


def support_counters(cells: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """All counters in one aggregate; null conditions don't count."""
    return cells.groupBy(*by).agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in conditions.items()])


def sorted_counts(df: DataFrame, key: str) -> DataFrame:
    """Key and count, largest first, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def coverage_mask(omissions: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """Bit-or of the reason codes of each cell."""
    return omissions.groupBy(*keys).agg(F.bit_or("code").alias("code"))


def coverage_histogram(cells: DataFrame, omissions: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """Number of cells for each combined code, 0 for those without any."""
    coded = cells.select(*keys).join(coverage_mask(omissions, keys), list(keys), "left")
    return coded.groupBy(F.coalesce("code", F.lit(0)).alias("code")).agg(F.count("*").alias("cells"))


def first_example(rows: DataFrame, by: Sequence[str], chunk: int = 128) -> DataFrame:
    """The first coordinate of each group in the order of chunks, then columns."""
    where = F.struct(F.floor(F.col("x") / F.lit(chunk)), F.floor(F.col("y") / F.lit(chunk)), "x", "y")
    first = rows.groupBy(*by).agg(F.min_by(F.struct("x", "y"), where).alias("_first"), F.count("*").alias("n"))
    return first.select(*by, F.col("_first.x").alias("x"), F.col("_first.y").alias("y"), "n")


def bounding_box(cells: DataFrame, predicate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Smallest rectangle of the cells that match; nulls where none does."""
    at = lambda f, c: f(F.when(predicate, F.col(c)))
    return cells.groupBy(*by).agg(at(F.min, "x").alias("min_x"), at(F.min, "y").alias("min_y"), at(F.max, "x").alias("max_x"), at(F.max, "y").alias("max_y"))


def reconcile(totals: DataFrame, whole: str, parts: Sequence[str]) -> DataFrame:
    """Adds ``difference`` (whole less the parts) and ``balanced``; null parts count as zero."""
    rest = F.col(whole)
    for p in parts:
        rest = rest - F.coalesce(F.col(p), F.lit(0))
    return totals.withColumn("difference", rest).withColumn("balanced", rest == 0)


def exact_cover(pieces: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that ``pieces (x, y, width, height)`` cover not exactly once: x, y, times (0: a hole). Pieces without width or height cover nothing; repeated
    cells are one.

    Cells and pieces become words (64 cells of a column as bits) before they meet, and only words that aren't covered exactly once are looked into. Pieces are
    dealt out before they are spread, as few of them may stand for many cells. A word has 2,080 different parts at most, so its list is bounded.
    """
    deal = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("width > 0 AND height > 0").selectExpr("CAST(x AS BIGINT) AS x", "CAST(y AS BIGINT) AS y0", "x + width - 1L AS x1", "y + height - 1L AS y1").repartition(deal, "x", "y0")
    spread = dealt.withColumn("x", F.expr("explode(sequence(x, x1))")).withColumn("_band", F.expr("explode(sequence(shiftright(y0, 6), shiftright(y1, 6)))"))
    low, high = "greatest(y0 - _band * 64, 0L)", "least(y1 - _band * 64, 63L)"
    parts = spread.withColumn("mask", F.expr(f"shiftleft(shiftrightunsigned(-1L, CAST(63 - {high} + {low} AS INT)), CAST({low} AS INT))")).groupBy("x", "_band", "mask").agg(F.count("*").alias("n"))
    covered = parts.groupBy("x", "_band").agg(F.bit_or("mask").alias("_any"), F.expr("sum(n * bit_count(mask))").alias("_total"), F.collect_list(F.struct("mask", "n")).alias("_parts"))
    bit = F.expr("shiftleft(1L, CAST(y & 63 AS INT))")
    there = cells.select(F.col("x").cast("long").alias("x"), F.expr("shiftright(CAST(y AS BIGINT), 6)").alias("_band"), bit.alias("_bit")).groupBy("x", "_band").agg(F.bit_or("_bit").alias("_here"))
    words = there.join(covered, ["x", "_band"], "full_outer").where("NOT (_here <=> _any AND _total = bit_count(_any))")
    times = "aggregate(coalesce(_parts, array()), 0L, (n, p) -> n + IF(getbit(p.mask, k) = 1, p.n, 0L))"
    odd = f"filter(transform(sequence(0, 63), k -> struct(k, coalesce(getbit(_here, k) = 1, false) AS there, {times} AS times)), c -> c.times > 1 OR (c.times = 0 AND c.there))"
    return words.select("x", "_band", F.expr(f"explode({odd})").alias("c")).select("x", (F.col("_band") * 64 + F.col("c.k")).alias("y"), "c.times")


def _mean_colour(keys: Sequence[Column]) -> list[Column]:
    a = F.sum("a")
    mean = lambda c: F.when(a > 0, F.expr(f"(sum({c} * a) + sum(a) div 2) div sum(a)")).otherwise(0).cast("long").alias(c)
    return [mean("r"), mean("g"), mean("b"), F.expr("(sum(a) + count(*) div 2) div count(*)").cast("long").alias("a")]


def area_reduce(pixels: DataFrame, factor: int) -> DataFrame:
    """Alpha-weighted mean of each block of factor by factor pixels, halves rounded up, in integers only."""
    keys = [F.floor(F.col(c) / F.lit(factor)).alias(c) for c in ("x", "y")]
    return pixels.groupBy(*keys).agg(*_mean_colour(keys))


def overview_levels(pixels: DataFrame, factors: Sequence[int]) -> DataFrame:
    """Several reductions at once, by ``factor``; the pixels are shuffled once, already summed."""
    spread = pixels.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    keys = ["factor", F.floor(F.col("x") / F.col("factor")).alias("x"), F.floor(F.col("y") / F.col("factor")).alias("y")]
    return spread.groupBy(*keys).agg(*_mean_colour(keys))


def covered_cells(commands: DataFrame, size: int = 16) -> DataFrame:
    """A row for each output cell of ``size`` pixels that a command's rectangle touches: cell_x, cell_y and its columns."""
    cells = lambda at, n: F.explode(F.sequence(F.floor(F.col(at) / F.lit(size)), F.floor((F.col(at) + F.col(n) - 1) / F.lit(size))))
    return commands.where("dw > 0 and dh > 0").withColumn("cell_x", cells("dx", "dw")).withColumn("cell_y", cells("dy", "dh"))


def last_touch(commands: DataFrame, columns: Sequence[str] = ("asset",), size: int = 16) -> DataFrame:
    """The top-most command of each output cell: cell_x, cell_y, seq and its columns."""
    top = covered_cells(commands, size).groupBy("cell_x", "cell_y").agg(F.max(F.struct("seq", *columns)).alias("_top"))
    return top.select("cell_x", "cell_y", "_top.seq", *[F.col(f"_top.{c}").alias(c) for c in columns])


def fully_covered(commands: DataFrame, safe: DataFrame, size: int = 16) -> DataFrame:
    """seq of the commands whose every cell is in ``safe (cell_x, cell_y)``."""
    cells = covered_cells(commands.select("seq", "dx", "dy", "dw", "dh"), size)
    marked = cells.join(safe.select("cell_x", "cell_y").distinct().withColumn("_safe", F.lit(True)), ["cell_x", "cell_y"], "left")
    return marked.groupBy("seq").agg(F.bool_and(F.coalesce("_safe", F.lit(False))).alias("_all")).where("_all").select("seq")


def compose(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered source-over of premultiplied ``samples (seq, value, alpha)``: value and alpha of each key.

    Under a sample of alpha a, what is there keeps round(t * (255 - a) / 255); sums stop at 255. An opaque sample leaves nothing of those under it, so
    they are cut before any list is made: a key's list holds its last opaque sample and the translucent ones above it.
    """
    own = Window.partitionBy(*keys)
    opaque = F.max(F.when(F.col("alpha") >= 255, F.col("seq"))).over(own)
    seen = samples.select(*keys, "seq", "value", "alpha", opaque.alias("_opaque")).where(F.col("_opaque").isNull() | (F.col("seq") >= F.col("_opaque")))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "value", "alpha")))
    keep = lambda t, a: F.floor((t * (255 - a) * 2 + 255) / F.lit(510))
    zero = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("alpha"))
    step = lambda t, s: F.struct(F.least(F.lit(255), s["value"] + keep(t["value"], s["alpha"])).cast("long").alias("value"), F.least(F.lit(255), s["alpha"] + keep(t["alpha"], s["alpha"])).cast("long").alias("alpha"))
    out = seen.groupBy(*keys).agg(F.aggregate(ordered, zero, step).alias("_out"))
    return out.select(*keys, F.col("_out.value").alias("value"), F.col("_out.alpha").alias("alpha"))


#: Side of the chunks that prefix sums are made in.
SUM_CHUNK = 256


def summed_area(cells: DataFrame, value: str, world: Sequence[str] = (), chunk: int = SUM_CHUNK) -> DataFrame:
    """Two-dimensional prefix sums of a dense grid: ``total`` of all cells up to and with (x, y).

    Two levels: sums inside chunks, and what lies above, left and above left of a chunk, from its edges. Cells are shuffled to their chunks once; the
    edges' tables are a ``chunk``-th of the grid, and come back to a chunk as one row of two arrays, by place from the chunk's first column
    and row. No window holds more than a chunk's row, or one place of a row of chunks.
    """
    keys = [*world, "_cx", "_cy"]
    here = cells.select(*world, "x", "y", F.col(value).alias("_v"), F.floor(F.col("x") / F.lit(chunk)).alias("_cx"), F.floor(F.col("y") / F.lit(chunk)).alias("_cy"))
    upto = lambda by, order: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = here.repartition(*keys).withColumn("_down", F.sum("_v").over(upto(["x"], "y"))).withColumn("_own", F.sum("_down").over(upto(["y"], "x")))

    def edge(along: str, chunk_along: str, chunk_across: str, name: str) -> DataFrame:
        """By chunk: for each place along an axis, the sum of all cells of the same stripe of chunks before the chunk, up to that place."""
        line = here.groupBy(*keys, along).agg(F.sum("_v").alias("_s"))
        upto_here = line.withColumn("_s", F.sum("_s").over(Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)))
        before = Window.partitionBy(*world, chunk_along, along).orderBy(chunk_across).rowsBetween(Window.unboundedPreceding, -1)
        summed = upto_here.withColumn("_s", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        return summed.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct({along} AS at, _s AS s))), q -> q.s)").alias(name), F.min(along).alias(f"_first_{name}"))

    total = here.groupBy(*keys).agg(F.sum("_v").alias("_s"))  # one row a chunk
    exclusive = lambda by, order: Window.partitionBy(*world, by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    corner = total.withColumn("_s", F.coalesce(F.sum("_s").over(exclusive("_cx", "_cy")), F.lit(0))).withColumn("_corner", F.coalesce(F.sum("_s").over(exclusive("_cy", "_cx")), F.lit(0))).drop("_s")
    around = edge("x", "_cx", "_cy", "_above").join(edge("y", "_cy", "_cx", "_left"), keys).join(corner, keys)
    added = F.expr("_own + _above[cast(x - _first__above AS int)] + _left[cast(y - _first__left AS int)] + _corner")
    return inner.join(around, keys).select(*world, "x", "y", added.alias("total"))


def rect_count(sums: DataFrame, rects: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Sum of each rectangle (rect_id, rx, ry, rw, rh) from the prefix sums at its four corners, by one equi-join."""
    corners = [("rx + rw - 1", "ry + rh - 1", 1), ("rx - 1", "ry + rh - 1", -1), ("rx + rw - 1", "ry - 1", -1), ("rx - 1", "ry - 1", 1)]
    corner = F.explode(F.array(*[F.struct(F.expr(x).cast("long").alias("x"), F.expr(y).cast("long").alias("y"), F.lit(sign).alias("sign")) for x, y, sign in corners]))
    asked = rects.select(*world, "rect_id", corner.alias("_c")).select(*world, "rect_id", "_c.x", "_c.y", "_c.sign")
    found = asked.join(sums, [*world, "x", "y"], "left")
    return found.groupBy(*world, "rect_id").agg(F.sum(F.coalesce("total", F.lit(0)) * F.col("sign")).alias("total"))


def majority(cells: DataFrame, by: Sequence[str], value: str, precedence: Sequence) -> DataFrame:
    """The value of ``precedence`` with the highest count in each group, ties to the earlier; null if none occurs."""
    counts = F.array(*[F.struct(F.count_if(F.col(value) == v).alias("n"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(precedence)])
    best = cells.groupBy(*by).agg(F.array_max(counts).alias("_best"))
    return best.select(*by, F.when(F.col("_best.n") > 0, F.col("_best.v")).alias("majority"), F.col("_best.n").alias("n"))


def intern_frames(commands: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, commands): distinct frames with a dense id by first use and their number of uses; the commands with ``frame_id``.

    Commands without an order of their own (equal first uses) can't be told apart: seq must be unique.
    """
    frames = commands.groupBy(*columns).agg(F.min("seq").alias("first_seq"), F.count("*").alias("uses"))
    frames = with_place(frames, ["first_seq"], "frame_id")
    match = [F.col(f"_c.{c}").eqNullSafe(F.col(f"_f.{c}")) for c in columns]
    joined = commands.alias("_c").join(frames.alias("_f"), match).select("_c.*", "_f.frame_id")
    return frames, joined


def dictionary_encode(rows: DataFrame, value: str, position: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(palette, ids): distinct values with ids in the order of first appearance, and the rows with ``id`` in place of the value."""
    first = rows.groupBy(*by, value).agg(F.min(position).alias("first_at"))
    palette = with_place(first, ["first_at", value], "id", by)
    match = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_p.{c}")) for c in (*by, value)]
    ids = rows.alias("_r").join(palette.alias("_p"), match).select("_r.*", "_p.id").drop(value)
    return palette, ids


def dictionary_decode(palette: DataFrame, ids: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows with their values again."""
    return ids.join(palette.select(*by, "id", value), [*by, "id"]).drop("id")


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each numeric column: field, distinct, min, max, is_constant, is_integer and the narrowest type."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "field", "v")
    stats = long.groupBy("field").agg(F.count_distinct("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), F.bool_and(F.col("v") == F.floor("v")).alias("is_integer"))
    low, high = F.col("min"), F.col("max")
    narrow = F.when(~F.col("is_integer"), "f64").when((low >= 0) & (high <= 255), "u8").when((low >= -128) & (high <= 127), "i8").when((low >= 0) & (high <= 65535), "u16")
    narrow = narrow.when((low >= -32768) & (high <= 32767), "i16").when((low >= -(2**31)) & (high <= 2**31 - 1), "i32").otherwise("f64")
    return stats.withColumn("is_constant", F.col("distinct") == 1).withColumn("narrowest", narrow)


#: Bits of the distinct sketches' buckets: a relative error of about 1.04 / sqrt(2 ** bits), 1.6 % at 12; and the quantile sketches' size.
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def column_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mergeable profiles of numeric columns: (by..., field, n, nulls, min, max, whole, distinct_sketch, quantile_sketch), to be stored by chunk.

    One pass, in which every task folds all columns of a group side by side; rows aren't multiplied by the columns. NaN counts as a null.
    """
    wide = df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    parts = []
    for c in columns:
        parts += [
            F.count(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.bool_and(F.col(c) == F.floor(c)).alias(f"{c}_whole"),
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT_BITS)).alias(f"{c}_distinct"), F.expr(f"kll_sketch_agg_double(`{c}`, {QUANTILE_SIZE})").alias(f"{c}_quantile"),
        ]
    grouped = wide.groupBy(*by).agg(*parts)
    fields = [F.struct(F.lit(c).alias("field"), *[F.col(f"{c}_{k}").alias(name) for k, name in (("n", "n"), ("nulls", "nulls"), ("min", "min"), ("max", "max"), ("whole", "whole"), ("distinct", "distinct_sketch"), ("quantile", "quantile_sketch"))]) for c in columns]
    return grouped.select(*by, F.explode(F.array(*fields)).alias("f")).select(*by, "f.*")


def profile_of_sketches(sketches: DataFrame, quantiles: Sequence[float] = (0.5,), by: Sequence[str] = ()) -> DataFrame:
    """Profiles from stored sketches alone, of any range of them: (by..., field, n, nulls, min, max, whole, distinct, quantiles). ``distinct`` is an estimate
    (see DISTINCT_BITS), quantiles have a rank error of about 1.3 % at QUANTILE_SIZE; the rest is exact. Fields without values have null quantiles."""
    merged = sketches.groupBy(*by, "field").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("min").alias("min"), F.max("max").alias("max"), F.bool_and("whole").alias("whole"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"), F.expr("kll_merge_agg_double(quantile_sketch)").alias("_q"),
    )
    ranks = f"array({', '.join(f'{q}D' for q in quantiles)})"
    return merged.select(*by, "field", "n", "nulls", "min", "max", "whole", "distinct", F.expr(f"IF(n > 0, kll_sketch_get_quantile_double(_q, {ranks}), NULL)").alias("quantiles"))


def required_assets(commands: DataFrame) -> DataFrame:
    """Assets with their number of commands, sorted."""
    return commands.groupBy("asset").agg(F.count("*").alias("commands")).orderBy("asset")


def count_distinct(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row; the approximate form needs no exchange of the values."""
    return df.agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n"))


def opaque_mean(pixels: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Mean colour of each group, halves rounded up; null where any pixel isn't opaque."""
    mean = lambda c: F.when(F.min("a") == 255, F.expr(f"(sum({c}) + count(*) div 2) div count(*)")).alias(c)
    return pixels.groupBy(*by).agg(mean("r"), mean("g"), mean("b"))


def content_dedupe(blobs: DataFrame, key: str, content: Column) -> DataFrame:
    """Identical contents once: size, sha256, the smallest key and the number of copies."""
    data = content.cast("binary")
    return blobs.groupBy(F.length(data).alias("size"), F.sha2(data, 256).alias("sha256")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
