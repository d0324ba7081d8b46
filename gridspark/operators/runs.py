"""Run-length operators. A run is ``x, y0, run_len`` and the columns that its cells share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a band: runs are found by (column, band).
STRIDE = 16


def y_end() -> Column:
    """The last cell of a run."""
    return F.col("y0") + F.col("run_len") - 1


def expand_runs(runs: DataFrame) -> DataFrame:
    """A row for each cell of each run; empty runs have none."""
    cells = runs.where("run_len > 0").withColumn("y", F.explode(F.sequence(F.col("y0"), y_end())))
    return cells.drop("y0", "run_len")


#: Rows of a column that are sorted together.
BAND_ROWS = 4096


def compress_cells(cells: DataFrame, columns: Sequence[str], world: Sequence[str] = (), rows: int = BAND_ROWS) -> DataFrame:
    """Runs of vertically adjacent cells that agree on ``columns``: the keys, y0, run_len, columns. Nulls agree with nulls.

    Columns are sorted in bands of ``rows``, so that a long one lies in many tasks. In a band only the first and the last cell of a run are
    kept, and each first cell finds its last as the next row. Runs that touch a band's edge, two a band at most, are stitched: by one sort
    of a column's edge runs.
    """
    column = [*world, "x"]
    first = (F.col("y0") == F.col("_band") * rows) | (F.col("y0") + F.col("run_len") == (F.col("_band") + 1) * rows)
    banded = _runs_of(cells.select(*column, "y", *columns, F.floor(F.col("y") / F.lit(rows)).alias("_band")), columns, [*column, "_band"])
    marked = banded.withColumn("_edge", first)
    order = Window.partitionBy(*column).orderBy("y0")
    follows = F.lag(F.col("y0") + F.col("run_len")).over(order) == F.col("y0")
    for c in columns:
        follows &= F.col(c).eqNullSafe(F.lag(c).over(order))
    edges = marked.where("_edge").withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    stitched = edges.groupBy(*column, "_run").agg(F.min("y0").alias("y0"), F.sum("run_len").cast("int").alias("run_len"), *[F.first(c).alias(c) for c in columns])
    names = [*column, "y0", "run_len", *columns]
    return marked.where("NOT _edge").select(*names).unionByName(stitched.select(*names))


def _runs_of(cells: DataFrame, columns: Sequence[str], column: Sequence[str]) -> DataFrame:
    """Runs of the cells of one group of keys each: one sort of every group."""
    order = Window.partitionBy(*column).orderBy("y")

    def agrees(f: Callable[[str], Column], step: int) -> Column:
        same = f("y").over(order) == F.col("y") + step
        for c in columns:
            same &= F.col(c).eqNullSafe(f(c).over(order))
        return F.coalesce(same, F.lit(False))

    ends = cells.withColumns({"_first": ~agrees(F.lag, -1), "_last": ~agrees(F.lead, 1)}).where("_first or _last")
    length = F.when(F.col("_last"), 1).otherwise(F.lead("y").over(order) - F.col("y") + 1).cast("int")
    return ends.withColumn("run_len", length).where("_first").select(*column, F.col("y").alias("y0"), "run_len", *columns)


def band_index(runs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """For each band whose first cell a run covers: the run with ``band``."""
    first, last = F.ceil(F.col("y0") / F.lit(stride)), F.floor(y_end() / F.lit(stride))
    return runs.where(first <= last).withColumn("band", F.explode(F.sequence(first, last)))


def with_bands(runs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Each run once for every band that it touches."""
    return runs.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / F.lit(stride)), F.floor(y_end() / F.lit(stride)))))


def lookup_points(runs: DataFrame, points: DataFrame, world: Sequence[str] = (), stride: int = STRIDE) -> DataFrame:
    """``points (x, y, ...)`` with the columns of the run that covers each; points outside all runs are left out."""
    asked = points.withColumn("band", F.floor(F.col("y") / F.lit(stride)))
    hits = asked.join(with_bands(runs, stride), [*world, "x", "band"])
    return hits.where((F.col("y") >= F.col("y0")) & (F.col("y") <= y_end())).drop("band")


def check_runs(runs: DataFrame, heights: DataFrame | int, world: Sequence[str] = ()) -> DataFrame:
    """Violations: keys, x, y0 (null for a whole column) and reason: not positive, outside, overlap, gap or incomplete.

    ``heights``: one height for all, or a table (world..., height).
    """
    runs = runs.withColumn("height", F.lit(heights)) if isinstance(heights, int) else runs.join(heights, list(world))
    order = Window.partitionBy(*world, "x").orderBy("y0", "run_len")
    before = F.lag(F.col("y0") + F.col("run_len")).over(order)
    reason = (
        F.when(F.col("run_len") <= 0, "not positive")
        .when((F.col("y0") < 0) | (F.col("y0") + F.col("run_len") > F.col("height")), "outside")
        .when(F.col("y0") < F.col("_before"), "overlap")
        .when(F.col("y0") > F.col("_before"), "gap")
    )
    rows = runs.withColumn("_before", before).withColumn("reason", reason).where("reason is not null").select(*world, "x", "y0", "reason")
    total = runs.groupBy(*world, "x").agg(F.sum("run_len").alias("_n"), F.first("height").alias("height")).where("_n <> height")
    return rows.unionByName(total.select(*world, "x", F.lit(None).cast(runs.schema["y0"].dataType).alias("y0"), F.lit("incomplete").alias("reason")))


def clip_runs(runs: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The parts of the runs inside a half-open rectangle, without expanding them."""
    top, bottom = F.greatest(F.col("y0"), F.lit(y)), F.least(F.col("y0") + F.col("run_len"), F.lit(y + height))
    inside = runs.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y0") < y + height) & (F.col("y0") + F.col("run_len") > y))
    return inside.withColumns({"y0": top, "run_len": bottom - top}).where("run_len > 0")
