"""The flagship: plan draw commands for every cell, and account for each that isn't drawn."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.scalars import asset_name
from gridspark.operators.joins import frame_lookup, with_masks
from gridspark.operators.order import draw_order
from gridspark.operators.project import supported, visible_block
from gridspark.operators.runs import expand_runs
from gridspark.plans import planner
from gridspark.sources import facts, views
from gridspark.sources.worlds import ingest_worlds

#: Families that are planned, as a mask, and reasons that don't count as unsupported.
PLANNED_FAMILIES = 3
QUIET = ("invisible", "hidden")


@dataclass(frozen=True)
class Plan:
    """All cells with their reason (null: planned), the commands, and the omissions that count."""

    cells: DataFrame
    commands: DataFrame
    omissions: DataFrame


def plan(cells: DataFrame, dim: DataFrame, world: Sequence[str] = (), hidden: Column | None = None, bad_shape: Column | None = None) -> Plan:
    """Commands of the ordinary tiles of ``cells (world, x, y, kind, level)`` by type facts and 4-masks; every other cell has a reason. ``hidden`` and
    ``bad_shape`` say which cells aren't shown or can't be drawn (None: none). The planner of world files' cells is in planner.py."""
    facts = dim.select("kind", "layer", "family_mask")
    known = with_masks(cells, {"mask": F.col("kind") >= 0}, world).join(facts, "kind", "left")
    no = F.lit(False)
    reason = (
        F.when(F.col("kind") == -1, "invisible")
        .when(no if hidden is None else hidden, "hidden")
        .when(F.col("layer").isNull(), "unknown layer")
        .when(F.col("family_mask").bitwiseAND(PLANNED_FAMILIES) == 0, "unsupported family")
        .when(no if bad_shape is None else bad_shape, "unsupported shape")
    )
    judged = known.withColumns({"reason": reason, "asset": asset_name(F.lit("tile"), F.col("kind") + 3), "sx": F.col("mask") % 4 * 18, "sy": F.floor(F.col("mask") / F.lit(4)).cast("int") * 18})
    commands = judged.where("reason is null").select(*world, "x", "y", "asset", "layer", "sx", "sy")
    omissions = judged.where(F.col("reason").isNotNull() & ~F.col("reason").isin(*QUIET)).select(*world, "x", "y", "kind", "reason")
    return Plan(judged, commands, omissions)


def numbered(commands: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Commands with ``seq``, their place in their world's drawing order."""
    phase = F.when(F.col("layer") == "solid", "solid tile").otherwise("non-solid tile")
    keyed = planner.numbered(draw_order(commands, phase, ["x", "y"]), world)
    return keyed.select(*world, "x", "y", "asset", "layer", "sx", "sy", "seq")


def audit(cells: DataFrame, dim: DataFrame, assets: DataFrame, **rules: Column) -> DataFrame:
    """Exact accounting of each world of ``cells (world_id, x, y, kind, level)``, whose grids may overlap: visible, planned, hidden,
    unsupported, missing, invalid, rendered, and whether it balances. ``rules``: see plan."""
    judged = plan(cells, dim, ["world_id"], **rules).cells.join(assets, "asset", "left")
    missing = F.col("width").isNull()
    invalid = ~missing & ((F.col("sx") + 16 > F.col("width")) | (F.col("sy") + 16 > F.col("height")))
    planned = F.col("reason").isNull()
    count = lambda p, name: F.count_if(F.coalesce(p, F.lit(False))).alias(name)
    totals = judged.groupBy("world_id").agg(
        F.count_if(~F.col("reason").eqNullSafe("invisible")).alias("visible"), count(planned, "planned"), count(F.col("reason") == "hidden", "hidden"),
        count(F.col("reason").isNotNull() & ~F.col("reason").isin(*QUIET), "unsupported"), count(planned & missing, "missing"), count(planned & invalid, "invalid"),
    )
    rest = F.col("planned") - F.col("missing") - F.col("invalid")
    return totals.withColumn("rendered", rest).withColumn("balanced", F.col("visible") == F.col("planned") + F.col("hidden") + F.col("unsupported"))


#: The assets at hand in the audit query: name, width, height.
ASSETS = [("tile_1.png", 72, 72), ("tile_4.png", 60, 72)]


def view_rules() -> dict[str, Column]:
    """What the test view's levels stand for: cells that aren't shown, and shapes that can't be drawn."""
    return {"hidden": F.col("level") % 13 == 0, "bad_shape": F.col("level") % 17 == 0}


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the dense grid, in worlds of 100 columns each."""
    cells = views.g_dense(spark, sf_dir).withColumn("world_id", F.expr("x div 100"))
    return audit(cells, views.d_kind(spark), spark.createDataFrame(ASSETS, "asset string, width int, height int"), **view_rules())


def overlapping_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the same grid cut into worlds of 100 columns that all begin at column 0."""
    cells = views.g_dense(spark, sf_dir).withColumn("world_id", F.expr("x div 100")).withColumn("x", F.expr("x % 100"))
    return audit(cells, views.d_kind(spark), spark.createDataFrame(ASSETS, "asset string, width int, height int"), **view_rules())




def audit_cells(cells: DataFrame, assets: DataFrame) -> DataFrame:
    """Accounting of the tiles of ingested worlds, by ``world_id``: ``cells`` have the fields of tiles, ``assets (asset, width, height)``.

    Visible cells are planned, hidden (types that are never drawn) or unsupported. Ordinary blocks take the frame of their 4-mask
    from ``Tiles_<type>.png``, which may be missing or too small for it; the rest is rendered.
    """
    spark = cells.sparkSession
    shown = visible_block(F.col("active"), F.col("invisible_block"))
    facts_of = facts.families(spark)
    known = with_masks(cells, {"mask": shown}, ["world_id"]).join(facts_of, "type", "left").where(shown)
    ok = supported(F.col("shape"), F.col("frame_x"), F.col("frame_y"), facts.conditional_type(F.col("type")), F.col("stored"), F.col("ordinary") | (F.col("type") == 353))
    hidden = F.col("type").isin(*planner.EMITTERS)
    state = F.when(hidden, "hidden").when(ok, "planned").otherwise("unsupported")
    block = (state == "planned") & F.col("ordinary") & F.col("frame_x").isNull()
    judged = frame_lookup(known.withColumns({"state": state, "asset": F.when(block, asset_name(F.lit("Tiles"), F.col("type")))}), facts.block_frames(spark)).join(assets, "asset", "left")
    missing = F.col("asset").isNotNull() & F.col("width").isNull()
    invalid = F.coalesce((F.col("sx") + 16 > F.col("width")) | (F.col("sy") + 16 > F.col("height")), F.lit(False))
    counts = [F.count_if(F.col("state") == name).alias(name) for name in ("planned", "hidden", "unsupported")]
    totals = judged.groupBy("world_id").agg(F.count("*").alias("visible"), *counts, F.count_if(missing).alias("missing"), F.count_if(invalid).alias("invalid"))
    rest = F.col("planned") - F.col("missing") - F.col("invalid")
    return totals.withColumn("rendered", rest).withColumn("balanced", F.col("visible") == F.col("planned") + F.col("hidden") + F.col("unsupported"))


def audit_files(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """From world files to the accounting of their tiles; a file that breaks the format is an error."""
    _, runs, _ = ingest_worlds(spark, path, mode="failfast")
    return audit_cells(expand_runs(runs), assets)


def report_of_files(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """From world files to all reports of the planner's entries (see planner.audit_report)."""
    _, runs, _ = ingest_worlds(spark, path, mode="failfast")
    return planner.audit_report(planner.plan_cells(named_as_planned(expand_runs(runs)), ["world_id"]), assets)


def named_as_planned(cells: DataFrame) -> DataFrame:
    """Cells of world files with the planner's names: a liquid's amount is its level, its kind the liquid."""
    return cells.withColumnsRenamed({"liquid": "level", "liquid_kind": "liquid"})
