"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark.operators import aggs, joins, runs
from gridspark.plans import audit
from gridspark.plans.registry import QUERIES, load
from gridspark.sources import views
from gridspark.sources.grids import formula_grid

HEADLINE = [
    "rle02_compress_cells", "rle03_lookup_points", "prj01_region", "jn03_neighbors4", "jn07_rect_overlap", "ag01_inventory", "ag12_overview_levels", "ag13_last_touch",
    "ag16_summed_area", "wn06_fall_levels_chained", "dm01_terrain_masks", "dm05_detect_sources", "dm07_trace_paths", "dm10_plan_commands", "dm11_audit", "dm14_query_viewports",
]
#: Cells of the reference workload: 8400 columns of 2400.
WIDTH, HEIGHT = 8400, 2400


def whole_grid(spark: SparkSession) -> dict:
    """Jobs over a formula grid of 20,160,000 cells, as many as the published workload has."""
    cells = formula_grid(spark, WIDTH, HEIGHT)
    world = cells.withColumn("kind", (F.col("kind") - 3).cast("int"))
    pixels = cells.selectExpr("x", "y", "level AS r", "level * 3 % 256 AS g", "level * 7 % 256 AS b", "CASE WHEN kind > 0 THEN 255L ELSE level END AS a")
    dim = views.d_kind(spark)
    return {
        "grid20m_compress": lambda: runs.compress_cells(cells, ["kind"]),
        "grid20m_counters": lambda: aggs.support_counters(cells, {"active": F.expr("kind > 1"), "bright": F.expr("level > 128")}, ["kind"]),
        "grid20m_region": lambda: cells.where("x >= 4000 AND x < 4128 AND y >= 400 AND y < 528"),
        "grid20m_neighbors4": lambda: joins.neighbors4(cells, F.col("kind") > 1),
        "grid20m_area_reduce": lambda: aggs.area_reduce(pixels, 16),
        "grid20m_audit": lambda: audit.audit(world.withColumn("world_id", F.lit(0)), dim, spark.createDataFrame(audit.ASSETS, "asset string, width int, height int")),
    }


def timed(make) -> float:
    began = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    timed(lambda: QUERIES["ag04_sorted_counts"](spark, sf_dir))  # starts the session
    took = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    took |= {name: timed(make) for name, make in whole_grid(spark).items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cells_per_second": round(WIDTH * HEIGHT / took["grid20m_counters"])}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
