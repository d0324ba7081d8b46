"""Cells and runs as Parquet, partitioned by chunk column; synthetic grids; chunk manifests and fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.project import assign_chunk


def formula_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A synthetic grid of any size: kinds and levels by formula, no file."""
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / F.lit(width)).alias("y"))
    return cells.select("x", "y", ((F.col("x") * 7 + F.col("y") * 13) % 5).alias("kind"), ((F.col("x") + F.col("y")) % 256).alias("level"))


def write_grid(df: DataFrame, path: str, chunk: int = 128, mode: str = "errorifexists") -> None:
    """Cells or runs partitioned by world and chunk column, sorted inside, so that scans prune by folder and skip by min and max."""
    df = df if "world_id" in df.columns else df.withColumn("world_id", F.lit("0"))
    marked = df.withColumn("cx", F.floor(F.col("x") / F.lit(chunk)))
    low = "y" if "y" in df.columns else "y0"
    marked.repartition("world_id", "cx").sortWithinPartitions("world_id", "cx", "x", low).write.mode(mode).partitionBy("world_id", "cx").parquet(path)


def read_grid(spark: SparkSession, path: str, x: int | None = None, width: int | None = None, chunk: int = 128) -> DataFrame:
    """Cells or runs of a written grid; the columns' chunks of [x, x + width) alone, if given."""
    df = spark.read.parquet(path)
    if x is not None and width is not None:
        df = df.where(F.col("cx").between(x // chunk, (x + width - 1) // chunk) & (F.col("x") >= x) & (F.col("x") < x + width))
    return df


#: Side of the squares that zoned files are ordered by, rows of a row group, and of a file.
SQUARE, GROUP_ROWS, FILE_ROWS = 128, 16_384, 2_000_000
#: Files that a read names one by one; more are left to the scan's own pruning.
MOST_FILES = 2_000


def square_order(x: Column, y: Column, square: int = SQUARE) -> Column:
    """Place of a cell's square on the Z-order curve: the bits of its column and row by turns (16 of each; beyond them places repeat)."""
    part = lambda c: _spread(F.floor(c / F.lit(square)).bitwiseAND(0xFFFF))
    return part(x).bitwiseOR(F.shiftleft(part(y), 1))


def _spread(v: Column) -> Column:
    """A number's 16 bits, each before a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def write_zoned(cells: DataFrame, path: str, kind: str = "kind", square: int = SQUARE) -> DataFrame:
    """Cells in files ordered along a Z-order curve of squares, and their zone map, which is returned: one row a file with world_id, cells, the bounds of x and y,
    and the kinds in it.

    Squares next to each other lie next to each other in a file, so a rectangle is in few files, and in few row groups of them (GROUP_ROWS rows: about one
    square). The map is made from what was written. An existing path is an error.
    """
    spark = cells.sparkSession
    df = cells if "world_id" in cells.columns else cells.withColumn("world_id", F.lit("0"))
    order = ["world_id", "_z", "x", "y"]
    placed = df.withColumn("_z", square_order(F.col("x"), F.col("y"), square)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order[:2]).sortWithinPartitions(*order).drop("_z")
    placed.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{path}/cells")
    bounds = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))]
    zones = spark.read.parquet(f"{path}/cells").groupBy(F.col("_metadata.file_path").alias("file"), "world_id").agg(F.count("*").alias("cells"), *bounds, F.sort_array(F.collect_set(kind)).alias("kinds"))
    zones.coalesce(1).write.parquet(f"{path}/zones")
    return spark.read.parquet(f"{path}/zones")


def zoned_files(spark: SparkSession, path: str, x: int, y: int, width: int, height: int, world_id=None, kinds: Sequence | None = None) -> DataFrame:
    """Rows of the zone map of the files that a rectangle (and a world, and any of some kinds) may be in."""
    zones = spark.read.parquet(f"{path}/zones").where((F.col("min_x") < x + width) & (F.col("max_x") >= x) & (F.col("min_y") < y + height) & (F.col("max_y") >= y))
    if world_id is not None:
        zones = zones.where(F.col("world_id") == world_id)
    if kinds is not None:
        zones = zones.where(F.arrays_overlap("kinds", F.array(*map(F.lit, kinds))))
    return zones


def read_zoned(spark: SparkSession, path: str, x: int, y: int, width: int, height: int, world_id=None, kinds: Sequence | None = None, kind: str = "kind") -> DataFrame:
    """The cells of a rectangle. The zone map says which files are opened, up to MOST_FILES of them; of the rest, and inside files, row groups are
    skipped by their minima and maxima."""
    names = [r.file for r in zoned_files(spark, path, x, y, width, height, world_id, kinds).select("file").distinct().limit(MOST_FILES + 1).collect()]
    schema = spark.read.parquet(f"{path}/cells").schema
    df = spark.read.schema(schema).parquet(*(names if 0 < len(names) <= MOST_FILES else [f"{path}/cells"]))
    if not names:
        return df.limit(0)
    df = df.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))
    df = df if world_id is None else df.where(F.col("world_id") == world_id)
    return df if kinds is None else df.where(F.col(kind).isin(*kinds))


def heights_of(runs: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Height and number of runs of each column."""
    return runs.groupBy(*world, "x").agg(F.sum("run_len").cast("int").alias("height"), F.count("*").alias("runs"))


def chunk_manifest(cells: DataFrame, width: int, height: int, world: Sequence[str] = ()) -> DataFrame:
    """One row a chunk (of a world): cx, cy, cells, bounds, and ``content_hash`` and ``content_sum``, which don't depend on the order of rows; a row and
    its copy cancel each other in the hash, but not in the sum (a decimal: it doesn't overflow)."""
    row = F.xxhash64(*sorted(cells.columns))
    content = F.bit_xor(row).alias("content_hash"), F.sum(F.shiftrightunsigned(row, 24).cast("decimal(20,0)")).alias("content_sum")
    at = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]
    return assign_chunk(cells, width, height).groupBy(*world, "cx", "cy").agg(F.count("*").alias("cells"), *at, *content)


def write_chunked(cells: DataFrame, path: str, width: int = 128, height: int = 128, world: Sequence[str] = ()) -> DataFrame:
    """One folder a chunk (of a world), and the manifest of what was written. An existing path is an error; only complete writes are committed."""
    keys = [*world, "cx", "cy"]
    assign_chunk(cells, width, height).repartition(*keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)
    written = cells.sparkSession.read.parquet(path).drop("cx", "cy").select(*cells.columns)
    return chunk_manifest(written, width, height, world)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines; an existing path is an error."""
    df.write.mode("errorifexists").json(path)
