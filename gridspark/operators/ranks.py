"""Places in a total order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def with_place(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name`` (a long): each row's place (from 0) among those with the same ``by``, in the order of the columns, which must be unique.

    Ranges of the order are sorted apart; each starts where those before it end. The ranges are written to the shared folder first,
    so that counting and numbering see the same ones; no window holds more than a range, or one row a range. The written ranges stay as long as the
    result may be read.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}_") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    placed = ranges.withColumn("_own", own).join(starts, same)
    return placed.withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start", "_at", *[f"_{c}_" for c in by])
