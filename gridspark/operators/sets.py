"""Set operations on command, omission and file tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layered_union(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers in one table with ``layer`` (place in the list); missing columns are null."""
    marked = [layer.withColumn("layer", F.lit(k)) for k, layer in enumerate(layers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def replace_omissions(base: DataFrame, resolved: DataFrame, failed: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """``base (keys, reason)`` without resolved rows, with the new reason of failed ones; failed rows that it lacks are added once."""
    keys = list(keys)
    new = failed.groupBy(*keys).agg(F.min("reason").alias("_new"))
    kept = base.select(*keys, "reason").join(resolved.select(*keys).distinct(), keys, "left_anti")
    changed = kept.join(new, keys, "left").select(*keys, F.coalesce("_new", "reason").alias("reason"))
    added = new.join(base.select(*keys), keys, "left_anti").join(resolved.select(*keys), keys, "left_anti").select(*keys, F.col("_new").alias("reason"))
    return changed.unionByName(added)


def manifest_vs_actual(manifest: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Files that are on one side only: key and status missing or additional."""
    m, a = manifest.select(key), actual.select(key)
    return m.exceptAll(a).withColumn("status", F.lit("missing")).unionByName(a.exceptAll(m).withColumn("status", F.lit("additional")))


def distinct_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct key with its number of rows and whether it repeats."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("repeated", F.col("rows") > 1)


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
