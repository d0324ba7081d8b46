"""Orders, top-k and budgets. The order of commands is data: a key, never the order of rows in a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_rank

#: Drawing phases, first to last.
PHASES = ("wall", "background liquid", "liquid behind", "non-solid tile", "source", "solid tile behind", "trunk", "solid tile", "foliage", "solid tile above", "foreground liquid")


def column_major(cells: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    return cells.orderBy(*world, "x", "y")


def sorted_files(cells: DataFrame, files: int, world: Sequence[str] = ()) -> DataFrame:
    """Range-partitioned and sorted, for writing: files whose x ranges don't overlap, so that scans skip by min and max."""
    return cells.repartitionByRange(files, *world, "x").sortWithinPartitions(*world, "x", "y")


def draw_order(commands: DataFrame, phase: Column, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``phase_no`` and the sort key ``draw_key``: phase, then keys. Unknown phases come last."""
    number = F.coalesce(F.array_position(F.array(*map(F.lit, PHASES)), phase), F.lit(0))
    number = F.when(number > 0, number - 1).otherwise(F.lit(len(PHASES))).cast("int")
    return commands.withColumn("phase_no", number).withColumn("draw_key", F.struct("phase_no", *keys))


def merge_ordered(owners: DataFrame, specials: DataFrame, key: str) -> DataFrame:
    """Both tables in one, with ``source`` (0 special, 1 owner): sorted by key and source, a special comes right before the owner at the
    same or the next key."""
    a = specials.withColumn("source", F.lit(0))
    return a.unionByName(owners.withColumn("source", F.lit(1)), allowMissingColumns=True).orderBy(key, "source")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return top_rank(df, by, order, k)


def guard_budget(df: DataFrame, most: int, what: str = "rows") -> DataFrame:
    """``df`` itself; an error if it has more than ``most`` rows. Counting stops at the first row too many."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df
