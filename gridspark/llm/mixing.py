"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target in words. Every document of a source is wanted ``r = target / source size`` times: it is
taken ``floor(r)`` times for sure and once more with the inclusion probability ``r - floor(r)``. The cube method's flight
moves these probabilities along vectors that keep both the number of documents and the number of words, until
all but two are 0 or 1. It runs in blocks of each source; what the blocks leave open (two rows each) is grouped
into new blocks, with its documents, until a source has one block left. There the landing decides the last two.

Blocks and their order come from hashes of the rows, and so do the random numbers: reruns agree however the rows
are dealt out. A hot source is only more blocks.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_row

#: Rows of a block, about.
BLOCK = 1024
#: A probability this near to 0 or 1 is decided.
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """One row for each source of ``sized (source, size)``: source, stratum (its place), source_size, target.

    Sources in code point order, null last, weigh ``weights`` in turn. Together they get ``share`` (numerator,
    denominator) of all sizes; none gets more than ``most`` times its size, and what is above goes to the others by weight.
    The two windows without a partition hold one row for each source, never documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("stratum") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    big = lambda c: c.cast("decimal(38,0)")
    full = sources.withColumn("stratum", place).withColumn("weight", weight).withColumn("cap", big(F.col("source_size") * most))
    order = Window.orderBy((F.col("cap") / F.col("weight")), "stratum")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = big(F.sum("source_size").over(every)) * share[0]
    full = full.withColumns({"rank": F.row_number().over(order), "left": total - F.coalesce(F.sum("cap").over(before), F.lit(0)) * share[1], "among": F.sum("weight").over(rest)})
    level = F.col("left").cast("double") / F.col("among").cast("double") / share[1]
    open_ = level * F.col("weight").cast("double") <= F.col("cap").cast("double")
    first = F.min(F.when(open_, F.struct("rank", level.alias("level")))).over(every)
    full = full.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight").cast("double"))
    return full.select("source", "stratum", "source_size", target.alias("target"))


def flight(sizes: list[int], p: list[float], chance: random.Random) -> list[float]:
    """Moves ``p`` until at most two of its values lie between 0 and 1; keeps their sum and their sum weighted by ``sizes``."""
    p = list(p)
    waiting = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS][::-1]
    held: list[int] = []
    while True:
        while waiting and len(held) < 3:
            held.append(waiting.pop())
        if len(held) < 3:
            return p
        a, b, c = held
        way = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(way):
            way = (1, -1, 0)
        up = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in zip(held, way) if w)
        down = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in zip(held, way) if w)
        step = up if chance.random() * (up + down) < down else -down
        for k, w in zip(held, way):
            p[k] += step * w
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = float(round(p[k]))
        held = [k for k in held if EPS < p[k] < 1 - EPS]


def landing(sizes: list[int], p: list[float]) -> list[float]:
    """Decides the few values that are left so that the words, then the documents, stay nearest to their sums."""
    rest = [k for k in range(len(p)) if EPS < p[k] < 1 - EPS]
    if not rest:
        return p
    words, docs = sum(p[k] * sizes[k] for k in rest), sum(p[k] for k in rest)
    best = min(product((0, 1), repeat=len(rest)), key=lambda x: (abs(sum(y * sizes[k] for y, k in zip(x, rest)) - words), abs(sum(x) - docs), x))
    p = list(p)
    for k, x in zip(rest, best):
        p[k] = float(x)
    return p


def _one_block(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_hash", "ascending"), ("_size", "ascending")])
        sizes, p = table["_size"].to_pylist(), table["_p"].to_pylist()
        head = table.slice(0, 1).select(["_stratum", "_blocks", "_level"]).to_pylist()[0]
        p = flight(sizes, p, random.Random(f"{seed}/{head['_level']}/{head['_stratum']}/{table['_hash'][0].as_py()}"))
        if head["_blocks"] == 1:
            p = landing(sizes, p)
        return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, seed: int = 1, size: Column | None = None, source: str = "source", **how) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (the source's) and ``copies`` (how often the mix takes the row).

    ``size`` is the words of ``text`` unless a column is given. Null texts have size 0; the null source is a source like any other; documents of sources without words are taken 0
    times. Rows repeated in full are rows of their own, dealt out to many blocks where they are many. Columns of those four names in the input are replaced; all others stay.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    seen = F.xxhash64(F.lit(seed), *[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    sized = docs.select(whole_row(docs), (word_count(F.col("text")) if size is None else size).alias("size"), F.col(source).alias("_of"), seen.alias("_hash"))
    targets = stored(source_targets(sized.select(F.col("_of").alias("source"), "size"), **how), "targets").withColumnRenamed("source", "_source")
    rows = sized.join(targets, F.col("_of").eqNullSafe(F.col("_source"))).drop("_source", "_of").withColumnRenamed("stratum", "_stratum")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_want", want).withColumn("_sure", F.floor(F.col("_want") + EPS)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_want") - F.col("_sure")))
    rows = rows.withColumn("_size", F.col("size")).drop("_want")
    is_open = (F.col("_p") > EPS) & (F.col("_p") < 1 - EPS)
    settled, level = [rows.where(~is_open)], 0
    rest = rows.where(is_open)
    counts = rest.groupBy("_stratum").agg(F.count("*").alias("_n"))
    rest = _salted(rest)
    while True:
        blocks = counts.select("_stratum", F.ceil(F.col("_n") / F.lit(BLOCK)).alias("_blocks"))
        dealt = rest.join(F.broadcast(blocks) if _few(blocks) else blocks, "_stratum").withColumn("_level", F.lit(level))
        place = F.xxhash64("_hash", F.lit(level)) if level else F.when(F.col("_salt") == 0, F.xxhash64("_hash", F.lit(level))).otherwise(F.xxhash64("_hash", F.lit(level), "_salt"))
        dealt = dealt.withColumn("_block", F.pmod(place, F.col("_blocks")))
        moved = stored(dealt.groupBy("_stratum", "_block").applyInArrow(_one_block(seed), dealt.schema).select(rows.columns), "mixed")
        settled.append(moved.where(~is_open))
        rest, level = moved.where(is_open), level + 1
        counts = rest.groupBy("_stratum").agg(F.count("*").alias("_n"))
        if rest.isEmpty():
            break
    out = reduce(DataFrame.unionByName, settled)
    copies = (F.col("_sure") + F.round("_p")).cast("long")
    return out.select("_row.*", "size", "source_size", "target", copies.alias("copies"))


def _salted(rows: DataFrame) -> DataFrame:
    """Adds ``_salt``: 0, but for rows that are repeated more often than a block has rows a number that deals them out to as many blocks as they
    fill. Such rows are alike, so it doesn't matter which of them gets which."""
    often = stored(rows.select("_hash").groupBy("_hash").agg(F.count("*").alias("_times")).where(F.col("_times") > BLOCK), "often")  # a pass of its own
    often = F.broadcast(often) if _few(often) else often
    number = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_times") / F.lit(BLOCK)))
    return rows.join(often, "_hash", "left").withColumn("_salt", F.coalesce(number, F.lit(0).cast("long"))).drop("_times")


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of small rows is known to be small enough for a broadcast."""
    return sources.limit(most + 1).count() <= most


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that a mix takes, each as often as it takes it. Nulls and rows with 0 copies are left out; no rows give none."""
    taken = mixed.where("copies > 0").select(F.struct(*columns).alias("_row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("_row.*")
