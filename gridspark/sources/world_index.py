"""An index of world files: where each slice of columns lies in its file and what is in it, so that a region is read by byte ranges.

A file has no table of its columns: they are found by walking its records once. The index keeps what the walk finds, one row for SLICE columns,
as Parquet; a read asks the index first, opens only files with a wanted slice, and takes only that slice's bytes. The index grows with
the columns and is read by tasks alone: nothing of it is planned by the driver, but for the number of tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worlds import SLICE, TILE, Cursor, FormatError, _batch, read_header, read_record

#: A slice's columns, bytes in the file, the end of each column from its start, the types of its active cells, and whether it has liquids.
INDEX = "world_id string, size long, error string, height int, x0 int, columns int, start long, bytes long, ends array<int>, framed binary, types array<int>, wet boolean"
#: Bytes of cells that a task reads, about.
TASK_BYTES = 16 << 20
KINDS = dict(part.split() for part in TILE.split(", "))


def walk(data: bytes) -> list[dict]:
    """The index rows of a file; FormatError where it breaks a rule."""
    world, framed, bounds = read_header(data)
    c, rows = Cursor(data, *bounds), []
    for x in range(world["width"]):
        if x % SLICE == 0:
            rows.append({"height": world["height"], "x0": x, "start": c.pos, "ends": [], "framed": framed, "types": set(), "wet": False})
        own, y = rows[-1], 0
        while y < world["height"]:
            tile, repeats, _ = read_record(c, framed)
            y += repeats + 1
            if tile["active"]:
                own["types"].add(tile["type"])
            own["wet"] |= tile["liquid"] > 0
        if y > world["height"]:
            raise FormatError("run crosses its column")
        own["ends"].append(c.pos - own["start"])
    if c.pos != c.end:
        raise FormatError("cells' section length")
    return [r | {"columns": len(r["ends"]), "bytes": r["ends"][-1], "types": sorted(r["types"])} for r in rows]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            data = data.as_py()
            try:
                rows = walk(data)
            except FormatError as e:
                rows = [{"error": str(e)}]
            yield _batch([{"world_id": path, "size": len(data)} | r for r in rows], INDEX)


def index_worlds(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Writes the index of all files under ``path`` to ``index`` (an existing one is an error) and returns it. A file that breaks the format has one row
    with its ``error`` and no slices. Files of no bytes give no row."""
    files = spark.read.format("binaryFile").load(path)
    files.select("path", "content").mapInArrow(_walked, INDEX).write.mode("errorifexists").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def slices_of(spark: SparkSession, index: str, x: int = 0, width: int | None = None, types: Sequence[int] | None = None, wet: bool = False, worlds: Sequence[str] | None = None) -> DataFrame:
    """The index rows that columns from ``x`` on may be in: of some worlds, with any of some types, with liquids."""
    found = spark.read.schema(INDEX).parquet(index).where(F.col("error").isNull() & (F.col("x0") + F.col("columns") > x))
    if width is not None:
        found = found.where(F.col("x0") < x + width)
    if types is not None:
        found = found.where(F.arrays_overlap("types", F.array(*map(F.lit, types)).cast("array<int>")))
    if wet:
        found = found.where("wet")
    return found if worlds is None else found.where(F.col("world_id").isin(*worlds))


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/(?!//)", "file:///", path)))


def read_columns(
    spark: SparkSession, index: str, x: int = 0, width: int | None = None, y: int = 0, height: int | None = None, types: Sequence[int] | None = None, wet: bool = False, worlds: Sequence[str] | None = None, fields: Sequence[str] = tuple(KINDS)
) -> DataFrame:
    """Runs (world_id, x, y0, run_len and ``fields`` of TILE) of the columns and rows asked for; without ``width`` or ``height`` to the end.

    With ``types``, runs that are active and of one of them; with ``wet``, runs that hold liquid. Runs are cut at the rows' bounds. Other fields aren't
    built. No rows, types or worlds asked for give no runs. A file that isn't as long as when it was indexed is an error.
    """
    if unknown := set(fields) - set(KINDS):
        raise ValueError(f"no fields of a tile: {sorted(unknown)}")
    if worlds is not None and not worlds or types is not None and not types:
        worlds, types = ["none"], None  # no file's id
    wanted = slices_of(spark, index, x, width, types, wet, worlds).select("world_id", "size", "height", "x0", "start", "bytes", "ends", "framed")
    tasks = 1 + (wanted.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES
    names = ["world_id", "x", "y0", "run_len", *fields]
    schema = ", ".join(["world_id string, x int, y0 int, run_len int", *(f"{f} {KINDS[f]}" for f in fields)])
    chosen = None if types is None else frozenset(types)
    last_x = None if width is None else x + width

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for part in batch.to_pylist():
                if part["world_id"] != opened:
                    if source:
                        source.close()
                    store, place = store_of(part["world_id"])
                    opened, source = part["world_id"], store.open_input_file(place)
                    if source.size() != part["size"]:
                        raise FormatError(f"{opened} has changed since it was indexed")
                edges = [0, *part["ends"]]
                first = max(0, x - part["x0"])
                last = len(part["ends"]) if last_x is None else min(len(part["ends"]), last_x - part["x0"])
                c = Cursor(source.read_at(edges[last] - edges[first], part["start"] + edges[first]))
                low, high = max(0, y), part["height"] if height is None else min(part["height"], y + height)
                out: dict[str, list] = {n: [] for n in names}
                for k in range(first, last):
                    top = 0
                    while c.pos < edges[k + 1] - edges[first]:
                        tile, repeats, _ = read_record(c, part["framed"])
                        y0, top = max(low, top), top + repeats + 1
                        if y0 >= min(high, top) or (chosen is not None and not (tile["active"] and tile["type"] in chosen)) or (wet and not tile["liquid"]):
                            continue
                        tile |= {"world_id": opened, "x": part["x0"] + k, "y0": y0, "run_len": min(high, top) - y0}
                        for n in names:
                            out[n].append(tile[n])
                yield pa.RecordBatch.from_pydict(out, _batch([], schema).schema)
        if source:
            source.close()

    return wanted.repartitionByRange(tasks, "world_id", "x0").sortWithinPartitions("world_id", "x0").mapInArrow(decode, schema)
