"""Fragments, asset manifests, asset catalogues and benchmark reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.aggs import dictionary_encode

FORMAT = "grid.cells"
RECT = "struct<x:int,y:int,width:int,height:int>"
SOURCE = "struct<signature:string,name:string,id:int,width:int,height:int,worldSurface:double>"
PAYLOAD = f"format string, schema int, version int, rect {RECT}, source {SOURCE}, important array<int>, order string, dictionary array<string>, ids array<int>"
PAYLOAD_KEYS = ("format", "schema", "version", "rect", "source", "important", "order", "dictionary", "ids")
SPLIT = r'^\{"checksum":\{"algorithm":"crc32","value":"([0-9a-f]{8})"\},"payload":(.*)\}$'


def fragment_json(cells: DataFrame, fragments: DataFrame) -> DataFrame:
    """(fragment_id, json): each region as a dictionary of distinct records and their ids in column-major order, with a checksum.

    ``cells (fragment_id, index, raw)``; ``fragments (fragment_id, version, rect, source, important)``. A fragment is at most 65,536 cells.
    """
    palette, ids = dictionary_encode(cells.select("fragment_id", "index", F.lower(F.hex("raw")).alias("value")), "value", "index", ["fragment_id"])
    words = palette.groupBy("fragment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda s: s["value"]).alias("dictionary"))
    numbers = ids.groupBy("fragment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "id"))), lambda s: s["id"]).alias("ids"))
    full = fragments.join(words, "fragment_id").join(numbers, "fragment_id")
    payload = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(1).alias("schema"), "version", "rect", "source", "important", F.lit("column-major").alias("order"), "dictionary", "ids"))
    value = F.lower(F.lpad(F.hex(F.crc32(payload.cast("binary"))), 8, "0"))
    return full.select("fragment_id", F.concat(F.lit('{"checksum":{"algorithm":"crc32","value":"'), value, F.lit('"},"payload":'), payload, F.lit("}")).alias("json"))


def write_fragments(cells: DataFrame, fragments: DataFrame, path: str) -> None:
    """One line a fragment; an existing path is an error."""
    fragment_json(cells, fragments).select("json").write.mode("errorifexists").text(path)


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, fragment_cells, violations) of files with one fragment a line. The fragment's id is the SHA-256 of its line.

    A fragment with a violation gives no cells; ``reason`` is the first rule that it breaks.
    """
    lines = spark.read.text(path).select(F.sha2(F.col("value").cast("binary"), 256).alias("fragment_id"), "value").dropDuplicates(["fragment_id"])
    parts = lines.select("fragment_id", F.regexp_extract("value", SPLIT, 1).alias("sum"), F.regexp_extract("value", SPLIT, 2).alias("text"))
    parsed = parts.withColumn("p", F.from_json("text", PAYLOAD)).withColumn("extra", F.size(F.array_except(F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")), F.array(*map(F.lit, PAYLOAD_KEYS)))))
    p = lambda name: F.col(f"p.{name}")
    rect, size = p("rect"), p("rect.width") * p("rect.height")
    inside = (rect["x"] >= 0) & (rect["y"] >= 0) & (rect["width"] > 0) & (rect["height"] > 0) & (rect["x"] + rect["width"] <= p("source.width")) & (rect["y"] + rect["height"] <= p("source.height"))
    known = F.forall(p("ids"), lambda i: (i >= 0) & (i < F.size(p("dictionary"))))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when((F.col("text") == "") | (F.col("extra") > 0) | no(p("format") == FORMAT), "structure")
        .when(no((p("schema") == 1) & (p("order") == "column-major") & p("version").between(269, 326)), "version")
        .when(no(inside & (size <= 65_536)), "rectangle")
        .when(no(F.forall(p("important"), lambda v: v.isin(0, 1)) & F.size(p("important")).between(1, 4096)), "frame table")
        .when(no((F.size(p("ids")) == size) & (F.size(p("dictionary")) <= size)), "cell count")
        .when(no(F.forall(p("dictionary"), lambda v: v.rlike("^([0-9a-f]{2}){1,64}$"))), "tile payload")
        .when(F.lower(F.lpad(F.hex(F.crc32(F.col("text").cast("binary"))), 8, "0")) != F.col("sum"), "checksum")
        .when(no(known), "cell index")
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason is null").select("fragment_id", "p.*")
    cells = good.select("fragment_id", "rect", "dictionary", F.posexplode("ids").alias("index", "id"))
    cells = cells.select("fragment_id", "index", (F.col("rect.x") + F.floor(F.col("index") / F.col("rect.height"))).alias("x"), (F.col("rect.y") + F.col("index") % F.col("rect.height")).alias("y"), F.unhex(F.element_at("dictionary", F.col("id") + 1)).alias("raw"))
    return good.drop("dictionary", "ids"), cells, judged.where("reason is not null").select("fragment_id", "reason")


def read_asset_manifest(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(assets, violations) of JSON manifests ``{"textures": [{file, bytes, sha256, width, height}]}``: names must be unique, sizes and
    hashes well formed."""
    schema = "textures array<struct<file:string,bytes:bigint,sha256:string,width:int,height:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("textures").alias("t")).select("t.*")
    copies = rows.groupBy("file").agg(F.count("*").alias("copies"))
    reason = F.when(F.col("file").isNull() | (F.col("file") == ""), "name").when(F.col("copies") > 1, "duplicate").when(~F.coalesce(F.col("bytes").between(1, most_bytes), F.lit(False)), "size").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash")
    judged = rows.join(copies, "file", "left").withColumn("reason", reason).drop("copies")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("file", "reason")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """One file for each row of ``blobs (file, content)``, in a new folder. Each is written under another name first, so that a lost task leaves
    no torn file; rows of one name overwrite each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"].to_pylist()):
                hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content)
                store.move(hidden, f"{folder}/{name}")
        yield pa.RecordBatch.from_pylist([], pa.schema([("n", pa.int64())]))

    blobs.select("file", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def _big_endian(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")


def catalog_assets(spark: SparkSession, path: str) -> DataFrame:
    """Each image file's name, bytes, sha256, width, height and status (ok, or not an image); pixels are never decoded."""
    files = spark.read.format("binaryFile").load(path)
    c = F.col("content")
    png = (F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(c, 13, 4)) == "49484452")
    width, height = _big_endian(c, 17), _big_endian(c, 21)
    ok = png & (width > 0) & (height > 0)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("sha256"),
        F.when(ok, width).alias("width"), F.when(ok, height).alias("height"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("not an image").alias("status"),
    )


BENCH = """timing struct<endToEndSeconds:double,conservativeAggregatePeakRssBytes:bigint,targetPassed:boolean,lifetime:string,environment:string>,
render struct<worldSha256:string,processedCells:bigint,assetHashes:map<string,string>,commandCounts:map<string,bigint>>, fidelity struct<patches:array<struct<name:string,comparedPixels:bigint,differentBytes:bigint>>>"""


def read_bench_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark reports, one a file, with ``run_id`` (the file)."""
    return spark.read.schema(BENCH).option("multiLine", True).json(path).withColumn("run_id", F.input_file_name())
