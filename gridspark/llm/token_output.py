"""Token files: ids in ascending doc_id order, Huffman-coded by their global counts, and their reader.

Ids are made once and kept in the shared folder. Their global counts (one for each id of the vocabulary) give one
canonical code for all files. Documents are coded where they lie, and only the coded bits are shuffled: by doc_id range,
sorted, and written as files of about ``FILE_IDS`` ids. A file is

    8 bytes magic, 8 bytes length of the header, a JSON header with the sizes of the parts that follow, and then
    code lengths (one byte an id, deflated), doc_ids, a byte for each doc_id that is null, ids of each document,
    first byte of each document, bit offset of each block in its document, coded bits.

Only files that the finished write lists are read, so what a lost task left behind does no harm.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, filesystem, new_dir, partitions, stored, write_bytes
from .huffman import BLOCK, Codec, code_lengths
from .tokens import REMEMBERED, encoder, with_ids

MAGIC = b"HUFIDS1\n"
#: A file is closed when it holds this many ids; a document is never split.
FILE_IDS = 4_000_000
PARTS = (("lengths", "u1"), ("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("first", "<i8"), ("marks", "<u8"))


def id_counts(ids: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in ``ids (ids)``; one count for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def coded(ids: DataFrame, lengths: np.ndarray, dtype: str) -> DataFrame:
    """(doc_id, n, bits, marks) of ``ids (doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = part["ids"].to_pylist()
                counts = np.fromiter(map(len, own), np.int64, len(own)) // np.dtype(dtype).itemsize
                data, first, marks = codec.encode(np.frombuffer(b"".join(own), dtype), counts)
                stops = np.concatenate([[0], np.cumsum((counts + BLOCK - 1) // BLOCK)])
                marks = marks.astype("<u8").tobytes()
                columns = [part["doc_id"], pa.array(counts), pa.array([data[a:b] for a, b in zip(first, first[1:])], pa.binary()), pa.array([marks[a * 8 : b * 8] for a, b in zip(stops, stops[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bits", "marks"])

    return ids.mapInArrow(run, "doc_id long, n long, bits binary, marks binary")


def file_bytes(docs: list[tuple], lengths: np.ndarray) -> list[bytes]:
    """A file of (doc_id, n, bits, marks) rows."""
    sizes = np.fromiter((len(d[2]) for d in docs), np.int64, len(docs))
    parts = [
        zlib.compress(lengths.astype("u1").tobytes()),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
        np.array([d[0] is None for d in docs], "u1").tobytes(),
        np.array([d[1] for d in docs], "<i8").tobytes(),
        (np.cumsum(sizes) - sizes).astype("<i8").tobytes(),
        b"".join(d[3] for d in docs),
    ]
    header = json.dumps({"block": BLOCK, "ids": len(lengths), "sizes": [len(p) for p in parts]}).encode()
    return [MAGIC, len(header).to_bytes(8, "little"), header, *parts, b"".join(d[2] for d in docs)]


def read_file(data: bytes) -> dict:
    """The parts of a file by name, ``data`` its coded bits."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 16 + int.from_bytes(data[8:16], "little")
    header = json.loads(data[16:at])
    out = {"block": header["block"]}
    for (name, dtype), size in zip(PARTS, header["sizes"], strict=True):
        raw = data[at : at + size]
        out[name] = np.frombuffer(zlib.decompress(raw) if name == "lengths" else raw, dtype)
        at += size
    return out | {"data": data[at:]}


def write_files(ids: DataFrame, lengths: np.ndarray, dtype: str, folder: str) -> DataFrame:
    """Writes ``ids (doc_id, ids)`` and returns the files: part, number, uri, n_docs, n_ids, in the order of the ids.

    Ties of doc_id are ordered by their bits. A doc_id with very many rows is spread over files like any other rows.
    """
    spark = ids.sparkSession
    rows = coded(ids, lengths, dtype).withColumn("tie", F.xxhash64("bits"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "bits")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "n", "bits", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, number, part = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{number:06d}.ids"
            write_bytes(uri, file_bytes(docs, lengths))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "uri": uri, "n_docs": len(docs), "n_ids": held}], FILES)

        for batch in batches:
            for part, *doc in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(doc)
                held += doc[1]
                if held >= FILE_IDS:
                    yield close()
                    docs, held, number = [], 0, number + 1
        if docs:
            yield close()

    return stored(rows.mapInArrow(run, "part int, number int, uri string, n_docs long, n_ids long"), "files")


FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for uri, base in zip(batch["uri"].to_pylist(), batch["base"].to_pylist()):
                fs, path = filesystem(uri)
                with fs.open_input_stream(path) as f:
                    own = read_file(f.read())
                if codec is None or not np.array_equal(codec.lengths, own["lengths"]):
                    codec = Codec(own["lengths"])
                blocks = (own["n"] + own["block"] - 1) // own["block"]
                at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                sizes = np.minimum(own["block"], np.repeat(own["n"], blocks) - at * own["block"])
                ids = codec.decode(own["data"], np.repeat(own["first"] * 8, blocks) + own["marks"].astype(np.int64), sizes).astype("<u4")
                ends = np.cumsum(own["n"])
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), own["n"].tolist())]
                columns = [pa.array(own["doc_id"], pa.int64(), mask=own["null"].astype(bool)), pa.array(base + ends - own["n"]), pa.array(own["n"]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("part", "number", "uri", "base").repartition(partitions(files.sparkSession), "part", "number")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes ``docs (doc_id, text)`` with the tokenizer file at path ``tokenizer``, writes the files, and returns their list.

    Null texts are empty: their ids are ``end_id`` alone. Null doc_ids come first. Rows repeated under a doc_id each have
    their own place. Other columns are not read; no documents make no files.
    """
    dtype = encoder(tokenizer).dtype.str
    size = max(encoder(tokenizer).library.get_vocab_size(), end_id + 1)
    ids = stored(with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, end_id, remembered=remembered), "ids")
    lengths = code_lengths(id_counts(ids, size, dtype))
    files = write_files(ids, lengths, dtype, folder or new_dir(docs.sparkSession, "token-files"))
    discard(ids)  # the files hold them
    return files
