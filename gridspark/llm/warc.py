"""WARC archives with a two-level capture index.

Each record is a gzip member of its own. Records with equal payloads are stored once: the one with the largest page_id
is the response, the others revisit it. The index has a line for each capture, sorted by reversed-host URL key, in
compressed blocks of ``BLOCK_LINES`` lines; each index file ends with its sparse directory, the first and last key and the place of each
block. A look-up binary-searches the files and then a file's directory, reads one block, and then the record's own range of bytes.

Files are written under names of their own and count only when the finished write lists them, so what a lost task
left behind is never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_dir, partitions, small_batches, stored, write_bytes

BLOCK_LINES = 3000
#: An archive file is closed at about this many bytes.
FILE_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.Example.org:80/a?b`` gives ``org,example,www)/a?b``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return ")" + _safe(url or "")
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    host = re.sub(r":(80|443)?$", "", host.rpartition("@")[2].lower())
    return _safe(",".join(reversed(host.split(".")))) + ")" + _safe(tail.partition("#")[0] or "/")


def _safe(url: str) -> str:
    """Control characters and blanks are percent-encoded: headers and index lines hold none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, date: str, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header alone, with the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_safe(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields; a response's size and digest come from its payload, a revisit's from its headers."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    body = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = body.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in body[: cut - 4].decode().split("\r\n")[1:])
    page = lambda name: int(x) if (x := head.get(name, "<urn:page:>")[10:-1]) else None
    out = {"page_id": page("WARC-Record-ID"), "record_type": head["WARC-Type"], "url": head["WARC-Target-URI"], "refers_to": page("WARC-Refers-To")}
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(http["Content-Length"]), "payload_digest": stated, "payload": None}
    payload = body[cut:]
    if (found := digest_of(payload)) != stated or len(payload) != int(http["Content-Length"]):
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages (page_id, url, html)`` with size, kind, refers_to; a revisit's html is null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("same"), F.sha1(body).alias("sha1"))
    first = rows.where(F.col("size") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(first.drop("n"), "same", "left")  # Spark splits the partition of a payload with very many rows
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind: Column = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha1", kind.alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of ``pages (page_id, url, html)`` and returns the captures: key, page_id, file, start, length.

    Null html is an empty payload; a null url has the key ``)``; rows repeated under a page_id each have a record of
    the same type. Among equal payloads null page_ids never are the response unless all are null.
    """
    stamp = re.sub(r"\D", "", date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        rows, held = [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
            write_bytes(uri, waiting)
            return pa.RecordBatch.from_pylist([r | {"file": uri} for r in rows], CAPTURES)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for r in batch.slice(at, 500).to_pylist():
                    payload = None if r["kind"] == "revisit" else r["html"].encode()
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    member = record(r["kind"], r["page_id"], r["url"], date, payload, digest, r["size"], r["refers_to"])
                    rows.append({"key": f"{url_key(r['url'])} {stamp}", "page_id": r["page_id"], "start": held, "length": len(member)})
                    waiting.append(member)
                    held += len(member)
                if held >= FILE_BYTES:
                    yield close()
                    waiting, rows, held = [], [], 0
        if rows:
            yield close()

    return stored(small_batches(classified(pages, min_bytes)).mapInArrow(run, "key string, page_id long, file string, start long, length long"), "captures")


CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("blocks", pa.int64()), ("lines", pa.int64())])


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted, compressed blocks, each file's block directory behind its blocks, and returns one row for each file: first_key,
    last_key, file, start and length of its directory, blocks, lines. There are as many files as shuffle partitions at most."""
    rows = captures.repartitionByRange(partitions(captures.sparkSession), "key", "page_id", "file", "start").sortWithinPartitions("key", "page_id", "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, blocks, places, lines = f"{folder}/index-{uuid.uuid4().hex}.cdx.gz", [], [], []

        def close() -> None:
            data = packed(f"{r['key']} {json.dumps([r['page_id'], r['file'], r['start'], r['length']])}" for r in lines)
            places.append([lines[0]["key"], lines[-1]["key"], sum(p[3] for p in places), len(data), len(lines)])
            blocks.append(data)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    close()
        if lines:
            close()
        if places:
            tail = packed(map(json.dumps, places))
            write_bytes(uri, [*blocks, tail])
            row = {"first_key": places[0][0], "last_key": places[-1][1], "file": uri, "start": sum(map(len, blocks)), "length": len(tail), "blocks": len(places), "lines": sum(p[4] for p in places)}
            yield pa.RecordBatch.from_pylist([row], DIRECTORY)

    return stored(rows.mapInArrow(run, "first_key string, last_key string, file string, start long, length long, blocks long, lines long"), "directory")


def packed(lines: Iterable[str]) -> bytes:
    return gzip.compress("".join(f"{line}\n" for line in lines).encode(), 6, mtime=0)


def read_range(uri: str, start: int, length: int) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, start)


def lines_of(uri: str, start: int, length: int) -> list[str]:
    """The lines of a compressed range; other line ends than \\n occur in urls."""
    return gzip.decompress(read_range(uri, start, length)).decode().split("\n")[:-1]


def block_lines(uri: str, start: int, length: int) -> Iterator[dict]:
    """The captures of a block."""
    for line in lines_of(uri, start, length):
        url, stamp, rest = line.split(" ", 2)
        yield dict(zip(("key", "page_id", "file", "start", "length"), [f"{url} {stamp}", *json.loads(rest)]))


def read_index(directory: DataFrame) -> DataFrame:
    """All captures, from all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for _, _, start, length, _ in map(json.loads, lines_of(r["file"], r["start"], r["length"])):
                    yield pa.RecordBatch.from_pylist(list(block_lines(r["file"], start, length)), CAPTURES)

    files = directory.select("file", "start", "length").repartition(partitions(directory.sparkSession), "file", "start")
    return files.mapInArrow(run, "key string, page_id long, file string, start long, length long")


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """The records of ``captures (file, start, length)``, each by its range of bytes; files are read in the order of the ranges."""
    kinds = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for uri, start, length in zip(*(batch.slice(at, 500)[c].to_pylist() for c in ("file", "start", "length"))):
                    if uri != now:
                        if f:
                            f.close()
                        fs, path = filesystem(uri)
                        now, f = uri, fs.open_input_file(path)
                    out.append(parse(f.read_at(length, start)))
                yield pa.RecordBatch.from_pylist(out, schema)
        if f:
            f.close()

    n = partitions(captures.sparkSession)
    near = F.floor(F.col("start") / F.lit(1 << 22))  # ranges within 4 MiB of a file stay together
    return captures.select("file", "start", "length").repartition(n, "file", near).sortWithinPartitions("file", "start").mapInArrow(run, kinds)


def keyed(urls: DataFrame) -> DataFrame:
    """(url, key) of each row of ``urls (url)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["url"], pa.array([url_key(x) for x in batch["url"].to_pylist()], pa.string())], ["url", "key"])

    return urls.select("url").mapInArrow(run, "url string, key string")


def find(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """The captures of all distinct ``keys (key)``: key, page_id, file, start, length; absent keys give no row.

    Keys are sorted; for each, a binary search in the list of files (one row a file) and one in that file's block directory give the
    blocks that may hold it. Blocks then are dealt out, and each is read and decoded once for all of its keys: a key with
    captures in many blocks is spread over as many tasks.
    """
    spark = keys.sparkSession
    files = spark.sparkContext.broadcast(sorted(map(tuple, directory.select("first_key", "last_key", "file", "start", "length").collect())))
    asked = keys.select("key").distinct().repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    place = [("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, lasts = None, [], []
        ends = [f[1] for f in files.value]
        for batch in batches:
            out = []
            for key in batch["key"].to_pylist():
                low, high = f"{key} ", f"{key}!"  # a line's key goes on with a blank and its stamp
                at = bisect.bisect_left(ends, low)
                while at < len(ends) and files.value[at][0] < high:
                    if at != now:  # keys come in order, so each file's directory is read once
                        places = [json.loads(x) for x in lines_of(*files.value[at][2:])]
                        now, lasts = at, [p[1] for p in places]
                    for p in places[bisect.bisect_left(lasts, low) :]:
                        if p[0] >= high:
                            break
                        out.append((key, files.value[at][2], p[2], p[3]))
                    at += 1
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "file", "start", "length"), o)) for o in out], pa.schema([("key", pa.string()), *place]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted = None, set()

        def read() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([r | {"key": url} for r in block_lines(*now) if (url := r["key"].partition(" ")[0]) in wanted], CAPTURES)

        for batch in batches:
            for key, *at in zip(*(batch[c].to_pylist() for c in ("key", "file", "start", "length"))):
                if at != now:
                    if now:
                        yield read()
                    now, wanted = at, set()
                wanted.add(key)
        if now:
            yield read()

    blocks = asked.mapInArrow(search, "key string, file string, start long, length long").repartition(partitions(spark), "file", "start")
    return blocks.sortWithinPartitions("file", "start").mapInArrow(decode, "key string, page_id long, file string, start long, length long")


def look_up(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """(url, page_id, file, start, length): the captures of each distinct row of ``urls (url)``. A null url is a key like any other."""
    own = keyed(urls.select("url").distinct())
    return own.join(find(own, directory), "key").select("url", "page_id", "file", "start", "length")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index of ``pages`` and returns the list of index files."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder, min_bytes), folder)
