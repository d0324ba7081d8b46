"""Similar texts by equal parts of their shingle sets.

A text's distinct shingles are dealt into parts of two to eight by their hashes. Texts with a similarity of 0.8 agree on a
part of four with a chance of 0.4, so they share at least one of twelve nearly always (all but 0.4 % where the finer level
isn't shared). All pairs of a part's members are candidates, and each is decided by the exact similarity of its shingle sets.
Parts with the same members are compared once, and a part with very many is dealt out as pairs of blocks, each of which
returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored, with_fields

#: Parts of a level that make keys, and shingles of a part at least on the coarser level.
KEYS, LEAST = 12, 4
#: Members of a block; a part with more is dealt out by pairs of blocks.
BLOCK = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def number(own: np.ndarray) -> int:
    """A set's own number, from its distinct hashes; no hashes: zero."""
    return int(_mix(np.array([_mix(own).sum() ^ np.bitwise_xor.reduce(own)], np.uint64))[0]) if len(own) else 0


def profile(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """A set's own number, its size and its keys."""
    own = np.unique(hashes)
    if not len(own):
        return 0, 0, np.empty(0, np.uint64)
    mixed = _mix(own)
    level, keys = max(0, int(np.log2(max(1, len(own) / LEAST)))), []
    for depth in (level, level + 1):
        part = (mixed >> np.uint64(20)) & np.uint64((1 << depth) - 1)
        few = part < KEYS
        order = np.argsort(part[few], kind="stable")
        place, value = part[few][order], mixed[few][order]
        if len(place):
            firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            keys.append(_mix(np.add.reduceat(value, firsts) ^ (place[firsts] + np.uint64(64 * depth + 1)) * np.uint64(0x9E3779B97F4A7C15)))
    return number(own), len(own), np.concatenate(keys)


def with_parts(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """Adds ``fp`` (SimHash), ``node``, ``size`` (distinct shingles) and ``keys`` to each row; other columns stay.

    Null and empty texts have no shingles: fp, node and size are zero, and they have no keys. Equal shingle sets have equal nodes.
    Columns of those four names in the input are replaced.
    """
    from .simhash import shingle_hashes, simhash

    docs = docs.drop("fp", "node", "size", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                hashes = (shingle_hashes(x.as_py(), width) for x in piece[text])
                rows = [(simhash(h), *profile(h)) for h in hashes]
                signed = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))
                keys = pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64()))
                for name, column in (("fp", signed(0)), ("node", signed(1)), ("size", pa.array([r[2] for r in rows], pa.int64())), ("keys", keys)):
                    piece = piece.append_column(name, column)
                yield piece

    return small_batches(docs).mapInArrow(run, with_fields(docs, fp="long", node="long", size="long", keys="array<long>"))


def with_sets(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """(node, shingles) of each row: its text's node (zero for null and empty texts) and distinct shingle hashes as bytes. Repeated texts
    give repeated rows; other columns are not read."""
    from .simhash import shingle_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [np.unique(shingle_hashes(x.as_py(), width)) for x in batch[text].slice(at, 200)]
                nodes = np.array([number(own) for own in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([own.astype("<u8").tobytes() for own in sets], pa.binary())], ["node", "shingles"])

    return small_batches(docs.select(text)).mapInArrow(run, "node long, shingles binary")


def forest(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(root, member) for the members of each component of the pairs with a similarity of ``least`` or more: distinct nodes and their
    sets of distinct hashes. The similarity of every pair that could join two components is computed."""
    if len(nodes) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(nodes.min()), int(nodes.max()))] if shared / (len(sets[0]) + len(sets[1]) - shared) >= least else []
    sizes = np.array([len(s) for s in sets], np.int64)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    edges, free = [], np.arange(len(nodes))
    flat, starts = ids, np.cumsum(sizes) - sizes
    is_free, held = np.ones(len(nodes), bool), free
    mark = np.zeros(len(words), bool)
    while is_free.any():
        root = int(np.flatnonzero(is_free)[0])
        is_free[root] = False
        reached, front = [root], [root]
        while front and is_free.any():
            at = front.pop()
            if is_free.sum() * 2 < len(held):  # leave out what is reached
                held = np.flatnonzero(is_free)
                flat, starts = np.concatenate([own[k] for k in held]), np.cumsum(sizes[held]) - sizes[held]
            mark[own[at]] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own[at]] = False
            new = held[is_free[held] & (shared / (sizes[at] + sizes[held] - shared) >= least)].tolist()
            is_free[new] = False
            reached += new
            front += new
        if len(reached) > 1:
            first = int(nodes[reached].min())
            edges += [(first, int(n)) for n in nodes[reached] if n != first]
    return edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and sets of groups of rows sorted by (key, i, j)."""
    last, held = None, {}
    for batch in batches:
        names = zip(*(batch[c].to_pylist() for c in ("key", "i", "j")))
        for head, node, shingles in zip(names, batch["node"].to_pylist(), batch["shingles"]):
            if head != last:
                if len(held) > 1:
                    yield np.array(list(held), np.int64), list(held.values())
                last, held = head, {}
            held[node] = np.frombuffer(shingles.as_py(), "<u8")
    if len(held) > 1:
        yield np.array(list(held), np.int64), list(held.values())


def similar(profiles: DataFrame, least: float = 0.8, docs: DataFrame | None = None, width: int = 5) -> DataFrame:
    """Edges (u, v) that connect exactly the nodes of ``profiles (doc_id, node, size, keys)`` that pairs with a key in common and a
    similarity of ``least`` or more connect. The texts are those of ``docs (doc_id, text)``, else of ``profiles``.

    Rows with a null doc_id have no text to compare and no edges; of rows that share a doc_id any that has the node is read. Nodes
    without keys (no words) have no edges; a node is never linked with itself; other columns are not read; no rows give none.
    """
    docs = profiles if docs is None else docs
    rows = profiles.select("node", "size", F.explode("keys").alias("key")).distinct()
    alike = [F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")]
    keys = rows.groupBy("key").agg(*alike, F.min("size").alias("short"), F.max("size").alias("long")).where(f"n > 2 or (n = 2 and short >= {least} * long)")
    keys = keys.groupBy("n", "low", "high", "a", "b").agg(F.min("key").alias("key")).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    members = stored(rows.join(keys.select("key", "blocks"), "key").select("key", "blocks", "node"), "members")
    asked = profiles.select("node", "doc_id").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = with_sets(docs.select("doc_id", "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), width)
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node").join(sets, "node")
    dealt = dealt.repartition(partitions(profiles.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _groups(batches):
            if edges := forest(nodes, sets, least):
                both = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return dealt.select("key", "i", "j", "node", "shingles").mapInArrow(run, "u long, v long").distinct()
