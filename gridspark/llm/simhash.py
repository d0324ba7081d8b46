"""SimHash near-duplicates, with candidates from pigeonring filtering.

A fingerprint has bit b set if more than half of a text's shingle hashes have it. Two fingerprints link at
``tau`` or fewer differing bits. The 64 bits lie on a ring of ``segments`` segments; by the pigeonring principle a
link has a start from which, for every length l, the first l segments differ in at most ``l * tau / segments``
bits together. Where that budget is below one the segments are equal, and where it is below two at most one of the
next differs: the equal ones make the keys that fingerprints are grouped by. Within a group, longer chains are
checked before the full distance.

Texts only meet their fingerprint; distinct fingerprints are grouped, and each group returns a spanning forest of
its links, never all pairs. A group too large for a task is dealt out as pairs of blocks, which covers all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import parts
from .common import discard, free_name, partitions, scratch, small_batches, stored, with_fields
from .components import connected_components

#: Fingerprints of a block; a group with more is dealt out by pairs of blocks.
BLOCK = 1024
#: Shingles hashed at a time.
STEP = 1 << 16


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included: A-Z lower-cased, words split at ASCII white space; fewer words: all of them as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    ends = ends[min(width, len(words)) - 1 :]
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if set in more than half of the hashes; none: zero."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        count += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The text's fingerprint; no words: zero."""
    return simhash(shingle_hashes(text, width, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long; other columns stay."""
    docs = docs.drop("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch[text]], np.uint64).view(np.int64)
            yield batch.append_column("fp", pa.array(fps))

    return small_batches(docs).mapInArrow(run, with_fields(docs, fp="long"))


def ring(segments: int) -> list[int]:
    """Masks of the segments."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def key_masks(segments: int, tau: int) -> list[int]:
    """Masks of bits such that each link agrees on all bits of at least one of them."""
    budget = [(length * tau) // segments for length in range(segments + 1)]
    same = max(length for length in range(segments + 1) if budget[length] == 0)
    near = max(length for length in range(segments + 1) if budget[length] <= 1)
    parts, out = ring(segments), []
    for start in range(segments):
        at = lambda k: parts[(start + k) % segments]
        rest = range(same, near)
        for kept in combinations(rest, max(0, len(rest) - 1)):
            out.append(sum(at(k) for k in (*range(same), *kept)))
    return sorted(set(out))


def chain_masks(segments: int, tau: int) -> list[list[tuple[int, int]]]:
    """For each start: masks of the chains longer than one segment, each with its budget of differing bits."""
    parts = ring(segments)
    return [[(sum(parts[(start + k) % segments] for k in range(length)), (length * tau) // segments) for length in range(1, segments)] for start in range(segments)]


def local_forest(fps: np.ndarray, segments: int, tau: int) -> list[tuple[int, int]]:
    """(root, member) for the members of each component of the links among ``fps`` (distinct, unsigned)."""
    n = len(fps)
    if n < 2:
        return []
    chains = chain_masks(segments, tau)
    near = np.zeros((n, n), bool)
    for row in range(0, n, 256):
        apart = fps[row : row + 256, None] ^ fps[None, :]
        maybe = np.zeros(apart.shape, bool)
        for chain in chains:
            fits = np.ones(apart.shape, bool)
            for mask, budget in chain:
                fits &= np.bitwise_count(apart & np.uint64(mask)) <= budget
                if not fits.any():
                    break
            maybe |= fits
        near[row : row + 256] = maybe & (np.bitwise_count(apart) <= tau)
    edges, free = [], np.ones(n, bool)
    for root in range(n):
        if free[root]:
            reach, front = near[root].copy(), near[root] & free
            front[root] = reach[root] = True
            while True:
                more = near[front].any(axis=0) & ~reach
                if not more.any():
                    break
                reach |= more
                front = more
            free &= ~reach
            members = fps[reach]
            edges += [(int(members.min()), int(m)) for m in members if m != members.min()]
    return edges


def _pair_forest(fps: list[int], segments: int, tau: int, chains: list) -> list[tuple[int, int]]:
    """As local_forest for a few fingerprints, in plain integers."""
    edges = []
    for a, b in combinations(fps, 2):
        apart = a ^ b
        if any(all((apart & mask).bit_count() <= budget for mask, budget in chain) for chain in chains) and apart.bit_count() <= tau:
            edges.append((min(a, b), max(a, b)))
    return edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Groups of rows sorted by (k, i, j): the key's number and bits, and the pair of blocks."""
    last, parts = None, []
    for batch in batches:
        k, v, i, j, fp = (batch[name].to_numpy() for name in ("k", "v", "i", "j", "fp"))
        if not len(k):
            continue
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(new, np.r_[new[1:], len(k)]):
            head = (k[a], v[a], i[a], j[a])
            if head != last:
                if parts:
                    yield np.concatenate(parts)
                last, parts = head, []
            parts.append(fp[a:b])
    if parts:
        yield np.concatenate(parts)


def linked(fps: DataFrame, tau: int = 3, segments: int = 7) -> DataFrame:
    """Edges (u, v), u the smaller as an unsigned number, that connect exactly the distinct values of ``fps (fp)`` that links connect.

    Null values have no links; other columns are not read; no values or a single one give no edges."""
    fps, masks = fps.where("fp is not null"), key_masks(segments, tau)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for k, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("key")).select("fp", "key.k", "key.v")
    sizes = rows.groupBy("k", "v").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = rows.join(sizes, ["k", "v"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition(partitions(fps.sparkSession), "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = chain_masks(segments, tau)
        for group in _groups(batches):
            fps = np.unique(group.view(np.uint64))
            edges = _pair_forest(fps.tolist(), segments, tau, chains) if len(fps) <= 8 else local_forest(fps, segments, tau)
            if edges:
                both = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return rows.mapInArrow(solve, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, tau: int = 3, segments: int = 7, width: int = 3) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id, fp, component_id.

    ``component_id`` is the smallest doc_id among all texts reachable over links, the own included. Null and empty texts
    have fingerprint zero and link like any other; null doc_ids are never a component_id unless all are null; rows with
    the same doc_id each keep their own text's fingerprint. Other columns are not read.
    """
    own = stored(with_fingerprint(docs.select("doc_id", "text"), width=width).select("doc_id", "fp"), "fingerprints")
    return _grouped(own, tau, segments)


def _grouped(own: DataFrame, tau: int, segments: int) -> DataFrame:
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = stored(linked(nodes.select("fp"), tau, segments), "links")
    return own.join(_named(nodes, "fp", edges), "fp").select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, component_id): the smallest ``least`` of ``nodes (key, least)`` in each component of the edges."""
    roots = connected_components(edges).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col(key) == F.col("_node"), "left").select(key, "least", F.coalesce("root", key).alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select(key, "component_id")


def keep_one(docs: DataFrame, tau: int = 3, segments: int = 7, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group: the row with the group's smallest doc_id.

    Groups are the components of one graph over all distinct texts: links of fingerprints, pairs with a shingle similarity of
    ``similarity`` (see parts.py; fingerprints of such texts mostly differ in more than ``tau`` bits), and equal fingerprints or
    shingle sets. So texts that only a dropped document connects are one group. Rows repeated under one
    doc_id count as copies: the one with the smallest text stays (null first). Rows with a null doc_id can't be told apart and
    stay. All columns stay.
    """
    known = docs.where("doc_id is not null")
    own = stored(parts.with_parts(known.select("doc_id", "text"), width).drop("text"), "profiles")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    of = own.select("fp", "node").distinct()
    first = stored(of.groupBy("fp").agg(F.min("node").alias("first")), "first")  # a fingerprint's own node
    named = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"n{k}"))
    near = linked(first.select("fp"), tau, segments).join(named("u"), "u").join(named("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    equal = of.join(first, "fp").select(F.col("first").alias("u"), F.col("node").alias("v"))
    with scratch() as made:
        edges = stored(near.union(equal).union(parts.similar(own, similarity, known, width)).where("u <> v").distinct(), "edges")
        made.remove(edges)
    discard(first)
    least, copy = free_name(docs, "_kept"), free_name(docs, "_copy")  # texts are carried once: no struct beside the columns
    kept = _named(nodes, "node", edges).select(F.col("component_id").alias(least)).distinct()
    mine = known.join(kept, F.col("doc_id") == F.col(least), "left_semi")
    mine = mine.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(copy) == 1).drop(copy)
    return mine.unionByName(docs.where("doc_id is null"))


def hexed(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
