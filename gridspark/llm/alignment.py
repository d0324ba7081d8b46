"""Cross-tokenizer alignment: merge-path partitioning of two tokenizers' token ends.

The ends of a text's A and B tokens, as byte offsets, are two sorted lists. A diagonal d of their merge grid is crossed where d ends are
merged; a binary search on each of the diagonals 0, P, 2P, ... finds how many of these are A's (equal ends: A's first). Between two
diagonals lies a piece of P ends, whatever the mix: pieces are merged without each other, by one lookback of a single end. Every end but a
B end that equals an A end closes one overlap of an A and a B token; equal ends close a group. A piece's first closing belongs to a group that
an earlier piece may have opened: laying the pieces' closings end to end stitches them.

Texts are cut into units that both tokenizers encode alike alone and in context: before a blank or line end that follows other than
white space. A worker remembers the ids of units. A unit's boundary is an end of both.

Corpus-wide counts of id pairs: links are stored as pair codes once; counts come from partial sums in tasks and one shuffle of distinct pairs, whose
number the two vocabularies bound. They are read back by tasks from the shared folder, in buckets of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import filesystem, new_dir, small_batches, stored

#: Merged ends of a piece; characters that are encoded or aligned at once; units that a worker remembers (and as many older ones).
PIECE, AT_ONCE, REMEMBERED = 65_536, 1_000_000, 400_000
#: Pairs that a task counts before it merges them, and pairs of one bucket of counts.
MERGE_AT, BUCKET = 4_000_000, 4_000_000
#: White space as the byte-level tokenizer's pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile("[ \n]*[^ \n]+|[ \n]+")
_OTHER_WHITE = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]")
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[ \n])")


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where each diagonal is crossed: the numbers of A and of B ends among the first 0, piece, 2 * piece, ... and all merged ends."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: the A and B tokens of each overlap that ends in it, in order, and the numbers of A and B ends at each closing."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    in_b = np.searchsorted(own_b, own_a, "left") + j0  # the B token that each A end lies in
    in_a = np.searchsorted(own_a, own_b, "right") + i0
    closes = in_a > 0
    closes[closes] = a[in_a[closes] - 1] == own_b[closes]
    i, j = np.arange(i0, i1), np.arange(j0, j1)
    left, right, real = np.empty(len(i) + len(j), np.int64), np.empty(len(i) + len(j), np.int64), np.ones(len(i) + len(j), bool)
    left[i + in_b - i0 - j0], right[i + in_b - i0 - j0] = i, in_b
    left[in_a + j - i0 - j0], right[in_a + j - i0 - j0], real[in_a[closes] + j[closes] - i0 - j0] = in_a, j, False
    return left[real], right[real], in_a[closes], j[closes] + 1


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces, laid end to end: the tokens of each overlap, and A and B ends up to the end of each group."""
    i, j = diagonals(a, b, piece)
    parts = [overlaps(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))


class Pair:
    """The two tokenizers, their tokens' bytes, and the ids of remembered units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocab = self.a.get_vocab()
        byte = {c: bytes([k]) for k, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = b"".join(byte.get(c, c.encode()) for c in token)
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.code = np.int32 if len(self.a_size) * len(self.b_size) < 1 << 31 else np.int64
        self.a_kind, self.b_kind = (np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.a_size, self.b_size))
        shown = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.by_unit = not any("\n" in p or re.search("[^▁]▁", p) for p in shown)  # no piece goes over a boundary
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # A's and B's ids of units
        self.older = self.known
        self.bad: set[str] = set()  # units without tokens

    def units(self, text: str) -> list[str]:
        """The space and the text in units."""
        if not self.by_unit:
            return [" " + text]
        return _BOUNDARY.split(" " + text) if _OTHER_WHITE.search(text) else _UNIT.findall(" " + text)

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a blank or line end; none where the tokens' bytes differ from the text's."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode("\n" + text)[2:] if self.by_unit else self.b.encode(text[1:]), np.int64)
        raw = text.encode()
        same = b"".join([self.a_bytes[k] for k in a.tolist()]) == raw == b"".join([self.b_bytes[k] for k in b.tolist()])
        return (a, b) if same else None

    def _learn(self, units: list[str]) -> None:
        """Encodes units as one text, and each alone where that text has no tokens."""
        both = self._encoded("".join(units))
        if both is None:
            if len(units) == 1:
                self.bad.add(units[0])
                self.known[0][units[0]] = self.known[1][units[0]] = b""
            else:
                self._learn(units[: len(units) // 2])
                self._learn(units[len(units) // 2 :])
            return
        ends = np.cumsum([len(u.encode()) for u in units])
        cuts = [np.searchsorted(np.cumsum(size[ids]), ends, "right").tolist() for size, ids in zip((self.a_size, self.b_size), both)]
        data = both[0].astype(self.a_kind).tobytes(), both[1].astype(self.b_kind).tobytes()
        wa, wb = self.a_kind.itemsize, self.b_kind.itemsize
        a0 = b0 = 0
        for unit, a1, b1 in zip(units, *cuts):
            self.known[0][unit], self.known[1][unit] = data[0][a0 * wa : a1 * wa], data[1][b0 * wb : b1 * wb]
            a0, b0 = a1, b1

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids of both; nothing for null and empty texts, and where any token's bytes differ."""
        if len(self.known[0]) > REMEMBERED:
            self.known, self.older = ({}, {}), self.known
        if len(self.bad) > REMEMBERED:
            self.bad, self.known, self.older = set(), ({}, {}), ({}, {})
        split = [self.units(x) if x else [] for x in texts]
        (first, second), older, new, size = self.known, self.older, [], 0
        for unit in set().union(*split) - first.keys():
            if unit in older[0]:
                first[unit], second[unit] = older[0][unit], older[1][unit]
            elif unit[-1] in WHITE:  # the end of a text: what follows would change it
                self._learn([unit])
            else:
                new.append(unit)
                size += len(unit)
                if size > 20_000:
                    self._learn(new)
                    new, size = [], 0
        if new:
            self._learn(new)
        good = [not self.bad or self.bad.isdisjoint(units) for units in split]
        return [(b"".join(map(first.__getitem__, units)), b"".join(map(second.__getitem__, units))) if g else (b"", b"") for g, units in zip(good, split)]

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, self.encode(texts))


class Aligned:
    """Texts' tokens merged: flat arrays over all of them, and each text's part of them."""

    def __init__(self, pair: Pair, ids: list[tuple[bytes, bytes]]) -> None:
        self.a = np.frombuffer(b"".join([x for x, _ in ids]), pair.a_kind).astype(np.int64)
        self.b = np.frombuffer(b"".join([x for _, x in ids]), pair.b_kind).astype(np.int64)
        self.n_a = np.array([len(x) // pair.a_kind.itemsize for x, _ in ids], np.int64)
        self.n_b = np.array([len(x) // pair.b_kind.itemsize for _, x in ids], np.int64)
        self.ends = np.cumsum(pair.a_size[self.a])
        left, right, self.close_a, self.close_b = merge(self.ends, np.cumsum(pair.b_size[self.b]))
        self.codes = (self.a[left] * len(pair.b_size) + self.b[right]).astype(pair.code)
        after_a = np.cumsum(self.n_a)
        closed = np.searchsorted(self.close_a, after_a, "right")  # groups up to each text's end
        self.n_groups = np.diff(closed, prepend=0)
        self.n_links = self.n_a + self.n_b - self.n_groups

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups; empty without tokens."""
        group_a, group_b = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (self.close_a, self.close_b))
        before_b, after_a = np.concatenate([[0], self.close_b])[group_a], self.close_a[group_b]
        ids, signs = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        at_a, at_b = np.arange(len(self.a)) + before_b, np.arange(len(self.b)) + after_a
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a[self.close_a - 1]], signs[at_b[self.close_b - 1]] = ord("|"), ord(";")
        table = _decimals(int(ids.max(initial=0)))
        shown = np.empty((len(ids), table.shape[1] + 1), np.uint8)
        shown[:, :-1], shown[:, -1] = table[ids], signs
        ends = np.concatenate([[0], np.cumsum((shown != 0).sum(axis=1))])
        data = memoryview(shown[shown != 0].tobytes())
        last = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[np.concatenate([[0], last[:-1]])].tolist(), ends[last].tolist())] if len(last) else []


_TABLES: dict[int, np.ndarray] = {}


def _decimals(most: int) -> np.ndarray:
    """The digits of 0 to at least ``most``, zero bytes behind them."""
    size = 10 ** len(str(most))
    if size not in _TABLES:
        _TABLES[size] = np.array([str(k) for k in range(size)], f"S{len(str(size - 1))}").view(np.uint8).reshape(size, -1)
    return _TABLES[size]


def _byte_letters() -> str:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k]
    rest = [k for k in range(256) if k not in own]
    return "".join(chr(k) if k in own else chr(256 + rest.index(k)) for k in range(256))


_OPEN: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """One for each worker and pair of files."""
    if (a_path, b_path) not in _OPEN:
        _OPEN[a_path, b_path] = Pair(a_path, b_path)
    return _OPEN[a_path, b_path]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about AT_ONCE characters, one row at least."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > AT_ONCE:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``, the codes (A id times B's vocabulary, plus B id) of all links in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair_of(a_path, b_path)
        for batch in batches:
            for x, y in _parts(batch["text"]):
                found = own.align(batch["text"][x:y].to_pylist())
                ends = np.concatenate([[0], np.cumsum(found.n_links)]) * found.codes.itemsize
                data = found.codes.tobytes()
                links = [data[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                numbers = [pa.array(v, pa.int64()) for v in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][x:y], *numbers, pa.array(found.digests(), pa.string()), pa.array(links, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each group: doc_id, its first and (exclusive) last byte in the space and text, and the ids of its A and B tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair_of(a_path, b_path)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = own.align([text.as_py()])
                ends = found.ends[found.close_a - 1]
                parts = [np.split(ids, close)[:-1] for ids, close in ((found.a, found.close_a), (found.b, found.close_b))]
                columns = [pa.array([doc.as_py()] * len(ends), doc.type), pa.array(np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)), pa.array(ends.astype(np.int64)), *(pa.array([p.tolist() for p in x], pa.list_(pa.int64())) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "a_ids", "b_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, a_ids array<long>, b_ids array<long>")


def pair_counts(links: DataFrame, code: np.dtype, b_vocab: int) -> DataFrame:
    """(code, n, best): how many links of the corpus hold a pair, and whether no pair of its B id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, waiting, held = np.empty(0, code), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, code), np.empty(0, np.int64))
            both, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, back, np.concatenate([numbers, n]))
            return both, total

        for batch in batches:
            for x in batch["links"]:
                waiting.append(np.frombuffer(x.as_buffer(), code))
                held += len(waiting[-1])
                if held > MERGE_AT:
                    codes, numbers = merged()
                    waiting, held = [], 0
        codes, numbers = merged()
        for at in range(0, len(codes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 50_000].astype(np.int64)), pa.array(numbers[at : at + 50_000])], ["code", "n"])

    total = links.select("links").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("code") % b_vocab)))


_COUNTS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _bucket(uri: str, code: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in order, their counts and marks; a worker keeps the last bucket it read."""
    if uri not in _COUNTS:
        fs, path = filesystem(uri)
        read = pq.read_table(path, filesystem=fs, columns=["code", "n", "best"], partitioning=None)
        codes = read["code"].to_numpy()
        order = np.argsort(codes)
        _COUNTS.clear()
        _COUNTS[uri] = codes[order].astype(code), read["n"].to_numpy()[order], read["best"].to_numpy()[order].astype(np.int64)
    return _COUNTS[uri]


def with_counts(links: DataFrame, counts: DataFrame, code: np.dtype) -> DataFrame:
    """``links`` of ``aligned`` with n_best and count_sum in place of the codes. ``counts`` is stored by range of code in buckets of about BUCKET pairs,
    which every task reads one after another: memory is one bucket's."""
    counts = stored(counts, "pairs")
    buckets = max(1, -(-counts.count() // BUCKET))
    home = new_dir(links.sparkSession, "pair-counts")
    counts.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(home)
    names = [c for c in links.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["links"]
            codes = np.frombuffer(b"".join([x.as_buffer() for x in rows]), code)
            ends = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // np.dtype(code).itemsize for x in rows])]).astype(np.int64)
            best, sums = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            for k in range(buckets if len(codes) else 0):
                own, n, marks = _bucket(f"{home}/bucket={k}", code)
                at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                hit = own[at] == codes
                best[hit], sums[hit] = marks[at[hit]], n[at[hit]]
            per_row = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (best, sums)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(v, pa.int64()) for v in per_row)], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema if f.name in names)
    return small_batches(links).mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its B id
    exceeds in the corpus), count_sum (their pairs' counts) and groups_sha256, for a byte-level BPE file A and a sentencepiece model B.

    Null and empty texts, and texts whose tokens' bytes differ from the space and the text, have zeros and ''. Ties for the highest count are
    all highest; repeated rows count each time; other columns are not read; an empty table gives no rows. Whole texts are read.
    """
    pair = pair_of(a_path, b_path)
    links = stored(aligned(docs, a_path, b_path), "links")
    return with_counts(links, pair_counts(links, pair.code, len(pair.b_size)), pair.code)
