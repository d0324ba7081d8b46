"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark's n-grams are counted in all documents first. A seed is an n-gram that is rare for its item: in at most
``rare`` of the documents, or at most four times as many as the lower quartile of those of the item's n-grams that occur,
so that an item copied into many documents keeps its seeds. A document's seed hits on near diagonals make a passage, which is aligned
with the item word by word; the score is the alignment's share of the item's full score.

The benchmark is held in blocks of at most ``BLOCK_WORDS`` words, each scanned over all documents; documents never move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches
from .words import words_of

#: Words of benchmark items that a task holds at once, and items' lengths that are aligned at once.
BLOCK_WORDS, WINDOWS = 500_000, 8

def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: +1 for equal words, -1 for others and for gaps. Returns the score and the end in the passage."""
    steps = np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, 1, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + steps) - steps
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


class Items:
    """Benchmark items as word numbers, with an index of their n-grams; an item of fewer words is one n-gram of its own length."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n, self.vocab = n, {}
        self.names = [i for i, _ in items]
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)], np.int64) for _, t in items]
        lengths = [min(n, len(w)) for w in self.words]
        grams = [grams_of(w, k)[1] for w, k in zip(self.words, lengths)]
        self.codes: dict[int, tuple[int, np.ndarray]] = {}  # by length: the number of the first n-gram, and all codes in order
        self.size = 0
        for k in sorted(set(lengths) - {0}):
            codes = np.unique(np.concatenate([g for g, own in zip(grams, lengths) if own == k]))
            self.codes[k] = self.size, codes
            self.size += len(codes)
        self.posts = [np.searchsorted(self.codes[k][1], g) + self.codes[k][0] if k else np.empty(0, np.int64) for g, k in zip(grams, lengths)]  # the number of each item's n-gram, by offset

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document, and the numbers of the benchmark's n-grams there."""
        places, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, (first, codes) in self.codes.items():
            at, own = grams_of(words, k)
            if len(at):
                number = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                same = codes[number] == own
                places.append(at[same])
                numbers.append(number[same] + first)
        return np.concatenate(places), np.concatenate(numbers)

    def choose(self, df: np.ndarray, documents: int, rare: float) -> None:
        """Keeps the rare n-grams of each item; ``places`` lists where each occurs."""
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, numbers in enumerate(self.posts):
            seen = df[numbers][df[numbers] > 0]
            if len(seen):
                short = len(self.words[item]) < self.n  # matches as it is, however common
                most = documents if short else max(rare * documents, 4 * np.quantile(seen, 0.25))
                for offset, number in enumerate(numbers.tolist()):
                    if df[number] <= most:
                        self.places[number].append((item, offset))

    def matches(self, text: str | None, least: float) -> list[dict]:
        """The passages of each item that score at least ``least``: of a stretch with seeds the best (of equal ones the first), then those on its
        left and right, until none is left. Of overlapping ones the best, then the first, stays."""
        words = self.numbers(text)
        at, numbers = self.hits(words)
        starts: dict[int, list[int]] = defaultdict(list)
        for pos, number in zip(at.tolist(), numbers.tolist()):
            for item, offset in self.places.get(number, ()):
                starts[item].append(pos - offset)
        out = []
        for item, found in starts.items():
            own = self.words[item]
            found = np.unique(found)
            passages: set[tuple[int, int, int]] = set()
            for group in np.split(found, np.flatnonzero(np.diff(found) > len(own) // 2) + 1):
                low, high = max(0, int(group[0]) - len(own) // 2), min(len(words), int(group[-1]) + len(own) * 3 // 2 + 1)
                passages.update(self._passages(own, words, low, high, least))
            begins: list[int] = []  # of the kept passages, and their ends, in order
            ends: list[int] = []
            for score, start, end in sorted(passages, key=lambda p: (-p[0], p[1], p[2])):
                k = bisect_left(begins, start)
                if (k == 0 or ends[k - 1] <= start) and (k == len(begins) or end <= begins[k]):
                    begins.insert(k, start)
                    ends.insert(k, end)
                    out.append({"item_id": self.names[item], "score": score / len(own), "start_word": start, "end_word": end})
        return out

    def _passages(self, own: np.ndarray, words: np.ndarray, low: int, high: int, least: float) -> list[tuple[int, int, int]]:
        """(score, start, end) of the passages in words[low:high], by start. Long stretches are read in windows of ``WINDOWS`` items' lengths that
        overlap by two: alignments stay as long as an item and a window."""
        fewest, out, step = max(1, int(np.ceil(least * len(own)))), [], WINDOWS * len(own)
        while high - low >= fewest:
            upto = min(high, low + step)
            score, end = align(own, words[low:upto])
            if score < least * len(own):
                if upto == high:
                    break
                low = upto - 2 * len(own)
                continue
            _, back = align(own[::-1], words[low : low + end][::-1])
            start, end = low + end - back, low + end
            if end > upto - len(own) // 2 and upto < high and start > low + len(own):
                out += self._passages(own, words, low, start, least)  # it may go on behind the window: read it again in the next
                low = start - len(own) // 2
                low = max(low, out[-1][2]) if out else low
                continue
            out += [*self._passages(own, words, low, start, least), (score, start, end)]
            low = end
        return out


def grams_of(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes of the n-grams of known words."""
    if not 0 < n <= len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    size = len(words) - n + 1
    code, known = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        part = words[k : k + size]
        known &= part > 0
        code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    at = np.flatnonzero(known)
    return at, code[at]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, rare: float = 0.001, least: float = 0.5) -> DataFrame:
    """Items of ``benchmark (item_id, text)`` in documents of ``docs (doc_id, text)``: doc_id,
    item_id, score (0 to 1), start_word and end_word of a passage, one row for each passage.

    Null texts hold nothing. Items with fewer than ``n`` words match as they are, wherever they stand. Items without words match nothing. Repeated rows of
    either table give repeated rows; other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = -(-total // (BLOCK_WORDS * 4))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, start_word long, end_word long"
    docs = small_batches(docs).select("doc_id", "text").where("text is not null")
    found = [spark.createDataFrame([], schema)]
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = Items([(r.item_id, r.text) for r in mine], n)
        found.append(_scan(docs, index, rare, least, schema))
    return reduce(DataFrame.unionByName, found[1:] or found)


def _scan(docs: DataFrame, index: Items, rare: float, least: float, schema: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared, size = context.broadcast(index), index.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df, documents = shared.value, np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df[np.unique(own.hits(own.numbers(text.as_py()))[1])] += 1
                documents += 1
        df[-1] = documents
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["number", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        df[r.number] = r.n  # one for each n-gram of this block of items, and the number of documents
    index.choose(df[:-1], int(df[-1]), rare)
    chosen = context.broadcast(index)
    names = [part.split()[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chosen.value
        for batch in batches:
            rows = [{"doc_id": doc} | m for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]) for m in own.matches(text.as_py(), least)]
            if rows:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], pa.schema([("doc_id", batch["doc_id"].type), *_TYPES]))

    return docs.mapInArrow(scan, schema)


_TYPES = [("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, and so do rows with a null doc_id or text.

    Rows that share a doc_id with a contaminated row go with it.
    """
    name = free_name(docs, "_bad")
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
