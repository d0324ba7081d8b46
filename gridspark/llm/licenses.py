"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into words; of every ``WINDOW`` successive ``GRAM``-word hashes the smallest is kept. An inverted
index from these to (template, offset) meets the fingerprints of a document, which are made the same way: any shared
stretch of ``GRAM + WINDOW - 1`` words shares one. Hits on near diagonals are a candidate; the longest common subsequence
within a band around them gives the share of the template that is there and where it lies. Bands have a bounded width, and each copy is aligned by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .license_texts import TEMPLATES
from .words import word_spans, words_of

GRAM, WINDOW = 3, 2
#: Words of templates that a task holds at once; more are scanned in turns.
BLOCK_WORDS = 500_000

class Index:
    """Templates as word numbers and the inverted index of their fingerprints."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in templates]
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64) for _, text in templates]
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            for at, code in zip(*(x.tolist() for x in winnow(words))):
                self.posts[code].append((k, at))
        self.codes = np.array(sorted(self.posts), np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], np.int64)

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By template: the positions (first row) and diagonals (second) of all shared fingerprints, by diagonal, then position."""
        at, codes = winnow(words)
        if not len(at) or not len(self.codes):
            return {}
        near = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[near] == codes
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for pos, code in zip(at[hit].tolist(), codes[hit].tolist()):
            for k, offset in self.posts[code]:
                found[k].append((pos, pos - offset))
        return {k: (lambda x: x[:, np.lexsort((x[0], x[1]))])(np.array(v, np.int64).T) for k, v in found.items()}


def stretches(index: Index, k: int, hits: np.ndarray, words: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
    """The matched pairs of every stretch that covers at least ``least`` of template k.

    Hits on near diagonals are a cluster, which is aligned in a band around it. A cluster that is wider than half the template, as copies chain where the
    text repeats in itself, is aligned around its densest quarter only. What a match covers is taken out of the hits, or what was
    aligned in vain, and the rest goes on: so a band has a bounded width, and each copy is found.
    """
    size, out = len(index.words[k]), []
    apart, slack, widest = max(2, size // 4), max(2, size // 8), max(4, size // 2)
    waiting = [hits]
    while waiting:
        hits = waiting.pop()
        cuts = np.flatnonzero(np.diff(hits[1]) > apart) + 1
        if len(cuts):
            waiting += np.split(hits, cuts, axis=1)[::-1]
            continue
        low, high = int(hits[1, 0]), int(hits[1, -1])
        if high - low > widest:
            upto = np.searchsorted(hits[1], hits[1] + apart, "right")
            first = int((upto - np.arange(len(upto))).argmax())
            low, high = int(hits[1, first]), int(hits[1, upto[first] - 1])
        pairs = banded(index.words[k], words, low - slack, high + slack)
        gone = (hits[1] >= low) & (hits[1] <= high)
        if pairs and len(pairs) >= least * size:
            pairs = tightest(index.words[k], words, pairs[-1][1], low - slack, high + slack)
            out.append(pairs)
            covered = (hits[0] >= pairs[0][1]) & (hits[0] <= pairs[-1][1])
            gone = covered if covered.any() else gone
        if not gone.all():
            waiting.append(hits[:, ~gone])
    return out


def winnow(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest n-gram of every window. N-grams with an unknown word are never the smallest."""
    size = len(words) - GRAM + 1
    if size < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code, known = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(GRAM):
        part = words[k : k + size]
        known &= part > 0
        code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(32)
    if not known.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code[~known] = np.iinfo(np.uint64).max
    windows = np.lib.stride_tricks.sliding_window_view(code, min(WINDOW, size))
    at = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    at = at[known[at]]
    return at, code[at]


def banded(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Longest common subsequence of template position i and word i + d, for d from low to high: the matched pairs."""
    rows, band = len(template), high - low + 1
    best = np.zeros((rows + 1, band), np.int32)
    padded = np.full(rows + band, -1, np.int64)
    first, last = max(0, low), min(len(words), low + rows + band)
    padded[first - low : max(first, last) - low] = words[first:last]
    for i in range(rows):
        row = best[i] + (padded[i : i + band] == template[i])
        row[:-1] = np.maximum(row[:-1], best[i, 1:])
        best[i + 1] = np.maximum.accumulate(row)
    pairs, i, k = [], rows, int(best[rows].argmax())
    while i > 0:
        if k > 0 and best[i, k] == best[i, k - 1]:
            k -= 1
        elif k + 1 < band and best[i, k] == best[i - 1, k + 1]:
            i, k = i - 1, k + 1
        else:
            if padded[i - 1 + k] == template[i - 1] and best[i, k] == best[i - 1, k] + 1:
                pairs.append((i - 1, i - 1 + k + low))
            i -= 1
    return pairs[::-1]


def tightest(template: np.ndarray, words: np.ndarray, end: int, low: int, high: int) -> list[tuple[int, int]]:
    """A longest common subsequence that ends at word ``end`` at the latest and begins as late as it can: the alignment of both, read backwards."""
    last = len(template) - 1
    back = banded(template[::-1], words[: end + 1][::-1], end - last - high, end - last - low)
    return [(last - i, end - w) for i, w in reversed(back)]


def matches(index: Index, text: str | None, least: float) -> list[dict]:
    """Each stretch of a text that covers at least ``least`` of a template, by start. Of stretches that overlap, the one with the
    most matched words times coverage stays, of equal ones the shortest, the first, then the first name."""
    if not text or not index.hits(index.numbers(words_of(text))):
        return []
    found, starts, ends = word_spans(text)
    words = index.numbers(found)
    out: dict[tuple[str, int, int], dict] = {}
    for k, hits in index.hits(words).items():
        for pairs in stretches(index, k, hits, words, least):
            start, end = starts[pairs[0][1]], ends[pairs[-1][1]]
            out[index.names[k], start, end] = {"license": index.names[k], "coverage": len(pairs) / len(index.words[k]), "matched": len(pairs), "start": start, "end": end}
    kept: list[dict] = []
    for r in sorted(out.values(), key=lambda r: (-r["coverage"] * r["matched"], r["end"] - r["start"], r["start"], r["license"])):
        if all(r["end"] <= o["start"] or o["end"] <= r["start"] for o in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: r["start"])


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row for each match in ``docs (doc_id, text)``: doc_id, license, coverage (of the template), matched (words), start and
    end (code points).

    Null and empty texts match nothing; templates of fewer than three words match nothing; repeated documents and templates give
    repeated rows. Other columns are not read. The whole text is read.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, coverage double, matched long, start long, end long"
    blocks, size = [[]], 0
    for name, text in templates:
        if size > BLOCK_WORDS:
            blocks, size = [*blocks, []], 0
        blocks[-1].append((name, text))
        size += len(text) // 4
    return reduce(DataFrame.unionByName, [_scan(small_batches(docs).select("doc_id", "text"), Index(b), least, schema) for b in blocks])


def _scan(docs: DataFrame, index: Index, least: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        fields = [("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
        for batch in batches:
            rows = [{"doc_id": doc} | m for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]) for m in matches(own, text.as_py(), least)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", batch["doc_id"].type), *fields]))

    return docs.mapInArrow(run, schema)
