"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language in order. A document's own list is compared with
each profile: every n-gram adds the distance between its two ranks, or the whole length of a profile where it is
missing there. The nearest language wins.

Texts are lower-cased; every run of non-letters is one boundary mark. An n-gram is a 39-bit integer, 13 bits a
code point (``code & 8191``: distinct for all alphabets below U+2000; above, characters 8192 apart share a code).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, with_fields

BITS, MASK = 13, 8191
BOUNDARY = 32
#: Counts are merged when a task holds this many n-grams.
MERGE_AT = 4_000_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_codes(text: str | None) -> np.ndarray:
    """All n-grams of a text; empty if it is null or has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.flatnonzero(letter)[-1] + 1 :] = False
    points = np.where(letter, points & MASK, BOUNDARY)[keep].astype(np.int64)
    marks = np.empty(points.size + 2, np.int64)
    marks[0] = marks[-1] = BOUNDARY
    marks[1:-1] = points
    two = (marks[:-1] << BITS) | marks[1:]
    three = (two[:-1] << BITS) | marks[2:]
    return np.concatenate([points[points != BOUNDARY], two, three])


def top_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, by falling count, ties to the smaller code."""
    codes, counts = np.unique(codes, return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """``ranks[i, l]``: rank of n-gram ``codes[i]`` (sorted) in language ``langs[l]``, or ``size`` where missing."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the mean rank distance as a share of the profile's length; (``und``, 0) without letters."""
        own = top_codes(ngram_codes(text), self.size)
        if not own.size or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        theirs = np.where(known[:, None], self.ranks[at], self.size)
        apart = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(own.size)[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * own.size))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[np.ndarray]] = {}
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def merge() -> None:
        for lang, parts in waiting.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            if lang in counted:
                both = np.concatenate([counted[lang][0], codes])
                weights = np.concatenate([counted[lang][1], counts])
                codes, inverse = np.unique(both, return_inverse=True)
                counts = np.bincount(inverse, weights=weights).astype(np.int64)
            counted[lang] = codes, counts
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            codes = ngram_codes(text.as_py())
            if codes.size:
                waiting.setdefault(lang.as_py(), []).append(codes)
                held += codes.size
            if held > MERGE_AT:
                merge()
                held = 0
    merge()
    for lang, (codes, counts) in counted.items():
        for at in range(0, len(codes), 50_000):
            part = codes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 50_000])], ["lang", "code", "n"])


def learn_profiles(labelled: DataFrame, size: int = 400) -> Profiles:
    """Profiles from all rows of ``labelled (text, lang)``; rows with null lang or no letters teach nothing.

    Only ``size`` rows for each language reach the driver.
    """
    counts = small_batches(labelled).where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).collect()
    langs = sorted({r.lang for r in top})
    codes = np.unique(np.array([r.code for r in top], np.int64))
    ranks = np.full((len(codes), len(langs)), size, np.int64)
    for r in top:
        ranks[np.searchsorted(codes, r.code), langs.index(r.lang)] = r.rank
    return Profiles(langs, codes, ranks, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1; both names may be chosen) from the whole text alone; other columns stay as they are.

    Null texts and texts without a letter are ``und`` with score 0; so is all if nothing was learned. Ties go to the first
    language by code point. Columns of these two names in the input are replaced.
    """
    docs = docs.drop(lang_pred, score)
    schema = with_fields(docs, **{lang_pred: "string", score: "double"})
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch[text]]
            yield batch.append_column(lang_pred, pa.array([f[0] for f in found], pa.string())).append_column(score, pa.array([f[1] for f in found], pa.float64()))

    return small_batches(docs).mapInArrow(run, schema)
