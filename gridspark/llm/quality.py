"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

A text becomes numbers (shares of characters, words and lines; repeats; entropy), each number a bin by quantiles of the training rows. The score is the
logistic of an intercept and one looked-up value for each number and for each chosen pair of numbers. The tables are learned in
cycles: each step fits a tree of at most ``LEAVES`` leaves to one number's gradient histogram and adds a small share of it to its table,
number after number, round after round, so that numbers that tell the same share the credit. Pairs are ranked by the gain of
one cut in each number on what the single tables leave, and learned likewise. The rounds are those that do best on rows set aside.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_fields

BINS, PAIR_BINS, LEAVES, PAIRS = 32, 8, 4, 8
ROUNDS, RATE, LEAST_ROWS, SHRINK = 150, 0.15, 10, 5.0
NAMES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "blanks", "marks", "others", "word_bytes", "distinct_words", "top_word", "distinct_pairs", "repeated_neighbours", "capital_words", "long_words", "short_words",
    "lines", "distinct_lines", "line_bytes", "ended_lines", "byte_entropy", "word_entropy", "bangs", "packed",
)

_CLASS = np.full(256, 5, np.uint8)  # 0 letters, 1 upper, 2 digits, 3 blanks, 4 marks, 5 others
for _k in range(128):
    _c = chr(_k)
    _CLASS[_k] = 1 if _c.isupper() else 0 if _c.isalpha() else 2 if _c.isdigit() else 3 if _c in " \t\n\r\x0b\x0c" else 4
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes that are packed at once: a whole text is packed in such pieces.
PACK = 1 << 16


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def features(text: str | None) -> list[float]:
    """The numbers of NAMES for a whole text; null is as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=6)
    words = raw.split() if b"\x1c" not in raw else _WORD.findall(raw)
    n = max(1, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    counts = np.bincount(ids)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(np.unique(ids[:-1] * len(number) + ids[1:])) if len(ids) > 1 else 0
    starts = np.fromiter((w[0] for w in words), np.uint8, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    many = max(1, len(lines))
    packed = sum(len(zlib.compress(raw[k : k + PACK], 1)) for k in range(0, len(raw), PACK))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (kinds[0] + kinds[1]) / size, kinds[1] / max(1, kinds[0] + kinds[1]), kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size,
        lengths.sum() / n, len(number) / n, counts.max(initial=0) / n, pairs / max(1, n - 1), (ids[1:] == ids[:-1]).sum() / n, (_CLASS[starts] == 1).sum() / n, (lengths > 12).sum() / n, (lengths < 4).sum() / n,
        np.log1p(len(lines)), len(set(lines)) / many, np.log1p(len(raw) / many), sum(x.rstrip()[-1:] in b".!?" for x in lines) / many, _entropy(seen), _entropy(counts) / np.log2(n + 1), seen[33] / size, packed / size,
    ]


@dataclass
class Model:
    """``cuts[f]``: upper edges of the bins of number f; ``single[f][bin]``; ``pairs``: (f, g, cuts of f, cuts of g, table)."""

    cuts: list[np.ndarray]
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of many rows: bins by binary search, then table look-ups added up."""
        total = np.full(len(rows), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.single)):
            total += table[np.searchsorted(cuts, rows[:, f], "left")]
        for f, g, cuts_f, cuts_g, table in self.pairs:
            total += table[np.searchsorted(cuts_f, rows[:, f], "left"), np.searchsorted(cuts_g, rows[:, g], "left")]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 different edges, each a value that occurs."""
    found = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower")) if len(values) else np.empty(0)
    return found[found < values.max(initial=-np.inf)]


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The step of each bin: the bins in order, cut where the gain is largest until there are ``leaves`` parts or no cut gains; a part's step is its
    gradient over its weight."""
    g, w, n = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, weight, rows))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + SHRINK)

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        k = k[(n[k] - n[a] >= LEAST_ROWS) & (n[b] - n[k] >= LEAST_ROWS)]
        if not len(k):
            return 0.0, -1
        gains = worth(a, k) + worth(k, b) - worth(a, b)
        at = int(gains.argmax())
        return float(gains[at]), int(k[at])

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        (gain, k), (a, b) = max(((best(*p), p) for p in parts), key=lambda x: x[0][0])
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (w[b] - w[a] + SHRINK)
    return step


def one_cut_each(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of a two-way table in four by one cut in each direction."""
    sums = [x.cumsum(0).cumsum(1) for x in (gradient, weight, rows)]
    parts = []
    for s in sums:
        top, left, all_ = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        inner = s[:-1, :-1]
        parts.append(np.stack([inner, top - inner, left - inner, all_ - top - left + inner]))
    g, w, n = parts
    if not inner.size:
        return 0.0, np.zeros_like(gradient)
    gain = np.where((n >= LEAST_ROWS).all(axis=0), (g**2 / (w + SHRINK)).sum(axis=0), 0.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros_like(gradient)
    values = g[:, i, j] / (w[:, i, j] + SHRINK)
    step = np.empty_like(gradient)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - gradient.sum() ** 2 / (weight.sum() + SHRINK)), step


def _loss(total: np.ndarray, label: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(label > 0, -total, total)).mean())


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """A model from numbers and labels 0 or 1, the same for the same rows in the same order. A fifth of the rows chooses the rounds. Without rows, or with
    one label alone, it is the share of label 1 (smoothed; a half without rows)."""
    labels = labels.astype(float)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model([quantile_cuts(rows[:, f], BINS) for f in range(len(NAMES))], float(np.log(rate / (1 - rate))))
    model.single = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(np.unique(labels)) < 2:
        return model
    aside = np.arange(len(labels)) % 5 == 4
    bins = [np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(model.cuts)]
    total = np.full(len(labels), model.intercept)

    def histogram(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total[~aside]))
        own = at[~aside]
        return np.bincount(own, labels[~aside] - p, size), np.bincount(own, p * (1 - p), size), np.bincount(own, minlength=size)

    def cycles(places: list[np.ndarray], tables: list[np.ndarray], step_of) -> None:
        """Boosts the tables in turn; they end as they were in the best round."""
        nonlocal total
        best, kept, since = _loss(total[aside], labels[aside]), [t.copy() for t in tables], total.copy()
        waited = 0
        for _ in range(ROUNDS):
            for at, table in zip(places, tables):
                step = RATE * step_of(*(x.reshape(table.shape) for x in histogram(at, table.size)))
                table += step
                total = total + step.ravel()[at]
            loss = _loss(total[aside], labels[aside])
            waited += 1
            if loss < best - 1e-5:
                best, kept, since, waited = loss, [t.copy() for t in tables], total.copy(), 0
            if waited == 20:
                break
        total = since
        for table, k in zip(tables, kept):
            table[:] = k

    cycles(bins, model.single, shallow_tree)
    coarse = [quantile_cuts(rows[:, f], PAIR_BINS) for f in range(len(NAMES))]
    few = [np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(coarse)]
    ranked = []
    for f in range(len(NAMES)):
        for g in range(f):
            shape = len(coarse[f]) + 1, len(coarse[g]) + 1
            at = few[f] * shape[1] + few[g]
            gain, _ = one_cut_each(*(x.reshape(shape) for x in histogram(at, shape[0] * shape[1])))
            ranked.append((-gain, f, g, at, shape))
    chosen = sorted(ranked, key=lambda r: r[:3])[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in chosen]
    cycles([at for *_, at, _ in chosen], tables, lambda *h: one_cut_each(*h)[1])
    model.pairs = [(f, g, coarse[f], coarse[g], t) for (_, f, g, _, _), t in zip(chosen, tables)]
    return model


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``features`` (array of doubles) of it; any column of that name is replaced."""
    docs = docs.drop("features")
    schema = with_fields(docs.drop(text), features="array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(x.as_py()) for x in batch[text]], pa.list_(pa.float64()))
            yield batch.drop_columns([text]).append_column("features", found)

    return small_batches(docs).mapInArrow(run, schema)


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """A model from the ``docs (doc_id, text)`` that ``labels (doc_id, label)`` marks. Other labels than 0 and 1, and null ids, teach nothing.

    At most ``most`` labels, those whose id's hash is smallest, are looked up in all documents (they are few, so they are broadcast),
    and as many labelled rows at most reach the driver, as numbers, not texts. A document with several labels counts with each.
    """
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    picked = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(*order).limit(most)
    found = with_features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    rows = found.orderBy(*order, "features").limit(most).collect()  # again, as an id may be in many rows
    return fit(np.array([r.features for r in rows]).reshape(-1, len(NAMES)), np.array([r.label for r in rows]))


def score_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1: how likely label 1 is) from the whole text alone; a column of that name is replaced, all others stay.

    Null and empty texts are scored as texts without words. Equal texts have equal scores; an empty table gives no rows.
    """
    docs = docs.drop(score)
    schema = with_fields(docs, **{score: "double"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(x.as_py()) for x in batch[text]]).reshape(-1, len(NAMES))
            yield batch.append_column(score, pa.array(shared.value.score(rows)))

    return small_batches(docs).mapInArrow(run, schema)
