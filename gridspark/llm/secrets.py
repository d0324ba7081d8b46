"""Secret scans: base patterns, and a character convolutional network over every other candidate.

A candidate is a piece of key-like characters that is neither a plain word nor a short number; what base findings leave of a piece is
one too. The network (numpy) reads its characters and its context: an embedding, one convolution, the maximum over each of left
context, value and right context, and a logistic output; long pieces are read by windows that overlap.

It is trained on labelled findings: base findings of the corpus, and findings planted in contexts of the corpus, both secrets of many
public formats and harmless strings made of the corpus' own words. Candidates of the corpus that nobody labelled are never used.
Of the findings, three fifths train, a fifth calibrates the output (Platt), and the last fifth sets the threshold: the highest
that keeps the stated recall of the true ones.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, with_fields

#: The base patterns, in the order of their kinds, and the least length of each (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "net")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

#: Both access and hex findings lie within such a run, and all candidates are pieces of one.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{12,}")
#: What no piece is a candidate for: a plain word or a number of fewer than 20 characters, or one character repeated.
PLAIN = re.compile(r"[A-Za-z]?[a-z]{1,18}|[A-Z]{1,19}|[0-9]{1,19}|(.)\1*")

LEFT, VALUE, RIGHT = 24, 64, 8
LENGTH = LEFT + VALUE + RIGHT
ALPHABET = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"'\n"
CODES = {c: k + 2 for k, c in enumerate(ALPHABET)}  # 0: beyond the text, 1: any other character


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points: leftmost non-overlapping for each kind, short ones dropped."""
    return _scan(text or "")[0]


def _scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Base spans, sorted, and the candidates outside them."""
    spans = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for a, b in runs:
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[kind]]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    pieces, taken = [], sorted((a, b) for a, b, _ in spans)
    for a, b in runs:
        at = a
        for start, end in [*(s for s in taken if s[1] > a and s[0] < b), (b, b)]:
            if start - at >= 12:
                pieces += [(m.start(), m.end()) for m in PIECE.finditer(text, at, start) if not PLAIN.fullmatch(m[0])]
            at = max(at, end)
    return spans, pieces


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def window(text: str, start: int, end: int) -> str:
    """Left context, value and right context in fixed places, padded with NUL; of a longer value its first ``VALUE`` characters."""
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + text[start : min(end, start + VALUE)].ljust(VALUE, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def windows_of(text: str, start: int, end: int) -> list[str]:
    """Windows over a whole value: one, or for a long value as many as cover it, each with half of the one before."""
    return [window(text, at, end) for at in range(start, max(start + 1, end - VALUE // 2), VALUE // 2)]


def as_codes(windows: Sequence[str]) -> np.ndarray:
    return np.array([[0 if c == "\0" else CODES.get(c, 1) for c in w] for w in windows], np.int64).reshape(len(windows), LENGTH)


#: The sample of labelled findings is taken evenly from so many parts of the hash range.
BINS = 16

WIDTH, DEPTH, FILTERS = 5, 8, 24
REGIONS = ((0, LEFT), (LEFT, LEFT + VALUE), (LEFT + VALUE, LENGTH))


@dataclass
class Network:
    """Weights, calibration (slope, offset) and threshold on the calibrated probability."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _forward(self, codes: np.ndarray) -> tuple:
        w = self.weights
        padded = np.pad(codes, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        at = np.arange(LENGTH)[:, None] + np.arange(WIDTH)
        seen = w["embed"][padded[:, at]].reshape(len(codes), LENGTH, WIDTH * DEPTH)
        hidden = np.maximum(0, seen @ w["conv"] + w["bias"])
        best = [hidden[:, a:b].argmax(axis=1) + a for a, b in REGIONS]
        top = np.stack([np.take_along_axis(hidden, k[:, None], axis=1)[:, 0] for k in best], axis=1)
        flat = top.reshape(len(codes), -1)
        return padded[:, at], seen, best, top, flat, flat @ w["out"] + w["last"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[k : k + 256])[-1] for k in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probability(self, windows: Sequence[str]) -> np.ndarray:
        """Calibrated probability that each window holds a secret."""
        return _sigmoid(self.slope * self.logits(as_codes(windows)) + self.offset)

    def gradient(self, codes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        at, seen, best, top, flat, logit = self._forward(codes)
        error = (_sigmoid(logit) - label) / len(label)
        grad = {"out": flat.T @ error, "last": np.array([error.sum()])}
        back = (error[:, None] * w["out"]).reshape(top.shape) * (top > 0)
        grad |= {"conv": np.zeros_like(w["conv"]), "bias": back.sum(axis=(0, 1)), "embed": np.zeros_like(w["embed"])}
        rows = np.arange(len(codes))[:, None]
        for k, place in enumerate(best):
            got = seen[rows, place]
            grad["conv"] += np.einsum("nfi,nf->if", got, back[:, k])
            inner = np.einsum("nf,if->nfi", back[:, k], w["conv"]).reshape(-1, DEPTH)
            np.add.at(grad["embed"], at[rows, place].reshape(-1), inner)
        return grad


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(windows: Sequence[str], labels: Sequence[int], recall: float = 0.98, epochs: int = 6, steps: int = 600, seed: int = 7) -> Network | None:
    """A network from labelled windows; None without findings or without others in one of the three parts (train, calibrate,
    threshold). The examples are gone through ``epochs`` times, and more often where that makes fewer than ``steps`` steps."""
    rng = np.random.default_rng(seed)
    codes, label = as_codes(windows), np.array(labels, float)
    part = np.zeros(len(label), np.int64)  # 0: train, 1: calibrate, 2: threshold
    for value in (0.0, 1.0):
        mine = rng.permutation(np.flatnonzero(label == value))
        part[mine[::5]], part[mine[1::5]] = 1, 2
    if any(len(np.unique(label[part == k])) < 2 for k in range(3)):
        return None
    net = Network({"embed": rng.normal(0, 0.5, (len(ALPHABET) + 2, DEPTH)), "conv": rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 3 * FILTERS), "last": np.zeros(1)})
    x, y = codes[part == 0], label[part == 0]
    mean, square = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in "ab")
    step = 0
    for _ in range(max(epochs, -(-steps * 128 // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            step += 1
            for name, g in net.gradient(x[order[k : k + 128]], y[order[k : k + 128]]).items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                net.weights[name] -= 0.005 * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    net.slope, net.offset = platt(net.logits(codes[part == 1]), label[part == 1])
    found = np.sort(_sigmoid(net.slope * net.logits(codes[(part == 2) & (label == 1)]) + net.offset))
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets."""
    ones = label.sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    both, beta = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(both @ beta)
        hessian = both.T @ (both * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, both.T @ (p - target))
        beta -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _some(rng: random.Random, of: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(of) for _ in range(rng.randint(low, high or low)))


_LOWER, _UPPER, _DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits
_ALNUM, _URL = string.ascii_letters + _DIGIT, string.ascii_letters + _DIGIT + "-_"
#: Planted secrets by kind: public formats of keys and tokens, and random strings of several alphabets.
SECRETS: Mapping[str, Callable[[random.Random], str]] = {
    "github": lambda r: r.choice(["ghp_", "gho_", "ghs_"]) + _some(r, _ALNUM, 36),
    "slack": lambda r: "-".join([r.choice(["xoxb", "xoxp"]), _some(r, _DIGIT, 11, 12), _some(r, _DIGIT, 11, 12), _some(r, _ALNUM, 24)]),
    "jwt": lambda r: ".".join(["eyJ" + _some(r, _URL, 17, 40), "eyJ" + _some(r, _URL, 30, 120), _some(r, _URL, 43)]),
    "aws": lambda r: _some(r, _ALNUM + "+/", 40),
    "google": lambda r: "AIza" + _some(r, _URL, 35),
    "stripe": lambda r: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + _some(r, _ALNUM, 24, 40),
    "npm": lambda r: "npm_" + _some(r, _ALNUM, 36),
    "upper hex": lambda r: _some(r, "0123456789ABCDEF", 32, 64),
    "base64": lambda r: base64.b64encode(r.randbytes(r.randint(18, 64))).decode(),
    "base32": lambda r: _some(r, _UPPER + "234567", 26, 52),
    "mixed": lambda r: _some(r, _ALNUM, 18, 64),
    "lower": lambda r: _some(r, _LOWER + _DIGIT, 18, 48),
    "password": lambda r: _some(r, _ALNUM + "+_-", 12, 20),
}
LEADS = ("", "", "", "key ", "key is ", "Bearer ", "auth: ", "export KEY=", '"', "'", "?sig=", "credentials ", "(", "use ", "-H X-Key:")

#: Harmless strings by kind, from words of the context.
HARMLESS: Mapping[str, Callable[[random.Random, list[str]], str]] = {
    "slug": lambda r, w: "-".join(w[: r.randint(2, 6)]) + r.choice(["", f"-{r.randint(1, 2030)}"]),
    "snake": lambda r, w: "_".join(w[: r.randint(2, 5)]) + r.choice(["", f"_{r.randint(1, 99)}"]),
    "camel": lambda r, w: w[0] + "".join(x.capitalize() for x in w[1 : r.randint(2, 5)]) + r.choice(["", str(r.randint(1, 99))]),
    "constant": lambda r, w: "_".join(w[: r.randint(2, 4)]).upper() + r.choice(["", f"_{r.randint(1, 99)}"]),
    "joined": lambda r, w: "".join(w[: r.randint(2, 4)]) + r.choice(["", str(r.randint(1, 2030))]),
    "path": lambda r, w: "/".join(w[: r.randint(2, 5)]) + r.choice([".html", ".txt", "/", f"/{r.randint(1, 99999)}-{w[0]}-{w[1]}"]),
    "host": lambda r, w: f"{w[0]}{r.randint(1, 99)}-{w[1]}-{w[2]}.example.{r.choice(['com', 'org'])}",
    "number": lambda r, w: _some(r, _DIGIT, 20, 30),
    "grouped": lambda r, w: "-".join(_some(r, _DIGIT, 3, 4) for _ in range(r.randint(3, 5))),
    "time": lambda r, w: f"{r.randint(1990, 2030)}{r.choice(['-', ''])}{r.randint(10, 12)}{r.choice(['-', ''])}{r.randint(10, 28)}{r.choice(['T', '_', '-'])}{r.randint(100000, 235959)}{r.choice(['Z', '+0000', ''])}",
    "version": lambda r, w: f"{w[0]}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}-{r.choice(['rc', 'beta', 'release'])}{r.randint(1, 20)}-{w[1]}{r.randint(10, 99)}",
    "uuid": lambda r, w: "-".join(_some(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
    "rule": lambda r, w: _some(r, r.choice(["-", "=", "_"]), 1) * r.randint(6, 20) + w[0] + "-" * r.randint(6, 20),
}


def planted(context: str, make: Callable[..., str], rng: random.Random, *, words: bool = False, leads: Sequence[str] = LEADS) -> tuple[str, int, int]:
    """The context with a string put at a blank near its middle, and where that begins and ends."""
    at = context.rfind(" ", 0, len(context) // 2 + 1) + 1
    own = [w for w in re.findall("[A-Za-z]+", context) if len(w) < 20] or ["word"]
    at_word = rng.randrange(len(own))
    value = make(rng, (own[at_word:] + own * 3)[:8] if len(own) < 8 else [own[(at_word + k) % len(own)] for k in range(8)]) if words else make(rng)
    lead = rng.choice(leads)
    close = lead if lead in ('"', "'") else ")" if lead == "(" else ""
    return f"{context[:at]}{lead}{value}{close} {context[at:]}", at + len(lead), at + len(lead) + len(value)


def plants(contexts: Sequence[str], seed: int = 11, secrets: Mapping[str, Callable] = SECRETS) -> list[tuple[str, int]]:
    """Windows of the candidates in planted strings: in each context one secret (label 1) and three harmless strings (label 0)."""
    out = []
    for k, context in enumerate(contexts):
        rng = random.Random(f"{seed}:{k}:{context}")
        made = [(planted(context, secrets[rng.choice(sorted(secrets))], rng), 1)]
        made += [(planted(context, HARMLESS[rng.choice(sorted(HARMLESS))], rng, words=True), 0) for _ in range(3)]
        for (text, start, end), label in made:
            out += [(w, label) for a, b in _scan(text)[1] if a < end and b > start for w in windows_of(text, a, b)]
    return out


#: Characters of a document's middle that make a context.
CONTEXT = 240


def _sample(docs: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` of the ``total`` rows of ``docs (text)``, all if they are fewer: those whose text's hash is small enough. Rows of
    equal texts come together or not at all; null texts don't come."""
    rows = docs.select("text").where("text is not null").withColumn("place", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    return rows if total <= most else rows.where(F.col("place") < (1 << 40) * most // total)


def contexts_of(docs: DataFrame, most: int = 4000) -> list[str]:
    """Middles of at most ``most`` different documents of ``docs (text)``, those with the smallest hashes; from a sample of twice as many."""
    middle = F.substr("text", F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - CONTEXT // 2), F.lit(CONTEXT))
    chosen = _sample(docs, 2 * most, docs.count()).select("place", middle.alias("context")).distinct().orderBy("place", "context").limit(most)
    return [r.context for r in chosen.collect()]


def labelled_findings(docs: DataFrame, most: int = 4000, searched: int = 100_000) -> list[tuple[str, int]]:
    """Labelled windows from ``docs (text)``: at most ``most`` different base findings of about ``searched`` documents, those with the smallest
    hashes in each part of the hash range, and plants in at most ``most`` contexts. What reaches the driver doesn't grow with the
    documents. No documents give no findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text.as_py()
                out += [window(text, a, b) for a, b, _ in base_spans(text)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])

    found = small_batches(_sample(docs, searched, docs.count())).select("text").mapInArrow(run, "window string").distinct().withColumn("place", F.xxhash64("window"))
    found = found.withColumn("bin", F.pmod("place", F.lit(BINS)))
    order = Window.partitionBy("bin").orderBy("place", "window")
    kept = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most // BINS)
    rows = sorted(kept.select("place", "window").collect())
    return [(r.window, 1) for r in rows] + plants(contexts_of(docs, most))


def scan_secrets(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds ``found``: an array of (start, end, kind, score) for each row's whole text, base findings (score 1) and those of the
    network, by start and kind. Null and empty texts have none. A column named ``found`` is replaced; others stay."""
    docs = docs.drop("found")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, where, windows = [], [], []
            texts = [value.as_py() or "" for value in batch[text]]
            for k, value in enumerate(texts):
                spans, others = _scan(value)
                rows.append([(a, b, kind, 1.0) for a, b, kind in spans])
                if own:
                    for a, b in others:
                        mine = windows_of(value, a, b)
                        where += [(k, a, b)] * len(mine)
                        windows += mine
            best: dict[tuple[int, int, int], float] = {}
            if windows:
                for at, p in zip(where, own.probability(windows).tolist()):
                    best[at] = max(p, best.get(at, 0.0))
            hit = [(*at, p) for at, p in best.items() if p >= own.threshold]
            for k, a, b, p in merged(texts, hit):
                rows[k].append((a, b, "net", p))
            rows = [[dict(zip(("start", "end", "kind", "score"), s)) for s in sorted(r, key=lambda s: (s[0], KINDS.index(s[2])))] for r in rows]
            yield batch.append_column("found", pa.array(rows, kind))

    return small_batches(docs).mapInArrow(run, with_fields(docs, found="array<struct<start:bigint,end:bigint,kind:string,score:double>>"))


def merged(texts: Sequence[str], hits: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """(text, start, end, score): found pieces of one value, which a single mark parts, as one span with its padding."""
    out: list[tuple[int, int, int, float]] = []
    for k, a, b, p in sorted(hits):
        while b < len(texts[k]) and texts[k][b] == "=":
            b += 1
        if out and out[-1][0] == k and a - out[-1][2] <= 1 and texts[k][out[-1][2] : a] in ("", ".", "/", "="):
            k, a, _, q = out.pop()
            p = max(p, q)
        out.append((k, a, b, p))
    return out
