import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridspark.llm import huffman as H
from gridspark.llm import mixing as M
from gridspark.llm import token_output as O
from gridspark.llm.tokens import WordEncoder, with_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, rest = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[t] for t in open_) for s in open_} if open_ else {}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return full | share
        for s in above:
            full[s] = 2.0 * sizes[s]
            rest -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 50}, {"a": 0, "b": 10}, {"z": 5}, {"a": 0}, {"a": 10, "b": 500, "c": 1, "d": 900, "e": 30, "é": 7}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    found = {r.source: r.target for r in M.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    for _ in range(50):
        sizes, p = [rng.randrange(0, 50) for _ in range(60)], [rng.random() for _ in range(60)]
        moved = M.flight(sizes, p, rng)
        assert sum(1e-9 < x < 1 - 1e-9 for x in moved) <= 2 and all(-1e-9 <= x <= 1 + 1e-9 for x in moved)
        assert sum(moved) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(moved, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)))


def test_flight_keeps_inclusion_probabilities():
    sizes, p = [3, 9, 1, 4, 7, 7], [0.3, 0.7, 0.5, 0.5, 0.2, 0.8]
    total = np.zeros(6)
    for seed in range(6000):
        total += M.flight(sizes, p, random.Random(seed))
    assert np.abs(total / 6000 - p).max() < 0.03


@pytest.mark.parametrize("block", [8, 1024])
def test_mix_meets_targets_and_agrees(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "a", "a", "b", "c", None]), "x") for k in range(600)] + [(7, None, "a", "x"), (8, "", "b", "x"), (9, "w w", "b", "x"), (9, "w w", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    found = M.mix(docs).collect()
    assert len(found) == len(rows)
    target, taken, largest = {}, {}, {}
    for r in found:
        assert r.copies in (0, 1, 2)
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mix_cases(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    only = M.mix(spark.createDataFrame([(1, None, None, "x"), (2, " ", "a", "x")], schema)).collect()
    assert [(r.size, r.copies) for r in only] == [(0, 0), (0, 0)]
    docs = spark.createDataFrame([(k, "a b c d", "s", "x") for k in range(10)], schema)
    again = M.repeated(M.mix(docs), docs.columns)
    assert again.columns == docs.columns and again.count() == 15


@pytest.mark.parametrize("limit", [None, 4, 6])
def test_code_lengths_are_optimal(limit):
    rng = random.Random(limit or 1)
    for n in (1, 2, 3, 9, 14):
        counts = np.array([rng.choice([0, 1, 2, 30, 500]) for _ in range(n)])
        counts[rng.randrange(n)] = 5
        lengths = H.code_lengths(counts, limit)
        used = counts > 0
        assert ((lengths > 0) == used).all()
        if used.sum() > 1:
            assert sum(2.0 ** -int(x) for x in lengths[used]) <= 1 + 1e-12
            assert limit is None or lengths.max() <= limit
            heap = sorted(counts[used].tolist())
            cost = 0
            while len(heap) > 1:
                a, b = heap.pop(0), heap.pop(0)
                cost += a + b
                heap = sorted([*heap, a + b])
            own = int((lengths[used].astype(int) * counts[used]).sum())
            assert own == cost if limit is None else own >= cost


def test_limited_lengths_against_brute_force():
    counts = np.array([1, 1, 2, 4, 50])
    best = min(sum(a * b for a, b in zip(x, counts)) for x in itertools.product(range(1, 4), repeat=5) if sum(2.0**-k for k in x) <= 1)
    assert int((H.code_lengths(counts, 3).astype(int) * counts).sum()) == best


def test_codec_round_trip_by_blocks():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 9000) % 5000, [7] * 3000]).astype(np.int64)
    counts = np.array([0, 1, 1023, 1024, 1025, 5000, 0, 3927])
    assert counts.sum() == len(ids)
    codec = H.Codec(H.code_lengths(np.bincount(ids, minlength=5000)))
    data, first, marks = codec.encode(ids, counts)
    blocks = (counts + H.BLOCK - 1) // H.BLOCK
    at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes = np.minimum(H.BLOCK, np.repeat(counts, blocks) - at * H.BLOCK)
    starts = np.repeat(first[:-1] * 8, blocks) + marks
    assert (codec.decode(data, starts, sizes) == ids).all()
    one = int(np.flatnonzero(sizes == H.BLOCK)[2])  # a block on its own
    before = int(sizes[:one].sum())
    assert (codec.decode(data, starts[one : one + 1], sizes[one : one + 1]) == ids[before : before + H.BLOCK]).all()


TEXTS = ["Hello, World! it's  don't\n\ttabs", "", None, "ÀÉÎ ñandú straße ΑΣ. ΑΣΑ İstanbul", "12345 3.14 $$$ &&& a|b", "x<|endoftext|>y <|ENDOFTEXT|> z", "日本語 テキスト 🙂🙂", "é ́x Å ﬁ", "a b c\x1cd\x85e", "word " * 5000, "'s 're x's. y',z", "thinly.\nInha,", "mixed42words a1b2 _under_score-dash", "<|startoftext|>"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_encode_as_whole_texts(path):
    own = WordEncoder(path)
    assert own.by_word == (path == WORDS)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(TEXTS, own.encode(TEXTS)):
            assert np.frombuffer(ids, own.dtype).tolist() == (own.library.encode(text, add_special_tokens=False).ids if text else [])


@pytest.mark.parametrize("size", [50, 4_000_000])
def test_files_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(O, "FILE_IDS", size)
    rows = [(k * 3 % 31, t, 5) for k, t in enumerate(TEXTS)] + [(None, "null id", 5), (2, "same id", 5), (2, "same id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    library = WordEncoder(WORDS).library
    files = O.token_files(docs, WORDS, 2)
    found = O.read_files(files).collect()
    expected = sorted((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, (library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)
    assert (files.count() > 5) == (size == 50)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert O.read_files(O.token_files(empty, WORDS, 2)).count() == 0
    assert with_ids(empty, WORDS, 2).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a b c\x0bd\n",), (None,), ("",), (" ",), ("\x1c",)], "text string")
    assert [r[0] for r in df.select(M.word_count(F.col("text"))).collect()] == [3, 0, 0, 0, 1]


def test_tails_are_probed():
    """A tokenizer that keeps punctuation with its word is told from one that cuts it off."""
    import json

    import public_tokenizers
    from gridspark.llm.tokens import TAIL, WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    own = WordEncoder(path)
    assert set(own.tail) <= set(TAIL)
    changed = json.loads(own.library.to_str())
    changed["pre_tokenizer"] = {"type": "WhitespaceSplit"}
    other = WordEncoder.__new__(WordEncoder)
    other.library = type(own.library).from_str(json.dumps(changed))
    tails = other._cut_off()
    for text in ("word.", "end!?", "a,b,", "(x)"):
        assert own.encode([text]) == [own.whole(text)]
        ids = other.library.encode(text, add_special_tokens=False).ids
        core = text.encode().rstrip(tails).decode() if tails else text
        assert ids == other.library.encode(core, add_special_tokens=False).ids + other.library.encode(text[len(core) :], add_special_tokens=False).ids


def test_stored_tables_are_deleted_with_their_scope(spark):
    from gridspark.llm.common import discard, scratch, stored

    with scratch() as made:
        gone = stored(spark.range(3).toDF("n"), "t")
        kept = stored(spark.range(4).toDF("n"), "t")
        with scratch():
            inner = stored(spark.range(1).toDF("n"), "t")
        made.remove(kept)
    exists = lambda df: spark._jvm.java.io.File(df.stored_at.removeprefix("file:")).exists()
    assert exists(kept) and not exists(gone) and not exists(inner) and kept.count() == 4
    discard(kept)
    assert not exists(kept)


def test_a_row_repeated_very_often_is_dealt_out(spark, monkeypatch):
    from gridspark.llm import mixing as M

    monkeypatch.setattr(M, "BLOCK", 50)
    docs = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 1 ELSE id END AS doc_id", "CASE WHEN id < 600 THEN 'same words here' ELSE concat('w ', id) END AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    salts = M._salted(docs.withColumn("_hash", F.xxhash64("doc_id", "text", "source"))).groupBy("doc_id", "source").agg(F.count_distinct("_salt").alias("n"), F.max("_salt").alias("most")).collect()
    assert {(r.n, r.most) for r in salts if r.doc_id != 1} == {(1, 0)} and all(r.n == 6 for r in salts if r.doc_id == 1)
    mixed = M.mix(docs)
    assert mixed.count() == 900
    for r in mixed.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r.taken - r.target) <= 6
