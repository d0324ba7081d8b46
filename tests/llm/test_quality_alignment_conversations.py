"""Operators 11 to 13: held-out accuracy, and comparison with plain brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import alignment as A
from gridspark.llm import conversations as V
from gridspark.llm import quality as G
from gridspark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Quality


def test_quality_of_held_out_documents(spark):
    found = {r.doc_id: r for r in QUERIES["op11_quality"](spark, "/root/testdata/sf0.01").collect()}
    docs = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted(found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in found and found[r.doc_id].held_out]
    assert sum(q == r.predicted for q, r in labels) >= 0.95 * len(labels)


def test_scores_come_from_texts_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = G.learn_quality(docs, labels)
    rows = [(1, "x y z.", 0.5, None), (2, "x y z.", 0.7, "b"), (None, None, None, None), (4, "", 1.0, ""), (5, "é 漢字 " * 50_000, 1.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, features string")
    out = G.score_quality(df, model).collect()
    assert [c for c in G.score_quality(df, model).columns] == ["doc_id", "text", "features", "score"]
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] and by[None] == by[4] and all(0 <= x <= 1 for x in by.values())
    assert {r.doc_id: r.features for r in out}[2] == "b"
    assert G.score_quality(df.limit(0), model).count() == 0


def test_learning_without_labels_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, label int")
    assert G.learn_quality(docs, none).score(np.zeros((1, len(G.NAMES)))) == pytest.approx(0.5)
    ones = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, label int")
    assert G.learn_quality(docs, ones).score(np.zeros((2, len(G.NAMES)))).tolist() == pytest.approx([3.5 / 4] * 2)


def test_sample_is_bounded_however_often_an_id_is_there(spark):
    docs = spark.createDataFrame([(1, f"word {k}") for k in range(200)], "doc_id long, text string")
    seen = []
    fit, G.fit = G.fit, lambda x, y: seen.append(len(y))
    try:
        G.learn_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"), most=20)
    finally:
        G.fit = fit
    assert seen == [20]


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(3)
    rows = rng.random((4000, len(G.NAMES)))
    labels = ((rows[:, 0] > 0.5) == (rows[:, 1] > 0.5)).astype(int)  # neither number tells anything alone
    model = G.fit(rows, labels)
    assert {(f, g) for f, g, *_ in model.pairs} >= {(1, 0)}
    assert ((model.score(rows) > 0.5) == labels).mean() > 0.95


def test_one_label_depends_on_one_number():
    rng = np.random.default_rng(4)
    rows = rng.random((3000, len(G.NAMES)))
    model = G.fit(rows, (rows[:, 5] > 0.7).astype(int))
    strength = [np.ptp(t) for t in model.single]
    assert int(np.argmax(strength)) == 5 and np.all(np.diff(model.single[5]) > -0.5)


# Alignment

_A = Tokenizer.from_file(BYTE_BPE)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
_BYTE = {c: bytes([k]) for k, c in enumerate(A._byte_letters())}


def brute_alignment(text):
    """Token ids, spans, links and groups of one text, by plain loops."""
    if not text:
        return [], [], [], ""
    a, b = _A.encode(" " + text, add_special_tokens=False), _B.encode(text)
    own_a = [b"".join(_BYTE[c] for c in t) for t in a.tokens]
    own_b = [bytes([int(_B.id_to_piece(i)[3:5], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
        return [], [], [], ""
    ends_a, ends_b = list(itertools.accumulate(map(len, own_a))), list(itertools.accumulate(map(len, own_b)))
    spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
    links, first = [], 0
    for i, (s, e) in enumerate(spans_a):
        while spans_b[first][1] <= s:
            first += 1
        j = first
        while j < len(spans_b) and spans_b[j][0] < e:
            links.append((a.ids[i], b[j]))
            j += 1
    cuts = [0, *sorted(set(ends_a) & set(ends_b))]
    within = lambda ids, ends, x, y: ",".join(str(k) for k, e in zip(ids, ends) if x < e <= y)
    return a.ids, b, links, ";".join(f"{within(a.ids, ends_a, x, y)}|{within(b, ends_b, x, y)}" for x, y in zip(cuts, cuts[1:]))


def checked_alignment(rows, found):
    each = [brute_alignment(t) for _, t in rows]
    n = Counter(x for _, _, links, _ in each for x in links)
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    expected = sorted(
        (repr(d), len(a), len(b), groups.count(";") + bool(groups), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for (d, _), (a, b, links, groups) in zip(rows, each)
    )
    got = sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found)
    assert got == expected


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows]
    checked_alignment(rows, QUERIES["op12_alignment"](spark, DATA).collect())


ODD = ["a", "the", "Ing", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "é", "é", "漢", "字", "▁", ".", ";", "'s", "<s>", "<|endoftext|>", "\x00", "😀", "12", " ", "ﬁ", "\x85", "\x1c", " \t ", "\r"]


def test_alignment_of_odd_texts_and_repeats(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (None, " "), (3, "\n"), (3, "a "), (3, "a "), (4, "▁ is not a blank")] + [(10 + k, "".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 25)))) for k in range(1500)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, links string")
    checked_alignment(rows, A.align_tokenizers(df, BYTE_BPE, PIECES).collect())
    assert A.align_tokenizers(df.limit(0), BYTE_BPE, PIECES).count() == 0


def test_counts_in_many_buckets(spark, monkeypatch):
    rows = [(r.doc_id, r.text[:2000]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    monkeypatch.setattr(A, "BUCKET", 500)
    checked_alignment(rows, A.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE, PIECES).collect())


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_have_equal_work_and_lose_nothing(piece):
    rng = np.random.default_rng(piece)
    for _ in range(60):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, 40)), end)) for _ in range(2))
        i, j = A.diagonals(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and i[-1] == len(a) and j[-1] == len(b)
        left, right, close_a, close_b = A.merge(a, b, piece)
        starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert list(zip(left, right)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if starts_a[x] < b[y] and starts_b[y] < a[x]]
        common = np.intersect1d(a, b)
        assert a[close_a - 1].tolist() == b[close_b - 1].tolist() == common.tolist()


def test_groups_have_their_bytes(spark):
    text = "Naïve cafés; <|endoftext|>\n\n  漢字 \t end"
    df = spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string")
    rows = A.token_groups(df, BYTE_BPE, PIECES).orderBy("start").collect()
    assert {r.doc_id for r in rows} == {7} and [r.start for r in rows] == [0] + [r.end for r in rows[:-1]] and rows[-1].end == len((" " + text).encode())
    assert ";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in rows) == brute_alignment(text)[3]


# Conversations

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            one = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [one] * (2 if kind == 3 else 1)
    return out


def all_repairs(rows, faults):
    """Every way of editing that can be cheapest: a plain search over all choices, with up to two inserts in each gap."""
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    ways = []
    for (role, text), fault in zip(rows, faults):
        own = [("D", None, 4)]
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            own += [("K", role, extra), ("R", "user", 3 + extra), ("R", "assistant", 3 + extra)]
        ways.append(own)
    for choice in itertools.product(*ways):
        base = sum(c for *_, c in choice)
        if best and base > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k, gap in enumerate(gaps):
                audit += "I" * len(gap)
                lines += [f"{r}:" for r in gap]
                if k < len(rows):
                    audit += choice[k][0]
                    if choice[k][1] is not None:
                        lines.append(f"{choice[k][1]}:{rows[k][1]}")
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(lines)
    return best


def facts(conv, rows):
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = text.strip(BLANK)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [(r[2], r[3]) for r in rows], faults, max(turns) - min(turns) + 1 - len(turns) if turns else 0, illegal


def make_rows(seed, convs, most):
    rnd = random.Random(seed)
    out = []
    for c in [*range(convs), None]:
        for _ in range(rnd.randint(1, most)):
            turn = rnd.choice([None, *range(6)])
            out.append((c, turn, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice(["a.", "b!", "c", " ", None, "", "d?", "e. ", "f\x0b"])))
    return out


def test_small_conversations_by_search(spark):
    rows = make_rows(1, 60, 3)
    found = V.repair_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost long")).collect()
    after = damaged(rows)
    assert {r.conv_id for r in found} == {r[0] for r in rows} and len(found) == len({r[0] for r in rows})
    for r in found:
        pairs, faults, gaps, illegal = facts(r.conv_id, after)
        cost, audit, text = all_repairs(pairs, faults)
        count = Counter(faults)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (pairs, faults)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (gaps, count["blank"], count["duplicate"], count["truncated"], illegal)


@pytest.mark.parametrize(("block", "at_once"), [(1, 2), (3, 2), (7, 64)])
def test_blocks_change_nothing(spark, monkeypatch, block, at_once):
    rows = make_rows(block, 3, 40) + [(7, k // 3, "user" if k % 2 else "assistant", "same." if k % 5 else f"{k}") for k in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(V.repair_conversations(df).collect(), key=repr)
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "AT_ONCE", at_once)
    assert sorted(V.repair_conversations(df).collect(), key=repr) == whole
    after = damaged(rows)
    for r in whole:
        pairs, faults, gaps, illegal = facts(r.conv_id, after)
        assert (r.cost, r.audit) == V.repair(pairs, faults) and (r.gaps, r.illegal) == (gaps, illegal)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(V.apply(pairs, r.audit, V.START)).encode()).hexdigest()


def test_nothing_and_undamaged(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a.")], "conv_id long, turn long, role string, text string")
    assert V.repair_conversations(df.limit(0)).count() == 0
    row = V.repair_conversations(df, damaged=False).collect()[0]
    assert (row.audit, row.cost, row.repaired_sha256) == ("KKK", 0, hashlib.sha256(b"system:s.\nuser:u.\nassistant:a.").hexdigest())


def test_conversation_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    found = c.execute(ORACLES["op13_conversations"])
    names = [x[0] for x in found.description]
    assert sorted(repr(tuple(r)) for r in QUERIES["op13_conversations"](spark, d).select(*names).collect()) == sorted(map(repr, found.fetchall()))
