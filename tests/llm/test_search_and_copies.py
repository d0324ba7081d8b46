import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import simhash as S
from gridspark.llm import topk as K
from gridspark.llm.components import connected_components


def brute_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append(w)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


TEXTS = ["a B c d e", "A b c d e", "", None, " \t\n", "one", "one two", "É x Ê y z \x1c q", "a a a a a a", "w " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_agrees(spark):
    """The shingle hash is the one that Spark's xxhash64 gives."""
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("segments,tau", [(4, 3), (7, 3), (10, 3), (5, 2), (8, 4)])
def test_keys_and_chains_lose_no_link(segments, tau):
    """Every pattern of up to tau differing bits keeps one key whole and passes a chain."""
    rng = random.Random(1)
    masks, chains = S.key_masks(segments, tau), S.chain_masks(segments, tau)
    for _ in range(4000):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randrange(tau + 1)))
        assert any(apart & m == 0 for m in masks)
        assert any(all((apart & m).bit_count() <= n for m, n in chain) for chain in chains)


def links_of(fps, tau=3):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(9)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = S.linked(spark.createDataFrame(signed, "fp long"))
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in connected_components(edges).collect()}
    expected = links_of(fps)
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == root) for root in {m.get(k, k) for k in fps})
    assert groups(found) == groups(expected)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (7, 8)]
    random.Random(2).shuffle(edges)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


DOCS = "doc_id long, text string, lang string, fp string, component_id string"


def test_near_duplicates_cases(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(9, long), (4, long.upper()), (7, long), (3, None), (2, ""), (1, "alone here now"), (1, "alone here now"), (None, long), (20, long.replace("w7 ", "w7 x "))]
    docs = spark.createDataFrame([(i, t, "en", "f", "c") for i, t in rows], DOCS)
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[9] == by[7] == by[4] == by[None] == {4} and by[3] == by[2] == {2} and by[1] == {1}
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_keeps_every_group_and_all_columns(spark):
    long = " ".join(f"w{k}" for k in range(400))
    edited = long.replace("w100 ", "other ").replace("w250 ", "word ")
    far = " ".join(f"w{k}" if k % 4 else f"z{k}" for k in range(400))
    rows = [(5, long), (6, edited), (7, far), (8, "a b c d e f g"), (9, "a b c d e f g"), (10, None), (11, None), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "f", "c") for i, t in rows], DOCS)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == [None, 5, 7, 8, 10]


def brute_top(vectors, k):
    out = []
    for i, q in vectors:
        if i % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block", [20, 20_000])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(K, "DATA_BLOCK", block)
    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 900
    vectors = [(k, [int(x) for x in np.floor(centres[k % 6] + rng.normal(size=8) * 30)]) for k in range(900)]
    vectors += [(k, vectors[3][1]) for k in range(900, 960)]  # ties
    df = spark.createDataFrame(vectors, "id long, v array<long>")
    found = sorted(tuple(r) for r in K.top_k(df, df.where("id % 100 = 0"), k=7).collect())
    assert found == brute_top(vectors, 7)


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (100, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    vectors = K.integer_vectors(table, "vec_id", "embedding")
    assert sorted((r.id, list(r.v)) for r in vectors.collect()) == [(0, [512, -256]), (1, [1024, 1024]), (6, [1024]), (100, [1024, 1024])]
    found = sorted(tuple(r) for r in K.top_k(vectors, vectors.where("id % 100 = 0")).collect())
    assert found == [(0, 1, 1, 262144), (0, 2, 100, 262144), (100, 1, 1, 2097152), (100, 2, 0, 262144)]
    empty = vectors.where("id < 0")
    assert K.top_k(empty, empty).count() == 0 and K.top_k(vectors, empty).count() == 0
    big = spark.createDataFrame([(0, [2**62]), (1, [2**62])], "id long, v array<long>")
    with pytest.raises(ValueError, match="long"):
        K.top_k(big, big).count()


def test_similar_sets_link_and_others_do_not(spark):
    """Pairs at many similarities: from 0.85 nearly all link, below 0.7 none."""
    from gridspark.llm import parts as P

    rng = random.Random(12)
    rows, truth = [], {}
    for k in range(240):
        n = rng.choice([30, 146, 400])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(5000)) for _ in range(n)]
        other = list(words)
        for _ in range(rng.randrange(0, 1 + n // 25)):
            other[rng.randrange(n)] = "new" + str(rng.randrange(10**6))
        a, b = (set(S.shingle_hashes(" ".join(w), 5).tolist()) for w in (words, other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        truth[2 * k] = len(a & b) / len(a | b)
    profiles = P.with_parts(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.node: r.doc_id for r in profiles.select("node", "doc_id").where("doc_id % 2 = 0").collect()}
    found = {ids.get(r.u, ids.get(r.v)) for r in P.similar(profiles).collect()}
    high = [k for k, j in truth.items() if 0.87 <= j < 1]
    assert len(high) > 30 and len(found & set(high)) >= 0.97 * len(high)
    assert not found & {k for k, j in truth.items() if j < 0.7}


def graph_keeps(rows, tau=3, similarity=0.8):
    """Smallest doc_id of each component of the whole graph: equal sets, fingerprints or similarity."""
    sets = [set(S.shingle_hashes(t, 5).tolist()) for _, t in rows]
    fps = [S.fingerprint(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k in range(len(rows)):
        for m in range(k):
            if (fps[k] ^ fps[m]).bit_count() <= tau or len(sets[k] & sets[m]) >= similarity * len(sets[k] | sets[m]):
                parent[find(k)] = find(m)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = "new" + str(rng.randrange(10**6))
    return out


@pytest.mark.parametrize("block", [50, 512])
def test_a_base_and_its_edited_copies_are_one_group(spark, monkeypatch, block):
    """The copies are similar to the base only, and the base leads few of the keys."""
    from gridspark.llm import parts as P

    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(k, " ".join(edited(rng, base, 4) if k != 150 else base)) for k in range(300)] + [(1000, " ".join(f"x{k}" for k in range(200)))]
    profiles = P.with_parts(spark.createDataFrame(rows, "doc_id long, text string"))
    nodes = {r.node: r.doc_id for r in profiles.select("node", "doc_id").collect()}
    found = connected_components(P.similar(profiles)).collect()
    sets = [set(S.shingle_hashes(t, 5).tolist()) for _, t in rows]
    expected = {k for k in range(300) if len(sets[k] & sets[150]) >= 0.8 * len(sets[k] | sets[150])}
    assert len(expected) > 290 and expected <= {nodes[r.node] for r in found}
    assert len({r.root for r in found if nodes[r.node] in expected}) == 1 and 1000 not in {nodes[r.node] for r in found}


def test_groups_are_those_of_the_whole_graph(spark):
    """Chains of texts in which a document that links two others by different rules goes itself."""
    rng = random.Random(21)
    texts = []
    for _ in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(40):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.choice([1, 2, 3, 4]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == graph_keeps(rows)


def test_similarity_is_decided_exactly():
    """Around 0.8, for sets of many sizes: a pair links if and only if its exact similarity reaches it."""
    from gridspark.llm import parts as P

    rng = np.random.default_rng(8)
    for size in (9, 45, 90, 450):
        for off in range(-3, 4):
            shared = size * 8 // 9 + off  # two sets of one size are at 0.8 when they share 8 of 9
            pool = rng.permutation(10**6)[: 2 * size].astype(np.uint64)
            if not 0 < shared <= size:
                continue
            a, b = np.sort(pool[:size]), np.sort(np.r_[pool[:shared], pool[size : 2 * size - shared]])
            other = np.sort(rng.permutation(10**6)[:size].astype(np.uint64) + np.uint64(10**7))
            linked = [(1, 2)] if 10 * shared >= 8 * (2 * size - shared) else []
            assert P.forest(np.array([1, 2]), [a, b], 0.8) == linked
            assert P.forest(np.array([1, 3, 2]), [a, other, b], 0.8) == linked


def test_query_groups_that_need_most_data_are_merged():
    from gridspark.llm.topk import _rings

    rings, merged = _rings({0: {0: (0.0, 1.0), 1: (0.0, 2.0)}, 1: {0: (0.5, 3.0), 1: (1.0, 1.5)}, 2: {1: (0.1, 0.2)}}, {0: 60, 1: 40}, {0: 5, 1: 6, 2: 7})
    assert merged == [0, 1]
    assert sorted(r[:4] for r in rings) == [(0, 0, 0.0, 3.0), (1, 0, 0.0, 2.0), (1, 2, 0.1, 0.2)]


def test_vectors_that_repeat_very_often(spark, monkeypatch):
    """A vector repeated more often than a block has rows is dealt out to many blocks, and the smallest ids win."""
    monkeypatch.setattr(K, "DATA_BLOCK", 50)
    rows = [(k, [1.0, 2.0]) for k in range(400)] + [(400, [3.0, 3.0])]
    vectors = K.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in K.top_k(vectors, vectors.where("id % 200 = 0")).collect())
    expected = [(q, k + 1, v) for q in (0, 200, 400) for k, v in enumerate(([400] if q != 400 else []) + [v for v in range(12) if v != q][: 9 if q != 400 else 10])]
    assert found == sorted(expected)
