import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gridspark.llm import queries as Q

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents with planted cases, and each stage's result."""
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rng = random.Random(5)
    vocabulary = sorted({w for r in own.collect() for w in r.text.split()})
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(300)
    edited = long.split()
    edited[40] = edited[200] = "changed"
    planted = [(9001, long), (9002, long), (9003, "".join(c.upper() if c.isascii() else c for c in long)), (9004, " ".join(edited)), (9005, f"{prose(80)} {item} {prose(80)}"), (9006, None), (9007, "12345 -- 6789"), (9008, prose(120)), (9009, "")]
    docs = own.unionByName(spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long"))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for k, (name, f) in enumerate(P.STAGES):
        docs.write.parquet(path := f"file://{folder}/{k}")
        docs = spark.read.parquet(path)
        out.append(docs)
        docs = f(spark, docs, DATA)
        if k < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS, name
    docs.write.parquet(path := f"file://{folder}/last")
    return [*out, spark.read.parquet(path)]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names():
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]


def test_language_rejects_what_has_no_letters(stages):
    assert sorted(set(ids(stages[0])) - set(ids(stages[1]))) == [9006, 9007, 9009]


def test_one_of_each_group_stays(stages):
    before, after = set(ids(stages[1])), set(ids(stages[2]))
    assert {9001, 9002, 9003, 9004} & after == {9001} and {9005, 9008} <= after
    texts = [r.text for r in stages[1].collect()]
    assert len(after) <= len(set(texts)) and len({r.text for r in stages[2].collect()}) == len(after)
    assert len(before - after) < len(before) / 4


def test_benchmark_passages_go_and_others_stay(stages, spark):
    gone = set(ids(stages[2])) - set(ids(stages[3]))
    assert 9005 in gone and 9008 not in gone
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[2].collect() if any(f" {b} " in f" {words(r.text)} " for b in items)}
    assert held <= gone and not {r.doc_id for r in stages[3].collect() if any(f" {b} " in f" {words(r.text)} " for b in items)}


def test_mix_takes_rows_up_to_twice(stages):
    known = {r.doc_id: r.text for r in stages[3].collect()}
    taken = {}
    for r in stages[4].collect():
        assert r.text == known[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 2
    size = {i: len(t.split()) for i, t in known.items()}
    assert abs(sum(n * size[i] for i, n in taken.items()) - 1.5 * sum(size.values())) <= 20 * max(size.values())


def test_tokens_are_those_of_the_mix(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((r.doc_id, zlib.crc32(np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in stages[5].collect()) == expected
    total = stages[5].agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).first()
    assert total.n == total.end


def test_run(spark):
    found = P.run(spark, DATA)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, DATA)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("pages", "labels", "embeddings", "documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = Q.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in found.fetchall())




#: Names that operators use themselves.
OWN_NAMES = "score lang_pred _p _hash _copy _kept _bad _salt _stratum _sure _want _size _block _blocks _level _row _id _n _text _of _source".split()


@pytest.mark.parametrize("stage", range(4))
def test_columns_of_any_name_stay_as_they_are(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[(F.col("doc_id") * 100 + k).cast("string").alias(n) for k, n in enumerate(OWN_NAMES)])
    found = P.STAGES[stage][1](spark, more, "/root/testdata/sf0.001")
    rows = found.collect()
    assert found.columns == more.columns and rows
    assert all(r[n] == str(r.doc_id * 100 + k) for r in rows for k, n in enumerate(OWN_NAMES))
