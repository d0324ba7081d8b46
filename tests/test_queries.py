"""Every registered grid query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gridspark.plans.registry import ORACLES, QUERIES, load

load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert df.count() > 0
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


def test_crc_of_documents(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.crc == zlib.crc32(docs[r.doc_id].encode()) for r in QUERIES["sc07_crc32_of_texts"](spark, DATA).collect())


def test_flagship_balances(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark).collect()
    assert found and all(r.balanced for r in found)
