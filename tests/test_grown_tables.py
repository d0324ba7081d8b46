"""Queries and steps on tables that are larger, or end elsewhere, than the smallest ones."""

import random
import re
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from gridspark.operators import aggs, joins, tracing
from gridspark.plans.registry import ORACLES, QUERIES, load

load()


def vectors(folder, ids):
    """A table of embeddings with these ids."""
    rnd = random.Random(1)
    values = [[rnd.uniform(-0.5, 0.5) for _ in range(64)] for _ in ids]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")


def same_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    expected = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()) == expected
    return len(expected)


def test_scenes_of_narrow_and_late_worlds(spark, tmp_path):
    vectors(tmp_path, [*range(160), *range(47_000, 47_060)])  # worlds 1 and 470 have 60 columns, and 470 is later than a day's ticks
    assert same_as_sql(spark, tmp_path, "src01_scenes_of_worlds") == 3 * 7


def test_places_are_numbered_in_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, False)
    try:
        found = QUERIES["so02_draw_order"](spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() > 1  # one window over everything is one task
    finally:
        spark.conf.unset(key)
    assert same_as_sql(spark, "/root/testdata/sf0.001", "so02_draw_order") == 1500


def test_reports_are_plain_files_of_one_folder(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("reports-*"))
    users = QUERIES["src06_bench_runs"](spark, "/root/testdata/sf0.001").count()
    (folder,) = set(shared.glob("reports-*")) - before
    assert users > 1 and len([p for p in folder.glob("*.json") if p.is_file()]) == users and not [p for p in folder.iterdir() if p.is_dir()]  # no folder a user, whose files the driver would move one by one


def test_cover_by_words(spark):
    rnd = random.Random(3)
    cells = sorted({(rnd.randint(-70, 70), rnd.randint(-140, 140)) for _ in range(9000)})
    pieces = [(rnd.randint(-80, 60), rnd.randint(-150, 100), rnd.randint(0, 40), rnd.choice([0, 1, 63, 64, 65, 90])) for _ in range(60)] + [(0, 0, 9, 64)] * 3 + [(5, -64, 2, 192)]
    times = dict.fromkeys(cells, 0)
    for x, y, w, h in pieces:
        for at in ((x + i, y + j) for i in range(w) for j in range(h)):
            times[at] = times.get(at, 0) + 1
    found = aggs.exact_cover(spark.createDataFrame(pieces, "x long, y long, width int, height int"), spark.createDataFrame(cells, "x long, y int"))
    assert sorted(map(tuple, found.collect())) == sorted((*at, n) for at, n in times.items() if n != 1)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()  # a few pieces may be many cells: not in one task


def test_chunks_of_paths_are_not_broadcast(spark, monkeypatch):
    rounds, stored = [], tracing.stored

    def seen(df):
        if "s" in df.columns:
            rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(tracing, "stored", seen)
    cells = spark.range(200).crossJoin(spark.range(6).toDF("y")).selectExpr("id AS x", "y", "y = 5 AND id % 70 < 60 AS is_solid", "cast(0 AS int) AS shape")
    origins = spark.createDataFrame([(k, 3 + 9 * k, 0) for k in range(20)], "idx long, x long, y long")
    assert {r.idx for r in tracing.trace_paths(origins, cells, 40).collect()} == set(range(20))
    assert rounds and not any("Broadcast" in p for p in rounds)


def test_copies_of_rectangles_meet_as_lists(spark):
    rnd = random.Random(9)
    shapes = [(w, rnd.randint(-90, 200), rnd.randint(-90, 200), rnd.choice([0, 16, 48, 700]), rnd.choice([16, 900])) for w in "ab" for _ in range(6)]
    commands = [(*shapes[k % 12 if k % 3 else 0], k, f"a{k % 7}") for k in range(400)] + [(*shapes[1], 7, "twice")] * 50 + [("a", None, 0, 16, 16, 1, "")]
    rects = [(w, k, rnd.randint(-90, 200), rnd.randint(-90, 200), rnd.randint(0, 150), rnd.randint(1, 90)) for w in "ab" for k in range(20)]
    a = spark.createDataFrame(commands, "world string, dx long, dy long, dw long, dh long, seq long, asset string")
    b = spark.createDataFrame(rects, "world string, rect_id long, rx long, ry long, rw long, rh long")
    columns = ["world", "seq", "asset", "rect_id", "local_x", "local_y", "dw", "rh"]
    expected = sorted((v, k, n, j, x - p, y - q, w, s) for v, x, y, w, h, k, n in commands for u, j, p, q, r, s in rects if u == v and x is not None and w and r and x < p + r and p < x + w and y < q + s and q < y + h)
    for copies in (1, 8, 128):  # lists that are cut in sorted ranges and in slices
        assert sorted(map(tuple, joins.copies_overlap(a, b, world=["world"], copies=copies).select(*columns).collect())) == expected
    assert sorted(map(tuple, joins.copies_overlap(a.drop("seq", "asset"), b, world=["world"]).select("world", "rect_id", "local_x").collect())) == sorted((e[0], e[3], e[4]) for e in expected)


def test_overlaps_of_many_copies_follow_in_repeats(spark, tmp_path):
    events = [(e, u) for e in range(60_000) for u in range(900) if e * 37 % 1900 - 20 < 10 and u * 11 % 900 - 10 < 0 and (e + u) % 97 == 0][:60]
    pq.write_table(pa.table({"event_id": [e for e, _ in events], "user_id": [u for _, u in events], "event_type": ["error"] * 60}), f"{tmp_path}/events.parquet")
    pq.write_table(pa.table({"o_orderkey": [k * 192 for k in range(4000)], "o_custkey": [k % 5 for k in range(4000)], "o_orderpriority": ["a"] * 4000, "o_orderstatus": ["F"] * 4000}), f"{tmp_path}/orders.parquet")
    pairs = same_as_sql(spark, tmp_path, "jn07_rect_overlap")
    assert pairs > 100_000
    found = QUERIES["jn07_rect_overlap"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not put together because the tables are small
    rows = [(r.rect_id, r.local_x, r.local_y) for r in found.collect()]
    assert sum(a != b for a, b in zip(rows, rows[1:])) < pairs / 64  # which files keep as run lengths


def test_lists_are_taken_apart_behind_the_join(spark):
    a = spark.range(300).selectExpr("id AS seq", "id % 3 * 16 AS dx", "0L AS dy", "16L AS dw", "16L AS dh")
    a = a.union(spark.sql("SELECT CAST(NULL AS LONG), 0L, 0L, 16L, 16L"))  # a command without a number is one, too
    b = spark.range(50).selectExpr("id AS rect_id", "id AS rx", "0L AS ry", "8L AS rw", "8L AS rh")
    found = joins.copies_overlap(a, b).select("seq", "rect_id")
    expected = [(k, r) for k, x in [*((k, k % 3 * 16) for k in range(300)), (None, 0)] for r in range(50) if x < r + 8 and r < x + 16]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    plan = found._jdf.queryExecution().executedPlan().toString()
    loops = [set(re.findall(rf"\*\((\d+)\) {step}", plan)) for step in (r"ShuffledHashJoin", r"Generate explode\(_own_of#\d+\), \[rect_id")]
    assert all(loops) and not loops[0] & loops[1]  # in one loop, all rows of a list and the rectangles that it meets are held before the first is handed on
