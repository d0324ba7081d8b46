"""Operators that split what used to be one group: long columns, wide grids, large rectangles, streams that stop in the middle."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridspark.operators import aggs, joins, runs, tracing, windows
from gridspark.sources import grids
from gridspark.streaming import incremental as inc


@pytest.mark.parametrize("rows", [2, 7, 4096])
def test_runs_are_stitched_over_bands(spark, rows):
    rnd = random.Random(rows)
    cells = [(x, y, rnd.choice(["a", "a", "a", None])) for x in range(3) for y in range(-9, 60) if rnd.random() > 0.05] + [(9, y, "z") for y in range(50)]
    found = sorted(tuple(r) for r in runs.compress_cells(spark.createDataFrame(cells, "x long, y long, kind string"), ["kind"], rows=rows).collect())
    expected, have = [], {(x, y): k for x, y, k in cells}
    for x, y, k in cells:
        if have.get((x, y - 1), 0) != k:
            n = 1
            while have.get((x, y + n), 0) == k:
                n += 1
            expected.append((x, y, n, k))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_prefix_sums_by_chunks(spark):
    cells = [("w", x, y, (x * 31 + y * 17) % 9) for x in range(-5, 14) for y in range(3, 20)]
    found = {(r.x, r.y): r.total for r in aggs.summed_area(spark.createDataFrame(cells, "world string, x long, y long, v long"), "v", ["world"], chunk=4).collect()}
    assert found == {(x, y): sum(v for _, a, b, v in cells if a <= x and b <= y) for _, x, y, _ in cells}


def test_rectangles_of_all_sizes(spark):
    rnd = random.Random(5)
    size = lambda: rnd.choice([1, 7, 60, 500, 4_000, 90_000])
    rects = [(k, rnd.randint(-3000, 3000), rnd.randint(-3000, 3000), size(), size()) for k in range(120)] + [(500, 0, 0, 0, 9)]
    commands = [(k, rnd.randint(-3000, 3000), rnd.randint(-3000, 3000), size(), size()) for k in range(120)]
    a, b = spark.createDataFrame(commands, "seq long, dx long, dy long, dw long, dh long"), spark.createDataFrame(rects, "rect_id long, rx long, ry long, rw long, rh long")
    found = sorted((r.seq, r.rect_id, r.local_x) for r in joins.rect_overlap(a, b).collect())
    assert found == sorted((i, j, x - u) for i, x, y, w, h in commands for j, u, v, p, q in rects if p and q and x < u + p and u < x + w and y < v + q and v < y + h)


def test_opaque_samples_cut_what_is_under_them(spark):
    samples = [(1, s, 10, 0 if s != 150_000 else 255) for s in range(200_000) if s < 150_001] + [(1, 200_001, 40, 100), (2, 1, 7, 255), (2, 2, 9, 0)]
    found = {r.k: (r.value, r.alpha) for r in aggs.compose(spark.createDataFrame(samples, "k int, seq long, value long, alpha long"), ["k"]).collect()}
    assert found == {1: (40 + 6, 255), 2: (16, 255)}


@pytest.mark.parametrize("rows", [3, 16, 1000])
def test_falls_over_bands(spark, rows):
    rnd = random.Random(2)
    cells = [(x, y, rnd.choice([1, 1, 2, 3, 4]), rnd.choice([0.0, 0.0, 0.3, 0.7, 1.0]), rnd.random() < 0.05, rnd.random() < 0.03) for x in range(3) for y in range(90) if rnd.random() > 0.02]
    df = spark.createDataFrame(cells, "x long, y int, liquid int, level float, is_solid boolean, full boolean")
    whole = sorted(map(tuple, windows.fall_levels(df, rows=10_000).collect()))
    assert sorted(map(tuple, windows.fall_levels(df, rows=rows).collect())) == whole


def test_ground_of_stacks(spark):
    cells = [(1, y, "stack" if y in (3, 4) else "rock" if y in (7, 30) else "air") for y in range(40)]
    df = spark.createDataFrame(cells, "x long, y long, kind string")
    found = {r.y: r.ground_y for r in tracing.stack_ground(df, F.col("kind") == "stack", F.col("kind") == "rock").collect()}
    assert [found[y] for y in (0, 3, 4, 5, 7)] == [7, 7, 7, None, None]


def test_a_rectangle_opens_few_row_groups(spark, tmp_path):
    grids.write_zoned(grids.formula_grid(spark, 1280, 1280), f"file://{tmp_path}/grid")
    touched = total = 0
    for f in sorted((tmp_path / "grid" / "cells").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        names = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            total += 1
            x, y = (meta.row_group(g).column(names[c]).statistics for c in ("x", "y"))
            touched += x.min < 256 and x.max >= 128 and y.min < 640 and y.max >= 512
    assert total >= 100 and touched <= 2  # 1,638,400 cells, of which the rectangle has 16,384
    opened = grids.zoned_files(spark, f"file://{tmp_path}/grid", 128, 512, 128, 128)
    assert opened.count() < grids.zoned_files(spark, f"file://{tmp_path}/grid", 0, 0, 1280, 1280).count()
    region = grids.read_zoned(spark, f"file://{tmp_path}/grid", 128, 512, 128, 128)
    assert region.count() == 128 * 128 and grids.read_zoned(spark, f"file://{tmp_path}/grid", 5000, 0, 9, 9).count() == 0
    assert grids.read_zoned(spark, f"file://{tmp_path}/grid", 128, 512, 128, 128, kinds=[3]).count() == region.where("kind = 3").count()
    with pytest.raises(Exception, match="exists"):
        grids.write_zoned(grids.formula_grid(spark, 2, 2), f"file://{tmp_path}/grid")


def test_sketches_merge_and_their_errors_hold(spark):
    df = spark.range(60_000).selectExpr("id % 20 AS part", "id AS a", "cast(id % 500 AS double) / 4 AS b", "cast(NULL AS int) AS c", "CASE WHEN id % 3 = 0 THEN double('NaN') ELSE id END AS d")
    sketches = aggs.column_sketches(df, ["a", "b", "c", "d"], ["part"])
    found = {r.field: r for r in aggs.profile_of_sketches(sketches, (0.25, 0.5)).collect()}
    assert (found["a"].n, found["a"].min, found["a"].max, found["a"].whole, found["b"].whole, found["c"].n, found["c"].nulls, found["c"].quantiles, found["d"].n) == (60_000, 0, 59_999, True, False, 0, 60_000, None, 40_000)
    assert abs(found["a"].distinct - 60_000) < 0.05 * 60_000 and abs(found["b"].distinct - 500) < 25
    assert all(abs(q - want) < 0.02 * 60_000 for q, want in zip(found["a"].quantiles, (15_000, 30_000)))
    half = aggs.profile_of_sketches(sketches.where("part < 10")).where("field = 'a'").first()
    assert half.n == 30_000


def test_newest_requests_survive_a_restart_and_expire(spark, tmp_path):
    at = lambda day, k: f"timestamp'2024-01-{day:02d} 00:00:{k:02d}'"
    batches = [
        [("a", 1, "one", at(1, 1)), ("a", 3, "three", at(1, 2)), ("b", 5, "five", at(1, 3))],
        [("a", 2, "late", at(1, 4)), ("b", 6, "six", at(1, 5))],
        [("c", 1, "c", at(20, 1))],  # moves the watermark far on: a and b are forgotten
        [("d", 1, "d", at(20, 2))],
        [("a", 1, "again", at(20, 3))],
    ]
    path, base = tmp_path / "in", f"file://{tmp_path}/job"
    results = []
    for k, rows in enumerate(batches):
        values = ", ".join(f"('{s}', {r}L, '{t}', {ts})" for s, r, t, ts in rows)
        spark.sql(f"SELECT * FROM VALUES {values} v(session, revision, text, ts)").coalesce(1).write.mode("append").parquet(f"file://{path}")
        stream = spark.readStream.schema("session string, revision long, text string, ts timestamp").parquet(f"file://{path}")
        with inc.with_rocksdb(spark):  # each run is a new start from the checkpoint
            out = inc.run_available(inc.latest_with_expiry(stream, "session", "revision", ["text"], "ts", "1 hour", 86_400_000), "append", base=base)
        results.append({tuple(r) for r in out.collect()})
    new = [b - a for a, b in zip([set(), *results], results)]
    assert new == [{("a", 3, "three"), ("b", 5, "five")}, {("b", 6, "six")}, {("c", 1, "c")}, {("d", 1, "d")}, {("a", 1, "again")}]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
