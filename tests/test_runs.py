import functools
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import aggs, joins, project, runs, windows
from gridspark.operators.order import guard_budget
from gridspark.functions import scalars as S


def grid(spark, rows, schema="x long, y int, kind int"):
    return spark.createDataFrame(rows, schema)


def test_round_trip_with_gaps_and_nulls(spark, rows):
    cells = grid(spark, [(0, 0, 1), (0, 1, 1), (0, 3, 1), (0, 4, None), (0, 5, None), (2, 7, 3)])
    r = runs.compress_cells(cells, ["kind"])
    assert rows(r) == sorted([(0, 0, 2, 1), (0, 3, 1, 1), (0, 4, 2, None), (2, 7, 1, 3)], key=repr)
    assert rows(runs.expand_runs(r).select("x", "y", "kind")) == rows(cells)


def test_empty_tables(spark):
    cells = grid(spark, [])
    assert runs.compress_cells(cells, ["kind"]).count() == 0
    assert joins.neighbors4(cells, F.col("kind") == 1).count() == 0
    assert runs.expand_runs(grid(spark, [], "x long, y0 int, run_len int, kind int")).count() == 0


def test_lookup_against_plain_search(spark, rows):
    rng = random.Random(3)
    table, y = [], 0
    for k in range(40):
        n = rng.choice([1, 2, 15, 16, 17, 40])
        table.append((5, y, n, k))
        y += n + rng.choice([0, 0, 3])
    points = [(5, rng.randrange(-5, y + 5)) for _ in range(200)]
    found = runs.lookup_points(grid(spark, table, "x long, y0 int, run_len int, kind int"), grid(spark, points, "x long, y int"))
    expected = sorted(((x, p, k) for x, p in points for _, a, n, k in table if a <= p < a + n), key=repr)
    assert rows(found.select("x", "y", "kind")) == expected


def test_clip_is_expand_then_filter(spark, rows):
    r = grid(spark, [(0, 0, 10, 1), (0, 10, 5, 2), (3, 2, 1, 7), (9, 0, 4, 4)], "x long, y0 int, run_len int, kind int")
    clipped = runs.expand_runs(runs.clip_runs(r, 0, 2, 4, 9))
    assert rows(clipped.select("x", "y", "kind")) == rows(runs.expand_runs(r).where(project.in_rect(0, 2, 4, 9)).select("x", "y", "kind"))


def test_all_sixteen_masks(spark):
    """Each of the sixteen neighbourhoods stands apart; a neighbour that doesn't meet the predicate leaves no bit."""
    cells, expected = [], {}
    for mask in range(16):
        x = mask * 10
        cells.append((x, 5, 1))
        expected[x] = mask
        for bit, dx, dy in ((1, 0, -1), (2, -1, 0), (4, 1, 0), (8, 0, 1)):
            cells.append((x + dx, 5 + dy, 1 if mask & bit else 0))
    found = joins.neighbors4(grid(spark, cells), F.col("kind") == 1).where("y = 5 and x % 10 = 0").collect()
    assert {r.x: r.mask for r in found} == expected


def test_bucket_join_equals_theta_join(spark, rows):
    rng = random.Random(5)
    commands = [(k, rng.randrange(-100, 300), rng.randrange(-100, 300), rng.randrange(0, 90), rng.randrange(1, 40)) for k in range(120)]
    rects = [(k, rng.randrange(-100, 300), rng.randrange(-100, 300), rng.randrange(1, 150), rng.randrange(1, 150)) for k in range(25)]
    found = joins.rect_overlap(grid(spark, commands, "seq long, dx long, dy long, dw long, dh long"), grid(spark, rects, "rect_id long, rx long, ry long, rw long, rh long"))
    expected = [(s, r) for s, a, b, w, h in commands for r, c, d, v, u in rects if w > 0 and a < c + v and c < a + w and b < d + u and d < b + h]
    assert rows(found.select("seq", "rect_id")) == sorted(expected, key=repr)


def test_runs_join_equals_cells_join(spark, rows):
    rng = random.Random(8)

    def column(step):
        out, y = [], 0
        while y < 120:
            n = rng.randrange(1, step)
            out.append((1, y, n, rng.randrange(3)))
            y += n
        return grid(spark, out, "x long, y0 int, run_len int, kind int")

    a, b = column(40), column(9)
    joined = runs.expand_runs(joins.runs_join(a, b)).select("x", "y", "a_kind", "b_kind")
    left, right = runs.expand_runs(a).withColumnRenamed("kind", "a_kind"), runs.expand_runs(b).withColumnRenamed("kind", "b_kind")
    assert rows(joined) == rows(left.join(right, ["x", "y"]).select("x", "y", "a_kind", "b_kind"))


def test_tri_state_material(spark):
    cells = grid(spark, [(0, 0, 1), (0, 1, 2), (0, 2, 9), (0, 3, 1)])
    dim = spark.createDataFrame([(1, True), (2, None)], "kind int, solid boolean")
    found = joins.classify_material(cells, dim, active=F.col("y") != 3).collect()
    assert {r.y: r.is_solid for r in found} == {0: True, 1: None, 2: None, 3: False}


def test_cap_is_in_column_major_order(spark, rows):
    kept, report = windows.register_capped(grid(spark, [(2, 0, 1), (0, 9, 1), (0, 3, 1), (1, 1, 1)]), 3)
    assert rows(kept.select("x", "y", "idx")) == [(0, 3, 0), (0, 9, 1), (1, 1, 2)]
    assert rows(report) == [(4, 3, 1)]


def test_summed_area_against_rectangles(spark):
    rng = random.Random(2)
    value = {(x, y): rng.randrange(9) for x in range(12) for y in range(7)}
    cells = grid(spark, [(x, y, v) for (x, y), v in value.items()])
    rects = [(k, x, y, w, h) for k, (x, y, w, h) in enumerate([(0, 0, 12, 7), (3, 2, 4, 4), (11, 6, 1, 1), (0, 3, 5, 1)])]
    found = aggs.rect_count(aggs.summed_area(cells, "kind"), grid(spark, rects, "rect_id long, rx long, ry long, rw long, rh long")).collect()
    assert {r.rect_id: r.total for r in found} == {k: sum(v for (a, b), v in value.items() if x <= a < x + w and y <= b < y + h) for k, x, y, w, h in rects}


def test_area_reduce_rounds_half_up_and_ignores_clear_pixels(spark, rows):
    pixels = spark.createDataFrame([(0, 0, 10, 0, 0, 255), (0, 1, 11, 0, 0, 255), (1, 0, 200, 0, 0, 0), (1, 1, 200, 0, 0, 0)], "x long, y long, r long, g long, b long, a long")
    assert rows(aggs.area_reduce(pixels, 2)) == [(0, 0, 11, 0, 0, 128)]


def test_compose_is_ordered_source_over(spark, rows):
    samples = spark.createDataFrame([(0, 2, 50, 100), (0, 1, 200, 255), (1, 1, 7, 7)], "cell long, seq long, value long, alpha long")
    under = 200 * 155 / 255
    assert rows(aggs.compose(samples, ["cell"])) == [(0, 50 + int(under + 0.5), 255), (1, 7, 7)]


def test_fall_levels_against_brute_force(spark):
    """Each cell by itself, looking up: the sources above it, and recursively what they got."""
    f32 = np.float32
    rng = random.Random(4)
    column = [(y, rng.randrange(1, 5), rng.choice([0.0, 0.0, 0.0, 0.25, 0.75, 1.0]), rng.random() < 0.12, rng.random() < 0.2) for y in range(160)]
    weights = {k: [f32(1)] for k in windows.FALL_LENGTH}
    for k, n in windows.FALL_LENGTH.items():
        for _ in range(n):
            weights[k].append(f32(weights[k][-1] - f32(1 / (n + 1))))

    @functools.cache
    def visible(y):
        _, kind, seed, solid, full = column[y]
        if solid and not full:
            return f32(1), kind, 0.0
        if seed == 1:
            return f32(1), kind, 1.0
        level, opacity = f32(seed), float(seed > 0)
        for distance in range(10, 0, -1):  # the far ones first, the near ones set kind and opacity
            z = y - distance
            if z < 0 or any(column[k][3] for k in range(z + 1, y)):
                continue
            _, other, source, hard, whole = column[z]
            if source and (not hard or whole) and distance <= windows.FALL_LENGTH[other]:
                level = max(level, f32(visible(z)[0] * weights[other][distance]))
                if not seed:
                    kind, opacity = other, float(weights[other][distance])
        return level, kind, opacity

    cells = spark.createDataFrame([(1, *c) for c in column], "x long, y int, liquid int, level float, is_solid boolean, full boolean")
    for r in windows.fall_levels(cells).collect():
        level, kind, opacity = visible(r.y)
        assert (r.fallen, r.fall_kind, round(r.opacity, 6)) == (level, kind, round(opacity, 6)), r.y


def test_recipe_ids_round_trip(spark):
    parts = [(k, t, v, s, p) for k, t, v, s, p in itertools.product((0, 3), (0, 753), (0, 31), (0, 5), (0, 31))]
    df = spark.createDataFrame(parts, "kind int, type int, variant int, shape int, paint int")
    names = ["kind", "type", "variant", "shape", "paint"]
    back = df.withColumn("id", S.recipe_id(**{n: F.col(n) for n in names})).select(*names, *[c.alias(f"b_{n}") for n, c in S.recipe_decode(F.col("id")).items()])
    assert all(r[n] == r[f"b_{n}"] for r in back.collect() for n in names)


def test_budget(spark):
    with pytest.raises(ValueError, match="more than 3"):
        guard_budget(spark.range(4), 3)
    assert guard_budget(spark.range(3), 3).count() == 3


def test_canonical_raw_clears_run_bits(spark):
    df = spark.createDataFrame([(bytes([0xC7, 9]),), (b"",), (bytes([0x47]),)], "raw binary").select(project.canonical_raw(F.col("raw")).alias("raw"))
    assert [bytes(r.raw) for r in df.collect()] == [bytes([7, 9]), b"", bytes([7])]


def test_crc_check_vector(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 3421780262


def test_sql_functions_agree_with_columns(spark):
    S.register_sql_functions(spark)
    df = spark.range(5000).selectExpr("cast(id % 256 AS int) AS r", "cast(id * 7 % 256 AS int) AS g", "cast(id * 31 % 256 AS int) AS b", "cast(id % 32 AS int) AS p")
    c = S.paint_color(F.col("r"), F.col("g"), F.col("b"), F.col("p"))
    both = df.select(c.alias("c"), F.expr("grid_paint_red(r, g, b, p) AS pr"), F.expr("grid_paint_green(r, g, b, p) AS pg"), F.expr("grid_paint_blue(r, g, b, p) AS pb"))
    assert both.where("c.r <> pr OR c.g <> pg OR c.b <> pb").count() == 0
    kept = spark.sql("SELECT grid_harvestable(2, 9, null, null, null, null, null, null, null, null, null) AS a, grid_harvestable(9, 1, true, true, true, true, 1, 1D, 1D, 1D, 1) AS b, grid_frame_key('t', 1, null, 3, 4) AS k, grid_source_over(9, 5) + 10 * grid_additive(9, 5) AS s").first()
    assert tuple(kept) == (False, None, "t:1::3:4", 45)


def test_approximate_count(spark):
    n = aggs.count_distinct(spark.range(20_000), "id", approximate=True).first().n
    assert abs(n - 20_000) < 2_000
