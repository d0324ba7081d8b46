"""Rules of the world format by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalars as S
from gridspark.operators import joins, project, terrain, tracing, windows
from gridspark.plans import audit, planner
from gridspark.sources import facts, worlds

PAINTED = [
    # r, g, b, paint, wall, type, result
    ((255, 0, 0), 9, False, 1, (0, 0, 255)),
    ((255, 0, 0), 21, False, 1, (0, 0, 255)),
    ((200, 133, 100), 1, False, 2, (200, 133, 100)),
    ((200, 50, 0), 1, False, 2, (200, 0, 0)),
    ((120, 90, 90), 9, False, 60, (120, 90, 90)),
    ((10, 20, 30), 0, False, 1, (10, 20, 30)),
    ((10, 20, 30), 31, False, 1, (10, 20, 30)),
    ((200, 100, 50), 2, False, 1, (200, 125, 50)),
    ((200, 100, 50), 14, False, 1, (200, 110, 20)),
    ((200, 100, 50), 13, False, 1, (200, 20, 20)),
    ((200, 100, 50), 25, False, 1, (38, 38, 38)),
    ((200, 100, 50), 27, False, 1, (125, 125, 125)),
    ((200, 100, 50), 28, False, 1, (200, 140, 98)),
    ((200, 100, 50), 29, False, 1, (6, 6, 6)),
    ((200, 100, 50), 30, False, 1, (55, 155, 205)),
    ((200, 20, 50), 30, True, 1, (0, 151, 91)),
    ((0, 0, 0), 30, False, 1, (0, 0, 0)),
    ((255, 255, 255), 26, False, 1, (255, 255, 255)),
    ((1, 2, 3), 32, False, 1, None),
]


@pytest.mark.parametrize("wall", [False, True])
def test_paints(spark, wall):
    mine = [(k, *rgb, paint, t) for k, (rgb, paint, w, t, _) in enumerate(PAINTED) if w == wall]
    df = spark.createDataFrame(mine, "k int, r int, g int, b int, paint int, type int")
    spared = None if wall else S.paint_spares(F.col("r"), F.col("g"), F.col("b"), F.col("type"))
    found = {r.k: r.c and tuple(r.c) for r in df.select("k", S.paint_color(F.col("r"), F.col("g"), F.col("b"), F.col("paint"), wall, spared).alias("c")).collect()}
    assert found == {k: PAINTED[k][-1] for k, *_ in mine}


def test_paint_masks_and_reasons(spark):
    one = lambda *m, **k: spark.range(1).select(S.hue_sat_mask(F.lit(255), F.lit(0), F.lit(0), *m, **k)).first()[0]
    assert one(0.0, 0.0, 1.0, 1.0) and not one(0.0, 0.0, 1.0, 1.0, 0.0, True) and one(0.5, 0.5, 1.0, 1.0, 0.5) and not one(0.5, 0.5, 1.0, 1.0, -0.5)
    df = spark.createDataFrame([(5, 1), (5, 13), (2, 1), (None, 1), (-1, 3), (1, 32), (1, None)], "type int, paint int")
    found = [tuple(r) for r in df.select(S.paint_reason(F.col("type"), F.col("paint")), S.paint_reason(F.col("type"), F.col("paint"), wall=True)).collect()]
    assert [a for a, _ in found] == ["tree", None, None, "unknown type", "unknown type", "unknown paint", "unknown paint"]
    assert [b for _, b in found] == [None] * 5 + ["unknown paint"] * 2


def test_wall_centres(spark):
    """Nine walls around: the middle's variant by its place; the region's edge is no neighbour."""
    cells = spark.createDataFrame([(x, y, 1) for x in range(3, 6) for y in range(6, 9)], "x long, y long, kind int")
    on = F.col("kind") == 1
    for dx in range(3):
        for dy in range(3):
            moved = cells.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
            found = {(r.x, r.y): r.wall_variant for r in terrain.terrain_masks(moved, on, on).collect()}
            assert found[4 + dx, 7 + dy] == 15 + ((2, 0, 0), (0, 1, 4), (0, 3, 0))[(dx + 1) % 3][(dy + 1) % 3]
            assert found[3 + dx, 6 + dy] == 12 and found[5 + dx, 8 + dy] == 3


def test_masks_of_repeated_cells_and_overlapping_worlds(spark):
    rows = [(w, x, y) for w in "ab" for x, y in ((0, 0), (0, 1))] + [("a", 0, 1)]
    cells = spark.createDataFrame(rows, "world_id string, x long, y long").withColumns({"kind": F.lit(0), "level": F.lit(1)})
    found = sorted(tuple(r) for r in joins.neighbors4(cells, F.col("kind") == 0, ["world_id"]).collect())
    assert found == [("a", 0, 0, 8), ("a", 0, 1, 1), ("b", 0, 0, 8), ("b", 0, 1, 1)]
    assert sorted(r.m for r in joins.with_masks(cells, {"m": F.col("kind") == 0}, ["world_id"]).collect()) == [1, 1, 1, 8, 8]
    around = {(r.world_id, r.y): r for r in joins.neighbors8(cells, "level", ["world_id"]).collect()}
    assert len(around) == 4 and around["a", 0].s == 1 and around["a", 0].n is None
    dim = spark.createDataFrame([(0, "solid", 1)], "kind int, layer string, family_mask int")
    single = audit.audit(cells.where("world_id = 'b'"), dim, spark.createDataFrame([("tile_3.png", 99, 99)], "asset string, width int, height int")).first()
    both = audit.audit(cells.distinct(), dim, spark.createDataFrame([("tile_3.png", 99, 99)], "asset string, width int, height int")).collect()
    assert {tuple(r)[1:] for r in both} == {tuple(single)[1:]} and all(r.balanced for r in both) and len(both) == 2
    numbered = audit.numbered(audit.plan(cells.distinct(), dim, ["world_id"]).commands, ["world_id"]).collect()
    assert sorted((r.world_id, r.seq) for r in numbered) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_chunk_edges_have_their_neighbours(spark):
    """Masks over a chunk's edge, with holes, equal those by plain search."""
    have = {(x, y) for x in range(250, 262) for y in range(-3, 4) if (x * 7 + y * 5) % 4}
    found = joins.neighbors4(spark.createDataFrame(sorted(have), "x long, y long"), F.lit(True)).collect()
    for r in found:
        assert r.mask == sum(bit for bit, dx, dy in ((1, 0, -1), (2, -1, 0), (4, 1, 0), (8, 0, 1)) if (r.x + dx, r.y + dy) in have)


STATE = {"day_time": True, "blood_moon": False, "raining": False, "remix_world": False, "moon_phase": 3, "time": 50_000.0, "cloud_alpha": 0.0, "world_surface": 300.5, "world_height": 1200}


@pytest.mark.parametrize(
    "style, y, change, ripe",
    [
        (0, 5, {}, True), (1, 5, {}, False), (1, 5, {"day_time": False}, True), (2, 5, {}, False), (6, 5, {"day_time": None}, False), (3, 5, {"day_time": False}, False), (3, 5, {"day_time": False, "moon_phase": 0}, True),
        (3, 5, {"day_time": False, "blood_moon": True}, True), (4, 5, {}, False), (4, 5, {"cloud_alpha": 0.1}, True), (4, 5, {"raining": True}, True), (5, 5, {}, True), (5, 5, {"time": 40_500.0}, False),
        (5, 5, {"raining": True}, False), (5, 301, {"raining": True}, True), (5, 849, {"raining": True, "remix_world": True}, True), (5, 850, {"raining": True, "remix_world": True}, False), (7, 5, {}, None), (0, 5, {"moon_phase": 8}, None),
        (0, 5, {"time": None}, None), (None, 5, {}, None),
    ],
)
def test_herbs(spark, style, y, change, ripe):
    state = {k: F.lit(v).cast("boolean" if k in ("day_time", "blood_moon", "raining", "remix_world") else "double") for k, v in (STATE | change).items()}
    assert spark.range(1).select(S.harvestable(F.lit(style).cast("int"), F.lit(y), state)).first()[0] is ripe


def test_fact_tables(spark):
    found = {r.type: r for r in facts.materials(spark).collect()}
    assert len(found) == 754 and found[379].solid is None and found[379].draw_layer is None
    assert (found[0].solid, found[19].solid, found[19].solid_with_platforms, found[239].solid, found[3].solid) == (True, False, True, False, False)
    assert (found[11].draw_layer, found[11].solid, found[10].draw_layer, found[14].solid_top) == ("solid", False, "solid", True)
    family = {r.type: r for r in facts.families(spark).collect()}
    assert (family[237].family_mask, family[80].family_mask, family[664].family_mask, family[52].family_mask, family[158].family_mask) == (1, 2, 4, 32, 128)
    assert family[1].ordinary and family[21].stored and family[353].rope and not family[353].ordinary
    assert facts.wall_frames(spark).count() == 20 and facts.block_frames(spark).where("mask = 15 AND sx = 18 AND sy = 18").count() == 1


def test_supported_cells(spark):
    rows = [(1, 0, None, None), (1, 6, None, None), (1, 0, 0, 0), (21, 0, 18, 0), (21, 0, None, None), (21, 0, -18, 0), (52, 3, None, None), (353, 0, None, None), (237, 0, 0, 0), (753, 0, None, None)]
    df = spark.createDataFrame(rows, "type int, shape int, frame_x int, frame_y int").join(facts.families(spark), "type", "left")
    ok = project.supported(F.col("shape"), F.col("frame_x"), F.col("frame_y"), facts.conditional_type(F.col("type")), F.col("stored"), F.col("ordinary") | (F.col("type") == 353))
    found = {(r.type, r.shape, r.frame_x, r.frame_y): r.ok for r in df.select("type", "shape", "frame_x", "frame_y", ok.alias("ok")).collect()}
    assert [found[r] for r in rows] == [True, False, False, True, False, False, True, True, False, False]


CELL = {"active": False, "type": 0, "shape": 0, "level": 0, "liquid": 0, "is_solid": False}
TILES = "x long, y long, active boolean, type int, shape int, level int, liquid int, is_solid boolean"


def tiles(spark, own, width=(100, 140), height=(70, 100)):
    """An empty piece of a world with some cells of its own."""
    rows = [(x, y, *(CELL | own.get((x, y), {})).values()) for x in range(*width) for y in range(*height)]
    return spark.createDataFrame(rows, TILES)


def block(shape=0, **more):
    return {"active": True, "type": 1, "shape": shape, "is_solid": True} | more


def wet(level=255, liquid=1):
    return {"level": level, "liquid": liquid}


@pytest.mark.parametrize(
    "own, expected",
    [
        ({(119, 80): wet(160)}, []), ({(119, 80): wet(161)}, [(120, 80, 0)]), ({(119, 80): wet(), (120, 79): wet(16)}, []), ({(119, 80): wet(), (120, 79): wet(15)}, [(120, 80, 0)]),
        ({(119, 80): wet(), (120, 79): block(level=255, liquid=1)}, [(120, 80, 0)]), ({(119, 80): wet(), (121, 80): block(2)}, []), ({(119, 80): wet(), (121, 80): block(1)}, [(120, 80, 0)]),
        ({(119, 80): wet(255, 3), (120, 79): wet(0, 2)}, [(120, 80, 1)]), ({(119, 80): wet(255, 4), (120, 79): wet(0, 3)}, [(120, 80, 14)]), ({(119, 80): wet(255, 4)}, [(120, 80, 25)]),
    ],
)
def test_sources_beside_half_cells(spark, own, expected):
    found = terrain.detect_sources(tiles(spark, {(120, 80): block(1)} | own), 10).collect()
    assert [(r.x, r.y, r.fall) for r in found] == expected


def test_sources_under_clouds_and_their_cap(spark):
    own = {(110, 80): block(type=460), (112, 80): block(type=717), (112, 81): wet(), (114, 80): block(type=196), (120, 80): block(1), (119, 80): wet()}
    found = terrain.detect_sources(tiles(spark, own), 2).collect()
    assert sorted((r.idx, r.x, r.y, r.fall, r.source) for r in found) == [(0, 110, 81, 22, "cloud"), (1, 114, 81, 11, "cloud")]


FLOOR = {(x, 90): block() for x in range(100, 140)}
POOL = {(x, y): wet() for x in range(100, 140) for y in (88, 89)}
BARRIERS = {(119, 89): block(), (124, 89): block()}
SLOPE = {(120, 85): block(2), (121, 86): block(2), (122, 87): block(2)}
PATHS = [  # a world's cells, and where the path from (120, 80) goes and how it ends
    (FLOOR | POOL, [(120, y) for y in range(80, 89)], "liquid"),
    (FLOOR, [(120, y) for y in range(80, 90)], "stationary"),
    (FLOOR | BARRIERS, [*((120, y) for y in range(80, 90)), (121, 89), (122, 89), (123, 89), (122, 89), (121, 89), (120, 89), (119, 89)], "reversed"),
    (FLOOR | SLOPE | POOL, [*((120, y) for y in range(80, 85)), (121, 85), (122, 86), (123, 87), (123, 88)], "liquid"),
    ({(120, 80): block()}, [(120, 80)], "solid"),
    ({}, [(120, 80)], "edge"),
    (FLOOR | {(100 + k, 82 + k % 2): block() for k in range(40)}, [(120, 80), (120, 81)], "stationary"),
]


@pytest.mark.parametrize("side", [64, 7])
def test_winding_paths(spark, side):
    rows = [(k, x, y, *(CELL | own.get((x, y), {})).values()) for k, (own, *_) in enumerate(PATHS) for x in range(100, 140) for y in range(70, 100)]
    origins = spark.createDataFrame([(k, 7, 120, 80) for k in range(len(PATHS))], "w int, idx long, x long, y long")
    found = tracing.trace_paths(origins, spark.createDataFrame(rows, "w int, " + TILES), 100, ["w"], side=side).orderBy("w", "step").collect()
    for k, (_, places, reason) in enumerate(PATHS):
        mine = [r for r in found if r.w == k]
        assert ([(r.x, r.y) for r in mine], mine[-1].reason, [r.step for r in mine]) == (places, reason, list(range(len(places)))), k


def test_long_paths_beside_clouds(spark):
    own = {(119, 82): block(type=189)}
    origins = spark.createDataFrame([(1, 120, 80)], "idx long, x long, y long")
    found = tracing.trace_paths(origins, tiles(spark, own), 5, longest=9).orderBy("step").collect()
    assert (found[-1].step, found[-1].reason) == (9, "distance")


def test_roots_and_stacks_without_end(spark):
    cells = spark.createDataFrame([(5, y, 1) for y in range(6)] + [(6, 5, 1), (6, 6, 1), (6, 7, 2)] + [(9, y, 3) for y in range(20)], "x long, y long, kind int")
    starts = spark.createDataFrame([(5, 0, 1), (9, 0, 3)], "x0 long, y0 long, kind int")
    for side in (64, 3):
        found = {r.x0: tuple(r)[2:] for r in tracing.trace_root(starts, cells, {2: "sand"}, 8, side=side).collect()}
        assert found == {5: (6, 6, 6, "sand", True), 9: (9, 8, 8, None, False)}


def test_roots_need_the_cell_beside(spark):
    """A stack doesn't go to a cell diagonally below, and stays within one column of its start."""
    cells = spark.createDataFrame([(5, 0, 1), (6, 1, 1), (6, 2, 2)] + [(x, y, 1) for x, y in ((20, 0), (20, 1), (21, 1), (21, 2), (22, 2), (22, 3))] + [(21, 3, 2)], "x long, y long, kind int")
    starts = spark.createDataFrame([(5, 0, 1), (20, 0, 1)], "x0 long, y0 long, kind int")
    found = {r.x0: tuple(r)[2:] for r in tracing.trace_root(starts, cells, {2: "sand"}, 8).collect()}
    assert found == {5: (5, 0, 0, None, True), 20: (21, 2, 2, "sand", True)}


def test_moves_are_in_the_table():
    table = tracing.move_table()
    state = lambda move, d, turns: table[move * 6 + (d + 1) * 2 + turns]
    shown = lambda n: ((n & 3) - 1, n >> 2 & 1, (n >> 3 & 3) - 1, n >> 5)
    assert shown(state(0, -1, 1)) == (1, 1, 1, 1)  # down a slope: its direction, turns kept
    assert shown(state(2, -1, 1)) == (0, 1, -1, 0)  # a fall forgets turns
    assert shown(state(3, -1, 1)) == (-1, 0, -1, 2)  # a second turn goes the other way
    assert shown(state(3, 1, 1)) == (1, 0, 1, 1)
    assert shown(state(6, 1, 0)) == (0, 0, 1, 1)


PLANNED = "x long, y long, active boolean, type int, shape int, level long, liquid int, wall int, frame_x int, frame_y int, paint int, inactive boolean, invisible_block boolean, invisible_wall boolean"


def plan_of(spark, own, size=(7, 7), **how):
    """Entries of a small grid by place and kind."""
    blank = dict(active=False, type=0, shape=0, level=0, liquid=0, wall=0, frame_x=None, frame_y=None, paint=0, inactive=False, invisible_block=False, invisible_wall=False)
    rows = [(x, y, *(blank | own.get((x, y), {})).values()) for x in range(size[0]) for y in range(size[1])]
    return {(r.x, r.y, r.kind): r for r in planner.plan_cells(spark.createDataFrame(rows, PLANNED), **how).collect()}


def tile(type=1, **more):
    return dict(active=True, type=type) | more


def test_blocks_by_their_like(spark):
    near = {(3, 2): 1, (2, 3): 2, (4, 3): 4, (3, 4): 8}
    own = {}
    for mask in range(16):  # one grid beside the other
        at = 10 * mask
        own |= {(at + x, y): tile(1, invisible_block=not mask & bit) for (x, y), bit in near.items()}  # hidden blocks don't count
        own |= {(at + 3, 3): tile(1, paint=9), (at + 3, 5): tile(2)}
    found = plan_of(spark, own, (160, 7))
    for mask in range(16):
        row = found[10 * mask + 3, 3, "tile"]
        assert (row.sx, row.sy, row.asset, row.paint, row.phase) == (*facts.BLOCK_FRAMES[mask], "Tiles_1.png", 9, "solid tile")


def test_walls_their_variants_and_hidden_ones(spark):
    own = {(x, y): dict(wall=4) for x in range(7) for y in range(7)} | {(0, 0): dict(wall=318), (6, 6): dict(wall=4, invisible_wall=True)}
    found = plan_of(spark, own)
    variants = [[2, 0, 0], [0, 1, 4], [0, 3, 0]]
    for x in range(1, 6):
        for y in range(1, 6):
            if (x, y) not in ((1, 0), (0, 1), (5, 6), (6, 5)):
                row = found[x, y, "wall"]
                assert (row.sx, row.sy) == tuple(36 * v for v in facts.WALL_FRAMES[15 + variants[x % 3][y % 3]]) and (row.dx, row.dy, row.dw) == (x * 16 - 8, y * 16 - 8, 32)
    assert found[0, 0, "wall"].entry == found[6, 6, "wall"].entry == "hidden" and found[1, 0, "wall"].sx == 36 * facts.WALL_FRAMES[4 + 8][0]
    assert plan_of(spark, own, reveal=True)[6, 6, "wall"].entry == "command"


def test_shapes_stored_frames_ropes_and_reasons(spark):
    own = {
        (0, 0): tile(1, shape=1), (1, 0): tile(1, shape=3), (2, 0): tile(1, shape=6), (3, 1): tile(4, frame_x=22, frame_y=0), (3, 0): tile(1), (5, 0): tile(353), (5, 1): tile(353), (0, 2): tile(373), (1, 2): tile(5), (2, 2): tile(28, shape=1),
        (3, 2): tile(900), (4, 2): tile(18, frame_x=2052, frame_y=0), (5, 2): tile(21, frame_x=0, frame_y=18), (6, 2): tile(1, frame_x=0, frame_y=0), (0, 4): tile(1, invisible_block=True), (1, 4): tile(11, frame_x=18, frame_y=0),
    }
    found = {k[:2]: r for k, r in plan_of(spark, own).items() if k[2] == "tile"}
    at = lambda x, y, *names: tuple(found[x, y][n] for n in names)
    assert at(0, 0, "sh", "dy", "dh", "shape") == (8, 8, 8, 1) and at(1, 0, "sh", "shape") == (16, 3)
    assert at(2, 0, "entry", "reason") == ("omitted", "unimplemented-type") == at(3, 2, "entry", "reason") == at(6, 2, "entry", "reason")
    assert at(3, 1, "sx", "sw", "sh", "dx", "dy", "fidelity") == (22, 20, 20, 46, 20, "stored-frame")
    assert at(5, 0, "fidelity", "sx", "sy") == ("approximate-rope", *facts.BLOCK_FRAMES[8]) and at(5, 1, "sx", "sy") == facts.BLOCK_FRAMES[1]
    assert at(0, 2, "entry", "reason") == ("hidden", "particle-emitter-without-tile-body") and at(1, 2, "reason") == ("family-tree",) and at(2, 2, "reason") == ("shaped-static-object",)
    assert at(4, 2, "sx", "sy") == (36, 20) and at(5, 2, "sh") == (18,) and at(0, 4, "reason") == ("invisible",) and at(1, 4, "phase") == ("solid tile",)


def test_liquids_flat_full_and_refused(spark):
    wet = lambda level=255, kind=1: dict(level=level, liquid=kind)
    pool = {(x, y): wet() for x in range(1, 6) for y in range(2, 6)}
    found = plan_of(spark, pool)
    at = lambda f, x, y, *names: tuple(f[x, y, "liquid"][n] for n in names)
    assert at(found, 3, 2, "sx", "sy", "sh") == (16, 0, 16) and at(found, 1, 2, "sx", "sy") == (0, 0) and at(found, 5, 3, "sx", "sy") == (32, 16) and at(found, 3, 4, "sx", "sy", "asset") == (16, 48, "water_0.png")
    assert at(plan_of(spark, pool, surface=10.0), 3, 2, "sy") == (1280,)
    low = plan_of(spark, {(3, 3): wet(100, 2)})
    assert at(low, 3, 3, "sx", "sy", "sh", "dy", "asset") == (16, 16 + 9, 7, 48 + 9, "water_1.png")
    assert at(plan_of(spark, {(3, 3): wet(255, 4)}), 3, 3, "reason") == ("shimmer",)
    assert at(plan_of(spark, pool | {(3, 3): wet(9, 2)}), 3, 2, "reason") == ("mixed-liquid-neighborhood",)
    assert at(plan_of(spark, pool | {(2, 3): tile(379)}), 3, 3, "reason") == ("special-tile-neighborhood",)
    assert at(plan_of(spark, pool | {(2, 3): tile(900)}), 3, 3, "reason") == ("unknown-solid-neighborhood",)
    assert at(plan_of(spark, pool | {(3, 4): tile(1) | wet()}), 3, 4, "entry", "reason") == ("hidden", "inside-solid")
    half = plan_of(spark, pool | {(3, 4): tile(1, shape=1, wall=4) | wet()})
    assert at(half, 3, 4, "fidelity", "sy", "sh") == ("static-wet-halfbrick-top", 56, 8) and at(half, 3, 3, "fidelity") == ("static-full-liquid-near-shape",)
    slope = plan_of(spark, pool | {(3, 5): tile(1, shape=2)})
    assert at(slope, 3, 5, "reason", "type") == ("liquid-shape-geometry", 1)  # dry, but beside wet cells


def test_reports_count_each_entry_once(spark):
    own = {(0, 0): tile(1), (1, 0): tile(1), (2, 0): tile(5), (3, 0): tile(900), (4, 0): tile(900, shape=9), (5, 0): tile(373), (6, 0): tile(1, invisible_block=True), (0, 6): dict(wall=7)}
    blank = dict(active=False, type=0, shape=0, level=0, liquid=0, wall=0, frame_x=None, frame_y=None, paint=0, inactive=False, invisible_block=False, invisible_wall=False)
    rows = [(w, x, y, *(blank | own.get((x, y), {})).values()) for w in (1, 2) for x in range(7) for y in range(7)]
    entries = planner.plan_cells(spark.createDataFrame(rows, "world_id int, " + PLANNED), ["world_id"])
    report = planner.audit_report(entries, spark.createDataFrame([("Tiles_1.png", 180, 60)], "asset string, width int, height int"))
    found = {(r.report, r.key): (r.n, r.x, r.y) for r in report.where("world_id = 2").collect()}
    assert found == {
        ("visible", ""): (6, 0, 0), ("planned", ""): (2, 0, 0), ("commands", "tile"): (2, 0, 0), ("commands", "wall"): (1, 0, 6), ("unsupported types", "5"): (1, 2, 0), ("unsupported types", "900"): (2, 3, 0), ("unsupported reasons", "family-tree"): (1, 2, 0),
        ("unsupported reasons", "unimplemented-type"): (2, 3, 0), ("hidden types", "373"): (1, 5, 0), ("missing assets", "Wall_7.png"): (1, 0, 6), ("invalid crops", "Tiles_1.png"): (1, 1, 0), ("required assets", "Tiles_1.png"): (2, 0, 0),
        ("required assets", "Wall_7.png"): (1, 0, 6),
    }
    assert all(r.balanced and (r.visible, r.planned, r.hidden, r.unsupported) == (6, 2, 1, 3) for r in planner.balance(report).collect())
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(world_id#") >= 2  # the cells once, then counts


def test_bridges(spark):
    cells = lambda own: tiles(spark, own).withColumn("half", F.col("shape") == 1)
    one = lambda own: windows.bridge_levels(cells(own)).where("x = 120 and y = 80").first()
    lent = one({(119, 80): wet(), (121, 80): wet(1)})
    assert (lent.bridge_kind, abs(lent.bridged - (1 + 1 / 255) / 2) < 1e-6) == (1, True)
    assert one({(119, 80): wet(), (121, 80): wet(1, 2)}).bridged == 0
    assert one({(119, 80): wet(), (121, 80): wet() | block()}).bridged == 0
    both = one({(119, 80): wet(51, 2), (121, 80): wet(51, 2), (120, 79): wet(102, 1), (120, 81): wet(102, 1)})
    assert (both.bridge_kind, round(both.bridged, 5)) == (2, 0.4)
    full = one({(120, 80): block(1), (120, 79): wet(3, 2)})
    assert (full.bridged, full.bridge_kind, full.full) == (1.0, 2, True)


def test_falling_lengths(spark):
    """Water falls ten rows, lava three, honey two; the first weights are a step less than one."""
    for kind, length in ((1, 10), (2, 3), (3, 2)):
        cells = tiles(spark, {(120, 79): wet(255, kind)}, width=(120, 121)).withColumn("half", F.lit(False))
        seeds = windows.bridge_levels(cells).select("x", "y", F.col("bridge_kind").alias("liquid"), F.col("bridged").alias("level"), "is_solid", "full")
        found = {r.y: r for r in windows.fall_levels(seeds).collect()}
        assert round(found[80].fallen, 6) == round(found[80].opacity, 6) == round(1 - 1 / (length + 1), 6) and found[80].fall_kind == kind
        assert found[79 + length].fallen > 0 and found[80 + length].fallen == 0


def test_records_round_trip():
    import itertools

    for kind, wall, liquid, frame, flags in itertools.product((None, 3, 21, 300), (0, 7, 317), ((0, 0), (9, 1), (8, 3), (7, 4)), (False, True), range(8)):
        tile = {"active": kind is not None, "type": kind or 0, "wall": wall, "liquid": liquid[0], "liquid_kind": liquid[1], "shape": flags % 6 if kind else 0, "wire_red": bool(flags & 1), "wire_yellow": bool(flags & 2), "invisible_block": bool(flags & 4)}
        tile |= {"paint": flags if kind else 0, "wall_paint": flags if wall else 0, "frame_x": None, "frame_y": None}
        framed = bytes([0] * 4096)
        if frame and kind == 21:
            tile |= {"frame_x": 18, "frame_y": -2}
            framed = bytes(k == 21 for k in range(4096))
        for repeats in (0, 1, 255, 256, 4000):
            c = worlds.Cursor(worlds.encode_record(tile, repeats))
            found, again, _ = worlds.read_record(c, framed)
            assert again == repeats and c.pos == c.end and all(found[k] == v for k, v in tile.items()), (tile, found)


def test_joining_blocks_thorns_and_glow(spark):
    own = {
        (0, 0): tile(158), (1, 0): tile(158, shape=1, paint=3), (2, 0): tile(158, frame_x=0), (4, 0): tile(32), (4, 1): tile(23), (6, 0): tile(32, shape=1), (0, 3): tile(381, paint=7), (0, 4): tile(381, shape=1), (3, 3): tile(158, invisible_block=True),
        (3, 4): tile(158), (5, 4): tile(655), (5, 5): tile(60), (5, 3): tile(655, inactive=True),
    }
    found = plan_of(spark, own)
    at = lambda x, y, *names, kind="tile": tuple(found[x, y, kind][n] for n in names)
    assert at(0, 0, "sx", "sy", "sh", "fidelity") == (*facts.BLOCK_FRAMES[4], 16, "approximate-static-block")
    assert at(1, 0, "sx", "sy", "sh", "dy", "shape", "paint") == (*facts.BLOCK_FRAMES[2 + 4], 8, 8, 1, 3) and at(2, 0, "entry", "reason") == ("omitted", "framed-static-block")
    assert at(4, 0, "sx", "sy", "sh", "dh", "fidelity") == (*facts.BLOCK_FRAMES[8], 18, 18, "approximate-static-thorn") and at(6, 0, "reason") == ("shaped-thorn",)
    assert at(3, 4, "sx", "sy") == facts.BLOCK_FRAMES[0] and at(5, 4, "sx", "sy") == facts.BLOCK_FRAMES[1 + 8]
    assert at(0, 3, "asset", "paint", "tint") == ("Tiles_381.png", 7, None)
    assert at(0, 3, "entry", "asset", "sx", "sy", "dx", "dy", "paint", "tint", "fidelity", kind="tile overlay") == ("command", "Glow_126.png", *facts.BLOCK_FRAMES[8], 0, 48, 0, [150, 100, 50, 0], "static-glow-mask")
    assert at(0, 4, "sx", "sy", "sh", "dy", kind="tile overlay") == at(0, 4, "sx", "sy", "sh", "dy") == (*facts.BLOCK_FRAMES[1], 8, 72)
    assert {k for k in found if k[2] == "tile overlay"} == {(0, 3, "tile overlay"), (0, 4, "tile overlay")}


def test_objects_of_saved_frames(spark):
    cases = [
        (28, (36, 18), (36, 18, 16, 16, 0, 2)), (73, (18, 0), (18, 0, 16, 32, 0, -12)), (165, (18, 36), (18, 36, 16, 16, 0, 0)), (178, (0, 36), (0, 36, 16, 16, 0, 2)), (178, (0, 54), (0, 54, 16, 16, 0, 0)), (184, (22, 36), (22, 36, 20, 16, -2, 2)),
        (184, (0, 54), (0, 54, 20, 16, -2, -2)), (184, (0, 108), (0, 108, 20, 16, -2, -1)), (184, (0, 126), (0, 126, 20, 16, -2, 0)), (184, (0, 162), (0, 162, 20, 16, 2, 0)), (184, (0, 216), "unknown-attachment"), (185, (1926, 18), (18, 36, 16, 16, 0, 2)),
        (185, (1926, 0), (1926, 0, 16, 16, 0, 2)), (187, (3798, 18), (18, 90, 16, 16, 0, 2)), (506, None, "object-without-frame"), (105, (-18, 0), "object-without-frame"),
    ]
    own = {}
    for k, (type_, frame, _) in enumerate(cases):
        own |= {(3 * k + side, 2): tile(type_, **(dict(frame_x=frame[0], frame_y=frame[1]) if frame else {})) for side in (0, 1)}
    found = plan_of(spark, own, (3 * len(cases), 4))
    for k, (type_, _, expected) in enumerate(cases):
        for x in (3 * k, 3 * k + 1):
            r = found[x, 2, "tile"]
            if isinstance(expected, str):
                assert (r.entry, r.reason) == ("omitted", expected)
            else:
                assert (r.sx, r.sy, r.sw, r.sh, r.dx - 16 * x, r.dy - 32) == expected and r.flip == (type_ == 73 and x % 2 == 0)
