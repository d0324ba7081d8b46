import struct

import pytest
from pyspark.sql import functions as F

from gridspark.operators import project
from gridspark.sources import files, grids, world_index, worlds
from gridspark.streaming import incremental as inc


def text(s: str) -> bytes:
    data = s.encode()
    assert len(data) < 128
    return bytes([len(data)]) + data


def run(kind=1, repeats=0, frame=None, wall=0, liquid=0, red=False, yellow=False, invisible=False, paint=0) -> bytes:
    e = 4 * 0 + (2 if invisible else 0)
    d = (32 if yellow else 0) | (8 if paint else 0) | (64 if wall > 255 else 0) | (1 if e else 0)
    b = (2 if red else 0) | (1 if d else 0)
    a = (2 | (32 if kind > 255 else 0) if kind is not None else 0) | (4 if wall else 0) | (8 if liquid else 0) | (1 if b else 0)
    a |= (0 if not repeats else 1 if repeats < 256 else 2) << 6
    out = bytes([a]) + (bytes([b]) if a & 1 else b"") + (bytes([d]) if b & 1 else b"") + (bytes([e]) if d & 1 else b"")
    if kind is not None:
        out += struct.pack("<H", kind) if kind > 255 else bytes([kind])
        out += struct.pack("<hh", *frame) if frame else b""
        out += bytes([paint]) if paint else b""
    out += bytes([wall & 255]) if wall else b""
    out += bytes([liquid]) if liquid else b""
    out += bytes([wall >> 8]) if wall > 255 else b""
    return out + (b"" if not repeats else bytes([repeats]) if repeats < 256 else struct.pack("<h", repeats))


def world(columns, height, version=269, framed=(21,), signature=b"relogic", tail=b"") -> bytes:
    bits = sum(1 << k for k in framed).to_bytes(64, "little")
    head = struct.pack("<i7sB12sH", version, signature, 2, b"", 3)
    start = len(head) + 12 + 2 + 64
    header = text("World 世界") + text("seed") + bytes(24) + struct.pack("<i", 77) + bytes(16) + struct.pack("<ii", height, len(columns)) + bytes(128)
    cells = b"".join(b"".join(c) for c in columns) + tail
    at = (start, start + len(header), start + len(header) + len(cells))
    return head + struct.pack("<iii", *at) + struct.pack("<H", 512) + bits + header + cells


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.wld").write_bytes(world([[run(1, 2), run(None, 4)], [run(21, 0, frame=(18, -2)), run(300, 5, wall=317, liquid=9, red=True, yellow=True, invisible=True, paint=4), run(0)]], 8))
    (tmp_path / "b.wld").write_bytes(world([[run(1, 300), run(2, 99)]] * 70, 401))
    (tmp_path / "cut.wld").write_bytes(world([[run(1, 2)]], 3)[:-1])
    (tmp_path / "long.wld").write_bytes(world([[run(1, 9)]], 3))
    (tmp_path / "old.wld").write_bytes(world([[run(1, 2)]], 3, version=200))
    (tmp_path / "tail.wld").write_bytes(world([[run(1, 2)]], 3, tail=b"x"))
    (tmp_path / "stub.wld").write_bytes(b"\0")
    return tmp_path


def test_worlds_runs_and_errors(spark, folder):
    found, runs, errors = worlds.ingest_worlds(spark, f"file://{folder}")
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.world_id): (r.width, r.height, r.records, r.name, r.id) for r in found.collect()} == {"a.wld": (2, 8, 5, "World 世界", 77), "b.wld": (70, 401, 140, "World 世界", 77)}
    assert {name(r.world_id) for r in errors.collect()} == {"cut.wld", "long.wld", "old.wld", "tail.wld", "stub.wld"}
    own = sorted((r for r in runs.collect() if name(r.world_id) == "a.wld"), key=lambda r: (r.x, r.y0))
    assert [(r.x, r.y0, r.run_len, r.active, r.type) for r in own] == [(0, 0, 3, True, 1), (0, 3, 5, False, 0), (1, 0, 1, True, 21), (1, 1, 6, True, 300), (1, 7, 1, True, 0)]
    assert (own[2].frame_x, own[2].frame_y, own[3].frame_x) == (18, -2, None)
    assert (own[3].wall, own[3].liquid, own[3].liquid_kind, own[3].wire_red, own[3].wire_yellow, own[3].invisible_block, own[3].paint) == (317, 9, 1, True, True, True, 4)
    assert all(r.raw[0] < 64 for r in own)
    sums = runs.groupBy("world_id", "x").agg(F.sum("run_len").alias("n")).select("world_id", "n").distinct()
    assert sorted((name(r.world_id), r.n) for r in sums.collect()) == [("a.wld", 8), ("b.wld", 401)]


def test_failfast(spark, folder):
    with pytest.raises(worlds.FormatError):
        worlds.ingest_worlds(spark, f"file://{folder}", mode="failfast")


def test_grid_files_prune_and_refuse_existing(spark, tmp_path):
    path = f"file://{tmp_path}/grid"
    cells = grids.formula_grid(spark, 300, 20)
    grids.write_grid(cells, path)
    part = grids.read_grid(spark, path, 130, 20)
    assert part.count() == 400
    assert "PartitionFilters: [isnotnull(cx" in part._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        grids.write_grid(cells, path)
    manifest = grids.write_chunked(cells, f"file://{tmp_path}/chunks", 128, 16)
    expected = grids.chunk_manifest(cells, 128, 16)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, expected.collect()))


def test_fragments_round_trip_and_violations(spark, tmp_path):
    rect, source = (2, 3, 2, 3), ("relogic", "w", 1, 10, 10, None)
    fragments = spark.createDataFrame([("f", 300, rect, source, [0, 1])], f"fragment_id string, version int, rect {files.RECT}, source {files.SOURCE}, important array<int>")
    raw = [b"\x02\x01", b"\x00", b"\x02\x01", b"\x02\x05", b"\x00", b"\x02\x01"]
    cells = spark.createDataFrame([("f", k, r) for k, r in enumerate(raw)], "fragment_id string, index int, raw binary")
    good = files.fragment_json(cells, fragments).first().json
    bad = {"checksum": good.replace('"version":300', '"version":301'), "version": good.replace('"version":300', '"version":1'), "structure": good.replace('"order"', '"other":1,"order"'), "cell index": None}
    files.write_fragments(cells, fragments, f"file://{tmp_path}/f")
    (tmp_path / "f" / "more.txt").write_text("\n".join([x for x in bad.values() if x] + ["not json"]) + "\n")
    head, back, wrong = files.read_fragments(spark, f"file://{tmp_path}/f")
    assert head.count() == 1
    assert [bytes(r.raw) for r in back.orderBy("index").collect()] == raw
    assert [(r.x, r.y) for r in back.orderBy("index").collect()] == [(2, 3), (2, 4), (2, 5), (3, 3), (3, 4), (3, 5)]
    assert sorted(r.reason for r in wrong.collect()) == ["checksum", "structure", "structure", "version"]


def test_assets(spark, tmp_path):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + struct.pack(">II", 48, 32) + b"rest"
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "tile_1.png").write_bytes(png)
    (tmp_path / "img" / "bad.png").write_bytes(b"GIF89a")
    found = {r.file: (r.bytes, r.width, r.height, r.status) for r in files.catalog_assets(spark, f"file://{tmp_path}/img").collect()}
    assert found == {"tile_1.png": (len(png), 48, 32, "ok"), "bad.png": (6, None, None, "not an image")}
    h = "0" * 64
    (tmp_path / "m.json").write_text('{"textures": [{"file": "a", "bytes": 1, "sha256": "%s"}, {"file": "b", "bytes": 0, "sha256": "%s"}, {"file": "c", "bytes": 1, "sha256": "x"}, {"file": "d", "bytes": 1, "sha256": "%s"}, {"file": "d", "bytes": 1, "sha256": "%s"}]}' % (h, h, h, h))
    good, bad = files.read_asset_manifest(spark, f"file://{tmp_path}/m.json")
    assert [r.file for r in good.collect()] == ["a"]
    assert sorted((r.file, r.reason) for r in bad.collect()) == [("b", "size"), ("c", "hash"), ("d", "duplicate"), ("d", "duplicate")]


def test_bench_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"timing": {"endToEndSeconds": 1.5}, "render": {"commandCounts": {"tile": 3}}, "fidelity": {"patches": []}}')
    r = files.read_bench_runs(spark, f"file://{tmp_path}/r.json").first()
    assert (r.timing.endToEndSeconds, r.render.commandCounts) == (1.5, {"tile": 3})


def test_unpack_is_inverse_of_pack(spark):
    df = spark.createDataFrame([(True, False, True), (None, True, False)], "a boolean, b boolean, c boolean")
    flags = {"active": F.col("a"), "wire_blue": F.col("b"), "has_frame": F.col("c")}
    assert [r[0] for r in df.select(project.pack_flags(flags)).collect()] == [1 + 2048, 4]


def test_streams_equal_batches(spark, tmp_path):
    data = spark.range(200).selectExpr("id", "id % 3 AS kind", "timestamp_seconds(id * 60) AS ts", "cast(id % 50 AS double) AS value")
    for k in range(3):
        data.where(f"id % 3 = {k}").write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: inc.read_stream(spark, f"file://{tmp_path}/in")
    found = inc.run_available(inc.stream_inventory(stream(), ["kind"]), "complete")
    assert sorted(map(tuple, found.collect())) == [(0, 67), (1, 67), (2, 66)]
    newest = inc.run_available(inc.latest_request(stream(), "kind", "id", ["value"]), "update", ["kind"])
    assert sorted(map(tuple, newest.collect())) == [(0, 198, 48.0), (1, 199, 49.0), (2, 197, 47.0)]


def test_index_and_byte_ranges(spark, folder):
    """Runs by the index are those of whole files; with other columns' bytes overwritten the same runs come, so no other bytes are read."""
    source, index = f"file://{folder}", f"file://{folder}-index"
    made = world_index.index_worlds(spark, source, index)
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.world_id) for r in made.where("error is not null").collect()} == {"cut.wld", "long.wld", "old.wld", "tail.wld", "stub.wld"}
    assert sorted((name(r.world_id), r.x0, r.columns, r.types, r.wet) for r in made.where("error is null").collect()) == [("a.wld", 0, 2, [0, 1, 21, 300], True), ("b.wld", 0, 64, [1, 2], False), ("b.wld", 64, 6, [1, 2], False)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        world_index.index_worlds(spark, source, index)
    _, runs, _ = worlds.ingest_worlds(spark, source)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(world_index.read_columns(spark, index)) == plain(runs.drop("raw"))
    some = world_index.read_columns(spark, index, x=65, width=2, y=299, height=5, fields=["type"])
    assert sorted(tuple(r)[1:] for r in some.collect()) == [(65, 299, 2, 1), (65, 301, 3, 2), (66, 299, 2, 1), (66, 301, 3, 2)]
    assert [tuple(r)[1:] for r in world_index.read_columns(spark, index, types=[300], fields=["wall", "liquid"]).collect()] == [(1, 1, 6, 317, 9)]
    assert [tuple(r)[1:] for r in world_index.read_columns(spark, index, wet=True, fields=[]).collect()] == [(1, 1, 6)]
    assert all(world_index.read_columns(spark, index, **none).count() == 0 for none in ({"types": []}, {"worlds": []}, {"width": 0}, {"height": 0}, {"x": 999}, {"y": 999}))
    with pytest.raises(ValueError, match="no fields"):
        world_index.read_columns(spark, index, fields=["colour"])
    row = made.where("x0 = 64").first()
    data = bytearray((folder / "b.wld").read_bytes())
    for k in range(row.start):
        data[k] = 255
    data[row.start + row.ends[3] :] = b"\xff" * (len(data) - row.start - row.ends[3])
    (folder / "b.wld").write_bytes(data)
    assert sorted(tuple(r)[1:] for r in world_index.read_columns(spark, index, x=65, width=2, y=299, height=5, fields=["type"]).collect()) == sorted(tuple(r)[1:] for r in some.collect())
    (folder / "b.wld").write_bytes(data + b"x")
    with pytest.raises(Exception, match="has changed"):
        some.collect()
