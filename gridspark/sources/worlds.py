"""World files: a versioned binary header, and each column of the grid as run-length records.

One pass over a file checks its header, walks its records to find where the columns start, and hands on the columns' bytes;
the columns of all files are then dealt out and decoded. A file that breaks a rule gives an error row and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.runs import compress_cells
from gridspark.operators.storage import stored

from .files import write_blobs

#: Supported versions, accepted signatures and size limits.
VERSIONS, SIGNATURES = range(269, 327), (b"relogic", b"xindong")
MAX_BYTES, MAX_CELLS, MAX_WIDTH, MAX_HEIGHT, MAX_TYPES, MAX_NAME = 64 << 20, 24_000_000, 10_000, 5_000, 4_096, 4_096
#: Columns handed on in one row.
SLICE = 64

TILE = "active boolean, type int, frame_x int, frame_y int, wall int, paint int, wall_paint int, liquid int, liquid_kind int, shape int, wire_red boolean, wire_blue boolean, wire_green boolean, wire_yellow boolean, actuator boolean, inactive boolean, invisible_block boolean, invisible_wall boolean, fullbright_block boolean, fullbright_wall boolean"
#: The optional fields of a world's scene: trees, backgrounds, flags, and the state that herbs depend on; each group with why it isn't there.
SCENE_FIELDS = (
    "world_surface double, tree_x array<int>, tree_style array<int>, tree_tops array<int>, jungle_bg int, snow_bg int, hallow_bg int, drunk_world boolean, get_good_world boolean, tenth_anniversary_world boolean, dont_starve_world boolean,"
    " not_the_bees_world boolean, remix_world boolean, no_traps_world boolean, zenith_world boolean, skyblock_world boolean, tree_error string, day_time boolean, time double, moon_phase int, blood_moon boolean, raining boolean,"
    " cloud_alpha double, herb_error string"
)
WORLD = f"world_id string, signature string, version int, name string, seed string, id int, width int, height int, {SCENE_FIELDS}, records long, sha256 string"
#: What follows a header's dimensions, in order: name (or none), format, first version that has it. ``text``: that many strings; ``skip``: that
#: many times so many bytes, after a count of the format.
SCENE = (
    ("mode", "i", 0), ("drunk_world", "B", 0), ("get_good_world", "B", 0), ("tenth_anniversary_world", "B", 0), ("dont_starve_world", "B", 0), ("not_the_bees_world", "B", 0), ("remix_world", "B", 0), ("no_traps_world", "B", 0),
    ("zenith_world", "B", 0), ("skyblock_world", "B", 302), (None, "8s", 0), (None, "8s", 284), (None, "B", 0), ("tree_x", "3i", 0), ("tree_style", "4i", 0), (None, "48s", 0), ("world_surface", "d", 0), (None, "d", 0), ("time", "d", 0),
    ("day_time", "B", 0), ("moon_phase", "i", 0), ("blood_moon", "B", 0), ("eclipse", "B", 0), (None, "9s", 0), (None, "27s", 0), (None, "29s", 0), ("raining", "B", 0), (None, "i", 0), ("cloud_alpha", "f", 0), (None, "12s", 0),
    ("backgrounds", "8B", 0), (None, "10s", 0), ("text", "i", 0), (None, "16s", 0), ("skip 4", "h", 0), ("skip 2", "h", 289), (None, "19s", 0), (None, "6s", 0), ("skip 4", "i", 0), (None, "30s", 0), ("tops", "i", 0), ("tree_tops", "13i", 0),
)
#: Most entries of a counted list, tree tops of a world, bounds of values.
MOST_LISTED, TREE_TOPS, DAY = 10_000, 13, 86_400
FLAGS = ("drunk_world", "get_good_world", "tenth_anniversary_world", "dont_starve_world", "not_the_bees_world", "remix_world", "no_traps_world", "zenith_world", "skyblock_world")
HERB = ("day_time", "time", "moon_phase", "blood_moon", "raining", "cloud_alpha")


class FormatError(ValueError):
    """A file breaks the format."""


@dataclass
class Cursor:
    """Little-endian reads that never pass ``end``."""

    data: bytes
    pos: int = 0
    end: int = field(default=-1)

    def __post_init__(self) -> None:
        self.end = len(self.data) if self.end < 0 else self.end

    def take(self, fmt: str):
        size = struct.calcsize("<" + fmt)
        if self.pos + size > self.end:
            raise FormatError(f"truncated at {self.pos}")
        out = struct.unpack_from("<" + fmt, self.data, self.pos)
        self.pos += size
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        """A string after its length in 7-bit groups."""
        size, shift = 0, 0
        while True:
            byte = self.take("B")
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
            if shift >= 35:
                raise FormatError("bad string length")
        if size > MAX_NAME:
            raise FormatError("string too long")
        try:
            return self.take(f"{size}s").decode("utf-8") if size else ""
        except UnicodeDecodeError as e:
            raise FormatError("bad UTF-8") from e


def read_record(c: Cursor, framed: bytes) -> tuple[dict, int, int]:
    """A record's tile, its further repeats, and where its run length starts."""
    head = [c.take("B")]
    while head[-1] & 1 and len(head) < 4:
        head.append(c.take("B"))
    a, b, d, e = head + [0] * (4 - len(head))
    on = lambda byte, bit: bool(byte >> bit & 1)
    tile = dict.fromkeys(("type", "wall", "paint", "wall_paint", "liquid", "liquid_kind"), 0) | {"active": on(a, 1), "frame_x": None, "frame_y": None, "shape": b >> 4 & 7}
    tile |= {"wire_red": on(b, 1), "wire_blue": on(b, 2), "wire_green": on(b, 3), "wire_yellow": on(d, 5), "actuator": on(d, 1), "inactive": on(d, 2)}
    tile |= {"invisible_block": on(e, 1), "invisible_wall": on(e, 2), "fullbright_block": on(e, 3), "fullbright_wall": on(e, 4)}
    if tile["active"]:
        tile["type"] = c.take("H" if on(a, 5) else "B")
        if tile["type"] >= len(framed):
            raise FormatError("type outside the frame table")
        if framed[tile["type"]]:
            tile["frame_x"], tile["frame_y"] = c.take("hh")
        if on(d, 3):
            tile["paint"] = c.take("B")
    if on(a, 2):
        tile["wall"] = c.take("B")
        if on(d, 4):
            tile["wall_paint"] = c.take("B")
    if kind := a >> 3 & 3:
        tile["liquid"], tile["liquid_kind"] = c.take("B"), 4 if on(d, 7) else kind
    if on(d, 6):
        tile["wall"] |= c.take("B") << 8
    cut = c.pos
    repeats = (lambda: 0, lambda: c.take("B"), lambda: c.take("h"), lambda: c.take("h"))[a >> 6]()
    if repeats < 0:
        raise FormatError("negative run")
    return tile, repeats, cut


def read_header(data: bytes) -> tuple[dict, bytes, tuple[int, int]]:
    """The world's fields, which types have a frame, and the bounds of the cells' section."""
    if len(data) > MAX_BYTES:
        raise FormatError("file too large")
    c = Cursor(data)
    version, signature, kind = c.take("i7sB")
    if version not in VERSIONS:
        raise FormatError(f"version {version}")
    if signature not in SIGNATURES or kind != 2:
        raise FormatError("not a world")
    c.take("12s")
    count = c.take("H")
    if not 3 <= count <= 32:
        raise FormatError("section count")
    sections = [c.take("i") for _ in range(count)]
    if sections != sorted(sections) or sections[0] < c.pos or sections[-1] > len(data):
        raise FormatError("section offsets")
    types = c.take("H")
    if not 1 <= types <= MAX_TYPES:
        raise FormatError("frame table")
    bits = int.from_bytes(c.take(f"{(types + 7) // 8}s"), "little")
    framed = bytes(bits >> k & 1 for k in range(types))
    if c.pos != sections[0]:
        raise FormatError("header section")
    c.end = sections[1]
    name, seed = c.text(), c.text()
    c.take("24s")
    number = c.take("i")
    c.take("16s")
    height, width = c.take("ii")
    if not (0 < width <= MAX_WIDTH and 0 < height <= MAX_HEIGHT and width * height <= MAX_CELLS):
        raise FormatError("dimensions")
    world = {"signature": signature.decode(), "version": version, "name": name, "seed": seed, "id": number, "width": width, "height": height}
    return world | read_scene(c, version, width, height), framed, (sections[1], sections[2])


def read_scene(c: Cursor, version: int, width: int, height: int) -> dict:
    """SCENE_FIELDS from where the dimensions end. What the header doesn't hold, or holds wrongly, is null, with a reason; that is no error of the file."""
    got: dict = {}
    broken = None
    try:
        for name, fmt, since in SCENE:
            if version < since:
                continue
            value = c.take(fmt)
            if name in ("text",) or (name or "").startswith("skip"):
                if not 0 <= value <= MOST_LISTED:
                    raise FormatError("count in the scene")
                for _ in range(value):
                    c.text() if name == "text" else c.take(f"{name[5:]}s")
            elif name == "tops" and value != TREE_TOPS:
                raise FormatError("number of tree tops")
            elif name:
                got[name] = list(value) if isinstance(value, tuple) else value
    except FormatError as e:
        broken = str(e)
    out = dict.fromkeys((part.split()[0] for part in SCENE_FIELDS.split(", ")))
    surface, cuts = got.get("world_surface"), got.get("tree_x")
    grounded = surface is not None and 0 <= surface <= height
    if grounded:
        out |= {"world_surface": surface, "tree_x": cuts}
    ordered = grounded and all(0 <= x <= width for x in cuts) and cuts == sorted(cuts) and all(0 <= t <= 255 for t in got.get("tree_tops", ()))
    if "tree_tops" in got and ordered:
        backs = got["backgrounds"]
        out |= {k: got[k] for k in ("tree_style", "tree_tops")} | {k: bool(got[k]) for k in FLAGS if k in got} | {"jungle_bg": backs[2], "snow_bg": backs[3], "hallow_bg": backs[4]}
    else:
        out["tree_error"] = broken or "values of the trees"
    flags = [got.get(k) for k in ("day_time", "blood_moon", "eclipse", "raining", "remix_world")]
    valid = grounded and all(f in (0, 1) for f in flags) and 0 <= got.get("time", -1) <= DAY and 0 <= got.get("moon_phase", -1) <= 7 and 0 <= got.get("cloud_alpha", -1) <= 1
    if valid:
        out |= {k: bool(got[k]) if k in ("day_time", "blood_moon", "raining") else got[k] for k in HERB} | {"remix_world": bool(got["remix_world"])}
    else:
        out["herb_error"] = broken if broken and "cloud_alpha" not in got else "values of the herbs' state"
    return out


def encode_scene(scene: Mapping, version: int) -> bytes:
    """The bytes of a scene: the inverse of read_scene; absent fields are zero, lists are empty."""
    out = b""
    for name, fmt, since in SCENE:
        if version >= since:
            value = scene.get(name) if name else None
            if name == "tops":
                value = TREE_TOPS
            if name == "backgrounds":
                value = [0, 0, *(scene.get(k) or 0 for k in ("jungle_bg", "snow_bg", "hallow_bg")), 0, 0, 0]
            if value is None:
                out += bytes(struct.calcsize("<" + fmt))
            else:
                out += struct.pack("<" + fmt, *(value if isinstance(value, (list, tuple)) else [value]))
    return out


def column_starts(data: bytes, framed: bytes, bounds: tuple[int, int], width: int, height: int) -> tuple[list[int], int]:
    """Where each column starts (and the last ends), and the number of records; every run must stay in its column."""
    c, starts, records = Cursor(data, *bounds), [], 0
    for _ in range(width):
        starts.append(c.pos)
        y = 0
        while y < height:
            y += read_record(c, framed)[1] + 1
            records += 1
        if y > height:
            raise FormatError("run crosses its column")
    if c.pos != c.end:
        raise FormatError("cells' section length")
    return [*starts, c.pos], records


OPENED_SCHEMA = f"world_id string, error string, signature string, version int, name string, seed string, id int, width int, height int, {SCENE_FIELDS}, records long, x0 int, ends array<int>, content binary, framed binary"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"]):
            data = data.as_py()
            try:
                world, framed, bounds = read_header(data)
                starts, records = column_starts(data, framed, bounds, world["width"], world["height"])
            except FormatError as e:
                yield _batch([{"world_id": path, "error": str(e)}], OPENED_SCHEMA)
                continue
            yield _batch([{"world_id": path, "records": records} | world], OPENED_SCHEMA)
            for x in range(0, world["width"], SLICE):
                last = min(world["width"], x + SLICE)
                ends = [s - starts[x] for s in starts[x + 1 : last + 1]]
                yield _batch([{"world_id": path, "x0": x, "ends": ends, "content": data[starts[x] : starts[last]], "framed": framed}], OPENED_SCHEMA)


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in ddl.split(", "))]))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            data, rows = part["content"], []
            c = Cursor(data)
            for k, end in enumerate(part["ends"]):
                y = 0
                while c.pos < end:
                    start = c.pos
                    tile, repeats, cut = read_record(c, part["framed"])
                    raw = bytes([data[start] & 63]) + data[start + 1 : cut]
                    rows.append({"world_id": part["world_id"], "x": part["x0"] + k, "y0": y, "run_len": repeats + 1, **tile, "raw": raw})
                    y += repeats + 1
            yield _batch(rows, RUNS)


RUNS = f"world_id string, x int, y0 int, run_len int, {TILE}, raw binary"


def ingest_worlds(spark: SparkSession, path: str, mode: str = "permissive") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worlds, runs, errors) of all files under ``path``. ``failfast``: the first bad file is an error.

    Spark doesn't list files of no bytes: they give no row."""
    files = spark.read.format("binaryFile").load(path)
    opened = stored(files.select("path", "content").mapInArrow(_open, OPENED_SCHEMA))
    errors = opened.where("error is not null").select("world_id", "error")
    if mode == "failfast" and (bad := errors.first()):
        raise FormatError(f"{bad.world_id}: {bad.error}")
    digest = files.select(F.col("path").alias("world_id"), F.sha2("content", 256).alias("sha256"))
    names = [part.split()[0] for part in WORLD.split(", ")]
    worlds = opened.where("version is not null").drop("error").join(digest, "world_id").select(*names)
    slices = opened.where("x0 is not null").select("world_id", "x0", "ends", "content", "framed").repartition("world_id", "x0")
    return worlds, slices.mapInArrow(_decode, RUNS), errors


def encode_record(tile: dict, repeats: int) -> bytes:
    """A record of a tile (fields of read_record; missing ones are empty) and its further repeats: the inverse of read_record."""
    t = tile.get
    flag = lambda *names: sum(bool(t(name)) << k for k, name in enumerate(names))
    wall, liquid, fourth = t("wall") or 0, t("liquid") or 0, t("liquid_kind") == 4
    e = flag("invisible_block", "invisible_wall", "fullbright_block", "fullbright_wall") << 1
    d = flag("actuator", "inactive") << 1 | bool(t("active") and t("paint")) << 3 | bool(wall and t("wall_paint")) << 4 | bool(t("wire_yellow")) << 5 | (wall > 255) << 6 | (fourth and liquid > 0) << 7 | bool(e)
    b = flag("wire_red", "wire_blue", "wire_green") << 1 | (t("shape") or 0) << 4 | bool(d)
    a = bool(t("active")) << 1 | bool(wall) << 2 | ((1 if fourth else t("liquid_kind")) << 3 if liquid else 0) | bool(t("active") and t("type") > 255) << 5 | (min(2, (repeats > 0) + (repeats > 255))) << 6 | bool(b)
    out = bytes([a, b, d, e][: 1 + (a & 1) + (a & b & 1) + (a & b & d & 1)])
    if t("active"):
        out += struct.pack("<H" if t("type") > 255 else "B", t("type"))
        out += struct.pack("<hh", t("frame_x"), t("frame_y")) if t("frame_x") is not None else b""
        out += bytes([t("paint")]) if t("paint") else b""
    out += bytes([wall & 255]) if wall else b""
    out += bytes([t("wall_paint")]) if wall and t("wall_paint") else b""
    out += bytes([liquid]) if liquid else b""
    out += bytes([wall >> 8]) if wall > 255 else b""
    return out + (b"" if not repeats else bytes([repeats]) if repeats < 256 else struct.pack("<h", repeats))


def encode_world(cells: bytes, width: int, height: int, name: str, types: int, framed: Sequence[int] = (), version: int = VERSIONS[0], scene: Mapping | None = None) -> bytes:
    """A file of the columns' records, with the sections that read_header asks for. Without a ``scene`` the header ends at the dimensions."""
    bits = sum(1 << k for k in framed).to_bytes((types + 7) // 8, "little")
    text = lambda s: bytes([len(s.encode())]) + s.encode()
    start = 4 + 7 + 1 + 12 + 2 + 12 + 2 + len(bits)
    header = text(name) + text("") + bytes(24) + struct.pack("<i", 0) + bytes(16) + struct.pack("<ii", height, width) + (encode_scene(scene, version) if scene is not None else b"")
    sections = start, start + len(header), start + len(header) + len(cells)
    return struct.pack("<i7sB12sH3iH", version, SIGNATURES[0], 2, b"", 3, *sections, types) + bits + header + cells


def write_worlds(cells: DataFrame, path: str, world: Sequence[str], scenes: DataFrame | None = None) -> None:
    """A file ``world-<keys>.wld`` for each world of ``cells (world..., x, y, <any fields of a tile>)``: dense columns from x = 0, y = 0. ``scenes (world..., fields of
    SCENE)`` has the scene of some or all worlds.

    Runs are made by Spark and encoded in slices of SLICE columns; one group a world joins its slices' bytes, which the format bounds by MAX_BYTES.
    """
    fields = [c for c in cells.columns if c not in (*world, "x", "y")]
    runs = compress_cells(cells, fields, world).withColumn("_slice", F.floor(F.col("x") / F.lit(SLICE)))
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in world)

    def encode(group: pa.Table) -> pa.Table:
        group = group.sort_by([("x", "ascending"), ("y0", "ascending")])
        data = b"".join(encode_record(r, r["run_len"] - 1) for r in group.to_pylist())
        first = group.slice(0, 1)
        tall = max(y + n for y, n in zip(group["y0"].to_pylist(), group["run_len"].to_pylist()))
        own = {k: first[k].combine_chunks() for k in (*world, "_slice")}
        return pa.table(own | {"columns": pa.array([len(set(group["x"].to_pylist()))], pa.int32()), "height": pa.array([tall], pa.int32()), "data": pa.array([data], pa.binary())})

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("_slice")
        name = "-".join(str(group[k][0].as_py()) for k in world)
        scene = group["_scene"][0].as_py()
        content = encode_world(b"".join(group["data"].to_pylist()), sum(group["columns"].to_pylist()), max(group["height"].to_pylist()), f"world {name}", MAX_TYPES, scene=scene)
        return pa.table({"file": pa.array([f"world-{name}.wld"]), "content": pa.array([content], pa.binary())})

    slices = runs.groupBy(*world, "_slice").applyInArrow(encode, f"{kinds}, _slice long, columns int, height int, data binary")
    if scenes is None:
        slices = slices.withColumn("_scene", F.lit(None).cast("struct<mode: int>"))
    else:
        slices = slices.join(scenes.select(*world, F.struct(*[c for c in scenes.columns if c not in world]).alias("_scene")), list(world), "left")
    write_blobs(slices.groupBy(*world).applyInArrow(join, "file string, content binary"), path)
