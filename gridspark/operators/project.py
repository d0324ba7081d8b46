"""Projections, filters and predicates over cells, rectangles and commands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalars import clamp

#: The largest side and the most cells of a requested rectangle, and the wall kind that is never shown.
MAX_SIDE, MAX_CELLS, UNSEEN_WALL = 512, 65_536, 318

#: The places of the flags in a packed cell's first two bytes.
FLAGS = ("active", "wire_red", "wire_blue", "wire_green", "wire_yellow", "actuator", "inactive", "invisible_block", "invisible_wall", "fullbright_block", "fullbright_wall", "has_frame")
#: Byte offset and width of the other fields of a packed cell (little-endian).
PACKED = {"flags": (0, 2), "type": (2, 2), "frame_x": (4, 2), "frame_y": (6, 2), "wall": (8, 2), "paint": (10, 1), "wall_paint": (11, 1), "liquid": (12, 1), "liquid_kind": (13, 1), "shape": (14, 1), "raw_len": (15, 1)}


def in_rect(x: int, y: int, width: int, height: int) -> Column:
    """Half-open; both bounds reach the scan."""
    return (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)


def region(cells: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Cells of a rectangle with ``local_x, local_y`` and their column-major ``index``."""
    local = {"local_x": F.col("x") - x, "local_y": F.col("y") - y, "index": (F.col("x") - x) * height + (F.col("y") - y)}
    return cells.where(in_rect(x, y, width, height)).withColumns(local)


def region_with_halo(cells: DataFrame, x: int, y: int, width: int, height: int, pad: int) -> DataFrame:
    """Cells of the padded rectangle; ``is_core`` marks the rectangle itself."""
    return cells.where(in_rect(x - pad, y - pad, width + 2 * pad, height + 2 * pad)).withColumn("is_core", in_rect(x, y, width, height))


def crop(fragments: DataFrame, cells: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Cells of a sub-rectangle of each fragment in ``fragments (fragment_id, width, height)``, in coordinates of the sub-rectangle.

    A fragment that doesn't hold the rectangle gives one row with null coordinates and ``reason`` outside.
    """
    fits = (F.lit(x) >= 0) & (F.lit(y) >= 0) & (F.lit(x + width) <= F.col("width")) & (F.lit(y + height) <= F.col("height"))
    good = fragments.where(fits).select("fragment_id")
    inner = cells.where(in_rect(x, y, width, height)).join(good, "fragment_id").withColumns({"x": F.col("x") - x, "y": F.col("y") - y, "reason": F.lit(None).cast("string")})
    return inner.unionByName(fragments.where(~fits).select("fragment_id", F.lit("outside").alias("reason")), allowMissingColumns=True)


def rect_from_points(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """The rectangle between two dragged-to cells (both inside), clamped to a world of width by height."""
    left, right = clamp(F.least(x1, x2), 0, width - 1), clamp(F.greatest(x1, x2), 0, width - 1)
    top, bottom = clamp(F.least(y1, y2), 0, height - 1), clamp(F.greatest(y1, y2), 0, height - 1)
    return F.struct(left.alias("x"), top.alias("y"), (right - left + 1).alias("width"), (bottom - top + 1).alias("height"))


def move_rect(x: Column, y: Column, w: Column, h: Column, dx: Column, dy: Column, width: int, height: int) -> Column:
    """A rectangle moved by (dx, dy), kept inside the world."""
    return F.struct(clamp(x + dx, 0, F.lit(width) - w).alias("x"), clamp(y + dy, 0, F.lit(height) - h).alias("y"), w.alias("width"), h.alias("height"))


def viewport_rect(left: Column, top: Column, scale: Column, view_w: int, view_h: int, width: int, height: int, halo: int = 0) -> Column:
    """Cells that a camera at (left, top) sees at ``scale`` pixels a cell, with a halo, clamped to the world."""
    x1, y1 = clamp(F.floor(left) - halo, 0, width), clamp(F.floor(top) - halo, 0, height)
    x2, y2 = clamp(F.ceil(left + view_w / scale) + halo, 0, width), clamp(F.ceil(top + view_h / scale) + halo, 0, height)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"))


def rect_reason(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, max_side: int = MAX_SIDE, max_cells: int = MAX_CELLS) -> Column:
    """Why a rectangle is refused, else null."""
    return (
        F.when((x != F.floor(x)) | (y != F.floor(y)) | (w != F.floor(w)) | (h != F.floor(h)), "not integer")
        .when((w <= 0) | (h <= 0), "empty")
        .when((x < 0) | (y < 0) | (x + w > width) | (y + h > height), "outside")
        .when((w > max_side) | (h > max_side), "side too long")
        .when(w * h > max_cells, "too many cells")
    )


def check_rects(rects: DataFrame, worlds: DataFrame, **limits: int) -> DataFrame:
    """``rects (world_id, x, y, w, h)`` with ``reason``; unknown worlds are refused too. ``worlds (world_id, width, height)``."""
    sized = rects.join(worlds, "world_id", "left")
    cols = [F.col(c) for c in ("x", "y", "w", "h", "width", "height")]
    return sized.withColumn("reason", F.when(F.col("width").isNull(), "unknown world").otherwise(rect_reason(*cols, **limits))).drop("width", "height")


def visible_block(active: Column, hidden: Column, reveal: bool = False) -> Column:
    return active if reveal else active & ~hidden


def visible_wall(wall: Column, hidden: Column, reveal: bool = False) -> Column:
    shown = (wall > 0) & (wall != UNSEEN_WALL)
    return shown if reveal else shown & ~hidden


def unpack_cell(cell: Column) -> dict[str, Column]:
    """Fields of a packed cell (binary), flags as booleans; frames are null without their flag."""

    def number(at: int, width: int) -> Column:
        parts = [F.conv(F.hex(F.substring(cell, at + k + 1, 1)), 16, 10).cast("int") * (1 << 8 * k) for k in range(width)]
        return sum(parts[1:], parts[0])

    fields = {name: number(*place) for name, place in PACKED.items()}
    flags = fields.pop("flags")
    out = {name: flags.bitwiseAND(1 << k) != 0 for k, name in enumerate(FLAGS)}
    for name in ("frame_x", "frame_y"):
        signed = F.when(fields[name] >= 1 << 15, fields[name] - (1 << 16)).otherwise(fields[name])
        fields[name] = F.when(out["has_frame"], signed)
    return out | fields


def pack_flags(flags: Mapping[str, Column]) -> Column:
    """The flag bits of a cell; null counts as false."""
    bits = [F.when(F.coalesce(flags[name], F.lit(False)), 1 << k).otherwise(0) for k, name in enumerate(FLAGS) if name in flags]
    return sum(bits[1:], bits[0]) if bits else F.lit(0)


def canonical_raw(raw: Column) -> Column:
    """A record's bytes without the two run bits of the first (its unknown bits stay)."""
    head = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int").bitwiseAND(0x3F)
    return F.when(F.length(raw) > 0, F.concat(F.unhex(F.lpad(F.hex(head), 2, "0")), F.substring(raw, F.lit(2), F.length(raw)))).otherwise(raw)


def cull(commands: DataFrame, x: int, y: int, width: int, height: int, guard: int = 1, size: int = 16, unknown: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): the commands that may show in the output, and how many of each kind were kept and culled. ``commands (kind, dx, dy, dw, dh, ...)``.

    A command goes if its rectangle (of positive size) lies beyond the output and its guard, and its owner, the cell (owner_x, owner_y) of
    ``size`` pixels, isn't inside. Owners are looked at only where the columns are there; a null owner stays, and so does what ``unknown`` marks (such
    as types of no known layer, which later steps must still report). Required assets are to be taken before the cull.
    """
    beyond = (F.col("dw") > 0) & (F.col("dh") > 0) & ((F.col("dx") + F.col("dw") + guard <= x) | (F.col("dy") + F.col("dh") + guard <= y) | (F.col("dx") - guard >= x + width) | (F.col("dy") - guard >= y + height))
    goes = F.coalesce(beyond, F.lit(False))
    if {"owner_x", "owner_y"} <= set(commands.columns):
        left, top = F.col("owner_x") * size, F.col("owner_y") * size
        inside = (left < x + width) & (top < y + height) & (left + size > x) & (top + size > y)
        goes = goes & ~(inside | left.isNull() | top.isNull())
    if unknown is not None:
        goes = goes & ~F.coalesce(unknown, F.lit(True))
    counts = commands.groupBy("kind").agg(F.count_if(~goes).alias("kept"), F.count_if(goes).alias("culled"))
    return commands.where(~goes), counts


def assign_chunk(cells: DataFrame, width: int = 128, height: int = 128) -> DataFrame:
    """Adds ``cx, cy``, the chunk of each cell; coordinates below zero are floored."""
    return cells.withColumns({"cx": F.floor(F.col("x") / F.lit(width)), "cy": F.floor(F.col("y") / F.lit(height))})


def supported(shape: Column, frame_x: Column, frame_y: Column, conditional: Column, stored: Column, ordinary: Column, most_shape: int = 5) -> Column:
    """Whether a cell can be drawn: its shape is in range, and its type is decided by a family's rules, or has a stored frame and is of the
    stored types, or has none and is ordinary (ropes of the drawable type count as ordinary). A frame is two coordinates of zero
    or more."""
    framed = F.coalesce((frame_x >= 0) & (frame_y >= 0), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(shape.between(0, most_shape)) & (no(conditional) | (framed & no(stored)) | (~framed & no(ordinary)))


def layer_of(cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``layer`` of each kind; null where the kind is unknown. ``dim (kind, layer)`` has one row a kind."""
    return cells.join(dim.select("kind", "layer"), "kind", "left")
