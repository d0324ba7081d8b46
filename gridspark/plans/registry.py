"""All registered grid queries and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from gridspark.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def at(value: str, axis: str, step: int) -> str:
    """SQL of ``value`` at the cell ``step`` further along an axis of a grid; null where there is none."""
    other, far, way = "y" if axis == "x" else "x", abs(step), "FOLLOWING" if step > 0 else "PRECEDING"
    return f"max({value}) OVER (PARTITION BY {other} ORDER BY {axis} RANGE BETWEEN {far} {way} AND {far} {way})"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name; ``sql`` may use the views."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def load() -> None:
    for name in ("scans", "neighbours", "counts", "ordered", "values", "composite", "layered", "verify", "streams", "stores"):
        importlib.import_module(f"gridspark.plans.{name}")
