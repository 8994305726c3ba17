"""The registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = tuple(f"scenespark.queries.{m}" for m in ("metrics", "mesh", "scene", "tiling", "anim", "materials", "buffers"))


def _all(name: str) -> dict:
    import importlib

    found: dict = {}
    for m in MODULES:
        for key, value in getattr(importlib.import_module(m), name).items():
            if key in found:
                raise ValueError(f"two entries named {key}")
            found[key] = value
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
