"""Readers by file extension; aliases lead to the reader of their family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenespark.sources.containers import parse_tiles, read_binary

ALIASES = {"glb": "gltf", "b3dm": "b3dm", "i3dm": "b3dm", "ktx2": "ktx", "jpeg": "jpg"}
#: Families without a public reader here: refused with a message instead of guessed at.
REFUSED = ("gltf", "fbx", "ktx", "webp")


def family(name: str) -> str:
    ext = name.rsplit(".", 1)[-1].lower()
    return ALIASES.get(ext, ext)


def read(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Tiles by container, tables by parquet or JSON."""
    from pyspark.sql import functions as F

    kind = family(extension)
    if kind in REFUSED:
        raise ValueError(f"reading {extension} files is not supported")
    if kind == "b3dm":
        files = read_binary(spark, path, extension)
        return parse_tiles(files.select(F.xxhash64("path").alias("tile_id"), "content"))
    if kind in ("parquet", "json", "csv", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for {extension}")
