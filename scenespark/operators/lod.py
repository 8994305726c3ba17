"""Levels of detail and geometric errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The view that errors refer to: fixed values.
ASPECT, HEIGHT, MAX_ERROR, FIRST_PIXELS = 2, 936, 16.0, 25.0
FOVY = 2 * math.atan(math.tan(math.pi / 6) / ASPECT)
DENOMINATOR = 2 * math.tan(FOVY / 2)
PER_PIXEL = FOVY / HEIGHT
DIAGONAL_FACTOR, LEAST_GAP = 0.7, 0.1


def error_at(distance: Column) -> Column:
    return DENOMINATOR * MAX_ERROR * distance / HEIGHT


def error_of_pixels(pixels: Column, radius: Column) -> Column:
    return error_at(radius / F.tan(pixels * (PER_PIXEL / 2)))


def error_of_lod(lod_error: Column, radius: Column) -> Column:
    return error_at(lod_error / (math.tan(FOVY / 2) * 2 / HEIGHT) + radius)


def pixels_of_level(level: Column) -> Column:
    """Pixel size that children of a structural tile are meant for."""
    return F.when(level < 0, FIRST_PIXELS).otherwise(F.least(F.greatest(FIRST_PIXELS * F.pow(F.lit(2.0), level), F.lit(FIRST_PIXELS)), F.lit(250.0)))


def parameters(tiles: DataFrame, ratio: float = 0.5) -> DataFrame:
    """tile_id, lod, sample ratio, target error, texture factor: three levels per tile (tile_id, diagonal)."""
    rows = tiles.select("tile_id", "diagonal", F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("lod"))
    d = F.col("diagonal")
    pick = lambda a, b, c: F.when(F.col("lod") == 2, a).when(F.col("lod") == 1, b).otherwise(c)
    return rows.select(
        "tile_id",
        "lod",
        pick(F.lit(0.5 * ratio), F.lit(ratio), F.lit(1.0)).alias("sample_ratio"),
        pick(F.least(5.0 / d, F.lit(0.3)), F.least(0.6 / d, F.lit(0.075)), 0.01 / d).alias("target_error"),
        pick(F.lit(0.25), F.lit(0.5), F.lit(1.0)).alias("texture_factor"),
    )


def without_redundant(lods: DataFrame) -> DataFrame:
    """Levels (tile_id, lod, lod_error) without those whose error equals the next finer one's."""
    finer = F.lead("lod_error").over(Window.partitionBy("tile_id").orderBy(F.desc("lod")))
    return lods.withColumn("_f", finer).filter("_f IS NULL OR _f <> lod_error").drop("_f")


def tile_error(children: DataFrame) -> DataFrame:
    """parent_id and its error: children's errors weighted by volume (error, volume), raised above the
    largest error (own) of a child."""
    sums = children.groupBy("parent_id").agg(F.sum(F.col("error") * F.col("volume")).alias("ev"), F.sum("volume").alias("v"), F.max("own").alias("top"))
    mean = F.when(F.col("v") > 0, F.col("ev") / F.col("v")).otherwise(0.0)
    return sums.select("parent_id", F.when(F.col("top") >= mean, F.col("top") + LEAST_GAP).otherwise(mean).alias("geometric_error"))


def tileset_error(radius: Column, root_error: Column) -> Column:
    return F.greatest(error_of_pixels(F.lit(FIRST_PIXELS), radius), 1.5 * root_error)


def roll_up(tiles: DataFrame, most: int = 64) -> DataFrame:
    """tile_id, geometric_error of a hierarchy (tile_id, parent_id, level, diagonal, volume), leaves first.

    One aggregation per level, from the deepest one; leaves have error 0."""
    levels = sorted((r[0] for r in tiles.select("level").distinct().collect()), reverse=True)
    if len(levels) > most:
        raise ValueError(f"more than {most} levels")
    radius = F.col("diagonal") * DIAGONAL_FACTOR
    known = None
    for level in levels:
        here = tiles.filter(F.col("level") == level)
        if known is None:
            found = here.select("tile_id", F.lit(0.0).alias("geometric_error"))
        else:
            child = tiles.join(known, "tile_id").select("parent_id", error_of_pixels(pixels_of_level(F.lit(level)), radius).alias("error"), "volume", F.col("geometric_error").alias("own"))
            found = _errors(here, child)
        known = found if known is None else known.unionByName(found)
    return known


def _errors(here: DataFrame, child: DataFrame) -> DataFrame:
    found = tile_error(child).withColumnRenamed("parent_id", "tile_id")
    return here.select("tile_id").join(found, "tile_id", "left").select("tile_id", F.coalesce("geometric_error", F.lit(0.0)).alias("geometric_error"))


def box12(prefix: str = "") -> Column:
    """A box in the exported axes: centre and half axes; the second half axis keeps its sign."""
    c = {a: (F.col(f"{prefix}min_{a}") + F.col(f"{prefix}max_{a}")) / 2 for a in "xyz"}
    d = {a: (F.col(f"{prefix}max_{a}") - F.col(f"{prefix}min_{a}")) / 2 for a in "xyz"}
    zero = F.lit(0.0)
    return F.array(c["x"], -c["z"], c["y"], d["x"], zero, zero, zero, -d["z"], zero, zero, zero, d["y"])


def sphere4(prefix: str = "") -> Column:
    c = [(F.col(f"{prefix}min_{a}") + F.col(f"{prefix}max_{a}")) / 2 for a in "xyz"]
    d = [F.col(f"{prefix}max_{a}") - F.col(f"{prefix}min_{a}") for a in "xyz"]
    return F.array(c[0], -c[2], c[1], F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2)


def uri(kind: Column, level: Column, x: Column, y: Column, z: Column, lod: Column) -> Column:
    """The relative path of a tile's content; null for structural tiles (lod -1)."""
    s = lambda c: c.cast("string")
    tile = F.concat(F.lit("Tile_L"), s(lod), F.lit("_"))
    plain = F.concat(s(level), F.lit("/"), tile, F.concat_ws("_", s(x), s(y), s(z)), F.lit("."), kind)
    return F.when(lod != -1, F.when(kind == "i3dm", F.concat(F.lit("InstanceTiles/"), tile, s(z), F.lit("."), kind)).otherwise(plain))
