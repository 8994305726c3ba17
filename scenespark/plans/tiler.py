"""The tiler: from objects to a tileset, as one plan of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark.operators import lod, spatial
from scenespark.session import cut


@dataclass(frozen=True)
class Options:
    """Limits of a tileset. Values outside their range are moved into it."""

    kind: str = "quadtree"
    levels: int = 8
    max_triangles: int = 200_000
    max_draw_calls: int = 20
    ratio: float = 0.5

    def clamped(self) -> Options:
        if self.kind not in ("quadtree", "octree"):
            raise ValueError(f"unknown tree {self.kind!r}")
        return Options(self.kind, max(0, min(32, self.levels)), max(1, self.max_triangles), max(5, self.max_draw_calls), min(1.0, max(0.01, self.ratio)))


def build(objects: DataFrame, content: tuple[str, ...], options: Options = Options()) -> dict[str, DataFrame]:
    """members (tile_id, id), tiles (with error, box and URI) of single objects, and instances.

    objects: id, cx.., radius, triangles, key and the content columns. Contents placed more than once
    become instances; the others are divided by the tree."""
    o = options.clamped()
    groups = cut(spatial.instances(objects, content))
    single = spatial.placements(objects, groups, content, "left_anti")
    placed = cut(spatial.tree(single, o.kind, o.levels, o.max_triangles, o.max_draw_calls))
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in ("level", "x", "y", "z")])
    members = placed.withColumn("tile_id", name).join(objects, "id")
    box = [f(F.col(f"c{a}") + s * F.col("radius")).alias(f"{n}_{a}") for a in "xyz" for n, f, s in (("min", F.min, -1), ("max", F.max, 1))]
    tiles = members.groupBy("tile_id", "level", "x", "y", "z").agg(F.count("*").alias("members"), F.sum("triangles").alias("triangles"), F.sum(2 * F.col("radius")).alias("volume"), F.max(2 * F.col("radius")).alias("diagonal"), *box)
    error = lod.error_of_pixels(lod.pixels_of_level(F.col("level")), F.col("diagonal") * lod.DIAGONAL_FACTOR)
    tiles = tiles.select("*", error.alias("geometric_error"), lod.box12().alias("box"), lod.uri(F.lit("b3dm"), F.col("level"), F.col("x"), F.col("y"), F.col("z"), F.lit(0)).alias("uri"))
    return {"members": members.select("tile_id", "id"), "tiles": tiles, "instances": groups}


def tileset(tiles: DataFrame) -> DataFrame:
    """One row, root: the error and box of everything, and how many tiles there are."""
    whole = tiles.agg(F.count("*").alias("tiles"), F.max("geometric_error").alias("child"), F.max("diagonal").alias("diagonal"), *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    radius = F.sqrt(sum(((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in "yz"), (F.col("max_x") - F.col("min_x")) ** 2)) / 2
    return whole.select("tiles", lod.tileset_error(radius, F.col("child") + lod.LEAST_GAP).alias("geometric_error"), lod.box12().alias("box"))
