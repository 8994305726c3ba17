"""Triangle counts, draw calls, bounding volumes, areas and other aggregates of meshes.

Vertices are rows (prim_id, vi, x, y, z, u, v). All aggregates combine map-side and shuffle once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenespark.functions.linalg import cross, dot, minus, norm

AXES = ("x", "y", "z")


def triangles_of(mode: Column, n: Column) -> Column:
    """Triangles of n vertices drawn in a mode; points and lines have none."""
    third, quarter = F.floor(n / 3), F.floor(n / 4)
    return (
        F.when(mode == "TRIANGLES", third)
        .when(mode.isin("TRIANGLE_STRIP", "TRIANGLE_FAN", "POLYGON"), F.greatest(n - 2, F.lit(0)))
        .when(mode == "QUADS", 2 * quarter)
        .when(mode == "QUAD_STRIP", n)
        .otherwise(0)
        .cast("long")
    )


def triangle_counts(primitives: DataFrame, keys: tuple[str, ...] = ("prim_id",), indexed: str | None = None) -> DataFrame:
    """keys, triangles of primitives (mode, n). With ``indexed`` (a boolean column), indexed ones count n / 3."""
    t = triangles_of(F.col("mode"), F.col("n"))
    if indexed:
        t = F.when(F.col(indexed), F.floor(F.col("n") / 3)).otherwise(t)
    return primitives.groupBy(*keys).agg(F.sum(t).cast("long").alias("triangles"))


def draw_calls(drawables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, draw_calls of drawables (matrix_key, state_key, repeats): different combinations are draw calls."""
    return drawables.groupBy(*keys).agg(F.count_distinct("matrix_key", "state_key", "repeats").alias("draw_calls"))


def boxes(vertices: DataFrame, keys: tuple[str, ...] = ("prim_id",)) -> DataFrame:
    """keys and the bounding box: min_x .. max_z."""
    return vertices.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def extent(axis: str) -> Column:
    return F.col(f"max_{axis}") - F.col(f"min_{axis}")


def diagonal() -> Column:
    return F.sqrt(sum((extent(a) * extent(a) for a in AXES[1:]), extent("x") * extent("x")))


def volume() -> Column:
    """Of a box; 0 where an extent is not positive."""
    flat = (extent("x") <= 0) | (extent("y") <= 0) | (extent("z") <= 0)
    return F.when(flat, 0.0).otherwise(extent("x") * extent("y") * extent("z"))


def largest_box(box: DataFrame, group: str, ident: str) -> DataFrame:
    """group, the id of its box with the longest diagonal (smallest id on ties) and the diagonal."""
    best = F.max(F.struct(diagonal().alias("d"), (-F.col(ident)).alias("neg")))
    return box.groupBy(group).agg(best.alias("best")).select(group, (-F.col("best.neg")).alias(ident), F.col("best.d").alias("diagonal"))


def weighted_diagonal(box: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, the mean diagonal weighted by volume (0 without volume) and the total volume."""
    v = extent("x") * extent("y") * extent("z")
    sums = box.groupBy(*keys).agg(F.sum(diagonal() * v).alias("dv"), F.sum(v).alias("volume"))
    return sums.select(*keys, F.when(F.col("volume") > 0, F.col("dv") / F.col("volume")).otherwise(0.0).alias("diagonal"), "volume")


def max_level(box: DataFrame) -> DataFrame:
    """min_extent over objects and axes (zero extents skipped), max_extent of all, and floor(log2(max / min))."""
    small = F.least(*[F.nullif(extent(a), F.lit(0.0)) for a in AXES])
    whole = box.agg(F.min(small).alias("min_extent"), *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    most = F.greatest(*[extent(a) for a in AXES])
    return whole.select("min_extent", most.alias("max_extent"), F.floor(F.log2(most / F.col("min_extent"))).cast("long").alias("max_level"))


def corner(n: int, cols: tuple[str, ...] = AXES) -> tuple[Column, ...]:
    return tuple(F.col(f"{a}{n}") for a in cols)


def with_corners(triangles: DataFrame, vertices: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """triangles (prim_id, ti, i0, i1, i2) with the columns of their corners, as x0, x1, x2 ...

    One array of a primitive's vertices meets its triangles, so the vertices cross the network once."""
    packed = vertices.groupBy("prim_id").agg(F.array_sort(F.collect_list(F.struct("vi", *cols))).alias("vs"))
    joined = triangles.join(packed, "prim_id")
    return joined.select(*triangles.columns, *[F.element_at("vs", (F.col(f"i{k}") + 1).cast("int"))[a].alias(f"{a}{k}") for k in range(3) for a in cols])


def surface_areas(corners: DataFrame) -> DataFrame:
    """prim_id, area in space and area in texture space."""
    a, b = minus(corner(1), corner(0)), minus(corner(2), corner(0))
    uv1, uv2 = minus(corner(1, ("u", "v")), corner(0, ("u", "v"))), minus(corner(2, ("u", "v")), corner(0, ("u", "v")))
    flat = F.abs(uv1[0] * uv2[1] - uv1[1] * uv2[0]) * 0.5
    return corners.groupBy("prim_id").agg(F.sum(norm(cross(a, b)) * 0.5).alias("area"), F.sum(flat).alias("uv_area"))


def covariance(vertices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The six entries of the population covariance of positions."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return vertices.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def oriented_box(vertices: DataFrame) -> DataFrame:
    """Oriented bounding boxes: principal axes of each primitive's vertices, extents along them (longest
    first) and the centre. Eigenvectors need numpy; the covariance itself is an aggregate of Spark's,
    and extents are minima and maxima of dot products, so no group is collected anywhere."""
    from scenespark.session import prepare

    prepare(vertices.sparkSession)
    cov = covariance(vertices, ("prim_id",))

    @F.pandas_udf("array<double>")
    def axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3)
        _, vec = np.linalg.eigh(m)
        return pd.Series(list(vec[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9)))

    named = cov.select("prim_id", axes("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("axes"))
    both = vertices.join(named, "prim_id")
    along = [dot([F.col(a) for a in AXES], [F.col("axes")[3 * k + j] for j in range(3)]) for k in range(3)]
    span = both.groupBy("prim_id").agg(F.first("axes").alias("axes"), *[f(along[k]).alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    mid = [(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2 for k in range(3)]
    centre = [sum((mid[k] * F.col("axes")[3 * k + j] for k in range(1, 3)), mid[0] * F.col("axes")[j]) for j in range(3)]
    return span.select("prim_id", *[(F.col(f"hi{k}") - F.col(f"lo{k}")).alias(f"extent_{k}") for k in range(3)], *[x.alias(n) for x, n in zip(centre, ("cx", "cy", "cz"))], "axes")


def box_corners(obb: DataFrame) -> DataFrame:
    """The 8 corners of oriented boxes: prim_id, corner, x, y, z."""
    rows = obb.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner"))
    sign = [F.when(F.shiftright("corner", k) % 2 == 1, 0.5).otherwise(-0.5) for k in range(3)]
    at = [sum((sign[k] * F.col(f"extent_{k}") * F.col("axes")[3 * k + j] for k in range(3)), F.col(n)) for j, n in enumerate(("cx", "cy", "cz"))]
    return rows.select("prim_id", "corner", *[x.alias(a) for x, a in zip(at, AXES)])


def skipping_nan(vertices: DataFrame, keys: tuple[str, ...], cols: tuple[str, ...]) -> DataFrame:
    """keys, count, and minimum and maximum of the columns without NaN."""
    real = [F.when(~F.isnan(a), F.col(a)) for a in cols]
    return vertices.groupBy(*keys).agg(F.count("*").alias("count"), *[f(x).alias(f"{n}_{a}") for a, x in zip(cols, real) for n, f in (("min", F.min), ("max", F.max))])
