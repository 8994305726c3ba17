"""Triangles from primitives, cleaning, indexing, compaction and tangents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.functions.linalg import cross, dot, minus, norm

KNOWN_MODES = ("TRIANGLES", "TRIANGLE_STRIP", "TRIANGLE_FAN", "POLYGON", "QUADS", "QUAD_STRIP", "POINTS", "LINES")


def _tri(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.alias("i0"), b.alias("i1"), c.alias("i2"))


def _upto(n: Column, step: int) -> Column:
    """0, step, 2 * step .. while n more than it remain; empty if n <= 0."""
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(step).cast("bigint"))).otherwise(none)


def triangulate(primitives: DataFrame) -> DataFrame:
    """prim_id, ti, i0, i1, i2 from (prim_id, mode, n): strips swap every second triangle's last two
    corners, quads give two triangles, fans and polygons share corner 0; points and lines give none."""
    n = F.col("n")
    strip = F.transform(_upto(n - 2, 1), lambda i: F.when(i % 2 == 0, _tri(i, i + 1, i + 2)).otherwise(_tri(i, i + 2, i + 1)))
    fan = F.transform(_upto(n - 2, 1), lambda i: _tri(F.lit(0).cast("bigint"), i + 1, i + 2))
    plain = F.transform(_upto(n - 2, 3), lambda i: _tri(i, i + 1, i + 2))
    quads = F.flatten(F.transform(_upto(n - 3, 4), lambda i: F.array(_tri(i, i + 1, i + 2), _tri(i, i + 2, i + 3))))
    quad_strip = F.flatten(F.transform(_upto(n - 3, 2), lambda i: F.array(_tri(i, i + 1, i + 2), _tri(i + 1, i + 3, i + 2))))
    mode = F.col("mode")
    tris = F.when(mode == "TRIANGLES", plain).when(mode == "TRIANGLE_STRIP", strip).when(mode.isin("TRIANGLE_FAN", "POLYGON"), fan).when(mode == "QUADS", quads).when(mode == "QUAD_STRIP", quad_strip)
    return primitives.select("prim_id", F.posexplode(tris).alias("ti", "t")).select("prim_id", F.col("ti").cast("long").alias("ti"), "t.i0", "t.i1", "t.i2")


def quad_split_02(p0, p1, p2, p3) -> Column:
    """Whether a quad is split along 0-2: along 0-2 the normals of both halves agree at least as well as along 1-3."""

    def agree(a, b, c, d):
        return dot(cross(minus(b, a), minus(c, a)), cross(minus(c, a), minus(d, a)))

    return agree(p0, p1, p2, p3) >= agree(p1, p2, p3, p0)


def fan_of_polygons(polygons: DataFrame) -> DataFrame:
    """polygon, ti, i0, i1, i2 from (polygon, corners array<bigint>)."""
    tris = F.transform(_upto(F.size("corners") - 2, 1), lambda i: _tri(F.col("corners")[0], F.col("corners")[(i + 1).cast("int")], F.col("corners")[(i + 2).cast("int")]))
    return polygons.select("polygon", F.posexplode(tris).alias("ti", "t")).select("polygon", F.col("ti").cast("long").alias("ti"), "t.i0", "t.i1", "t.i2")


EARS = "polygon long, ti long, i0 long, i1 long, i2 long"


def ear_clip(polygons: DataFrame) -> DataFrame:
    """Triangles of simple, possibly concave polygons (polygon, xy array<struct<x,y>>), one polygon at a time."""
    from collections.abc import Iterator

    import pandas as pd

    from scenespark.session import prepare

    prepare(polygons.sparkSession)

    def area(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def clip(pts: list) -> list:
        order = list(range(len(pts)))
        if sum(pts[i - 1][0] * pts[i][1] - pts[i][0] * pts[i - 1][1] for i in order) < 0:
            order.reverse()
        out = []
        while len(order) > 3:
            for k in range(len(order)):
                a, b, c = order[k - 1], order[k], order[(k + 1) % len(order)]
                clear = all(not (area(pts[a], pts[b], pts[p]) >= 0 and area(pts[b], pts[c], pts[p]) >= 0 and area(pts[c], pts[a], pts[p]) >= 0) for p in order if p not in (a, b, c))
                if area(pts[a], pts[b], pts[c]) > 0 and clear:
                    break
            else:
                k, (a, b, c) = 0, (order[-1], order[0], order[1])
            out.append((a, b, c))
            order.pop(k)
        return out + ([tuple(order)] if len(order) == 3 else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, t, *tri) for p, xy in zip(f["polygon"], f["xy"]) for t, tri in enumerate(clip([(q["x"], q["y"]) for q in xy]))]
            yield pd.DataFrame(rows, columns=["polygon", "ti", "i0", "i1", "i2"])

    return polygons.select("polygon", "xy").mapInPandas(run, EARS)


def without_degenerate(triangles: DataFrame) -> DataFrame:
    return triangles.filter("i0 <> i1 AND i1 <> i2 AND i0 <> i2")


def used_vertices(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """The vertices (prim_id, vi) that some triangle uses."""
    used = triangles.select("prim_id", F.explode(F.array("i0", "i1", "i2")).alias("vi")).distinct()
    return vertices.join(used, ["prim_id", "vi"], "left_semi")


def compact_ids(vertices: DataFrame) -> DataFrame:
    """prim_id, vi and new_vi: dense numbers in the old order."""
    order = Window.partitionBy("prim_id").orderBy("vi")
    return vertices.select("prim_id", "vi", (F.row_number().over(order) - 1).cast("long").alias("new_vi"))


def merge_vertices(vertices: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """prim_id, vi and new_vi: equal attributes share a number, in order of first appearance."""
    first = F.min("vi").over(Window.partitionBy("prim_id", *attributes))
    return vertices.withColumn("first_vi", first).select("prim_id", "vi", (F.dense_rank().over(Window.partitionBy("prim_id").orderBy("first_vi")) - 1).cast("long").alias("new_vi"))


def base_vertices(counts: DataFrame, group: tuple[str, ...], order: str, count: str) -> DataFrame:
    """The counts with base: what stands before a row in its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("base", (F.sum(count).over(w) - F.col(count)).cast("long"))


def tangents(corners: DataFrame, normal: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """prim_id, vi, tx, ty, tz, tw: summed triangle directions, made orthogonal to the normal.

    corners: prim_id, i0..i2 with positions x0.. and texture coordinates u0.., v0.. of each corner."""
    at = lambda k: tuple(F.col(f"{a}{k}") for a in ("x", "y", "z"))
    e1, e2 = minus(at(1), at(0)), minus(at(2), at(0))
    x1, x2 = F.col("u1") - F.col("u0"), F.col("u2") - F.col("u0")
    y1, y2 = F.col("v1") - F.col("v0"), F.col("v2") - F.col("v0")
    det = x1 * y2 - x2 * y1
    s = [(y2 * a - y1 * b) / det for a, b in zip(e1, e2)]
    t = [(x1 * b - x2 * a) / det for a, b in zip(e1, e2)]
    per = corners.filter(F.abs(det) >= 1e-6).select("prim_id", F.explode(F.array("i0", "i1", "i2")).alias("vi"), *[x.alias(f"s{k}") for k, x in enumerate(s)], *[x.alias(f"t{k}") for k, x in enumerate(t)])
    sums = per.groupBy("prim_id", "vi").agg(*[F.sum(f"{n}{k}").alias(f"{n}{k}") for n in "st" for k in range(3)])
    n = tuple(map(F.lit, normal))
    sv, tv = tuple(F.col(f"s{k}") for k in range(3)), tuple(F.col(f"t{k}") for k in range(3))
    flat = tuple(a - b * dot(n, sv) for a, b in zip(sv, n))
    size = norm(flat)
    sign = F.when(dot(cross(n, sv), tv) < 0, -1.0).otherwise(1.0)
    return sums.select("prim_id", "vi", *[F.when(size > 0, x / size).otherwise(0.0).alias(f"t{a}") for x, a in zip(flat, "xyz")], sign.alias("tw"))


def layer_lookup(corners: DataFrame, elements: DataFrame) -> DataFrame:
    """corners (mesh, polygon, polygon_vertex, control_point) with the value of a layer element.

    elements: mesh, mapping (CONTROL_POINT, POLYGON_VERTEX or POLYGON), direct array, index array or null."""
    by = F.when(F.col("mapping") == "CONTROL_POINT", F.col("control_point")).when(F.col("mapping") == "POLYGON_VERTEX", F.col("polygon_vertex")).otherwise(F.col("polygon"))
    joined = corners.join(elements, "mesh")
    place = F.when(F.col("index").isNull(), by).otherwise(F.get("index", by.cast("int")))
    return joined.select(*corners.columns, F.get("direct", place.cast("int")).alias("value"))


def skin_influences(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """vi, bone, weight from clusters (mesh, control_point, bone, weight) and points (mesh, control_point, vi)."""
    return clusters.join(points, ["mesh", "control_point"]).select("mesh", "vi", "bone", "weight")


def blend_positions(vertices: DataFrame, targets: DataFrame, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """vertices (mesh, control_point, ...) whose positions a blend shape (mesh, control_point, x, y, z) replaces where it has them."""
    new = targets.select("mesh", "control_point", *[F.col(a).alias(f"to_{a}") for a in cols])
    joined = vertices.join(new, ["mesh", "control_point"], "left")
    return joined.select(*[F.coalesce(f"to_{x}", x).alias(x) if x in cols else F.col(x) for x in vertices.columns])


SIMPLIFIED = "prim_id long, ti long, i0 long, i1 long, i2 long, error double, before long, diagonal double"


#: Rows of vertices and triangles that are simplified at once, if they are of whole primitives.
TOGETHER = 60_000


def clustered(of: np.ndarray, p: np.ndarray, tri_of: np.ndarray, t: np.ndarray, groups: int, ratio: float) -> tuple[np.ndarray, ...]:
    """Vertex clustering of many primitives at once: the triangles' new corners and whether they are left, and by
    primitive the error and the diagonal.

    of, p: primitive (from 0, rising) and place of each vertex; tri_of, t: primitive (rising) and corners of each
    triangle, as places in p. A primitive whose box has no finite extent stays as it is."""
    total = np.bincount(tri_of, minlength=groups)
    some, first = np.unique(of, return_index=True)
    low, span, error = np.zeros((groups, 3)), np.zeros(groups), np.zeros(groups)
    if len(p):
        low[some] = np.minimum.reduceat(p, first)
        span[some] = np.linalg.norm(np.maximum.reduceat(p, first) - low[some], axis=1)
    q, left = t.copy(), np.ones(len(t), bool)
    live, cells = (total > ratio * total) & (span > 0) & np.isfinite(span), 1024
    kept = np.arange(len(p))
    while cells >= 1 and live.any():
        at, tri = np.flatnonzero(live[of]), np.flatnonzero(live[tri_of])
        g, own = of[at], p[at]
        place = np.floor((own - low[g]) / (span[g] / cells)[:, None]).astype(np.int64)
        order, starts = _runs((((g << 11 | place[:, 0]) << 11) | place[:, 1]) << 11 | place[:, 2])
        n = np.diff(np.append(starts, len(at)))
        cell = np.empty(len(at), np.int64)
        cell[order] = np.repeat(np.arange(len(starts)), n)
        mean = np.stack([np.bincount(cell, weights=own[:, k]) / n for k in range(3)], 1)
        far = np.linalg.norm(own - mean[cell], axis=1)[order]
        # of the vertices nearest to the mean the first
        nearest = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, starts), n))
        best = order[nearest[np.unique(np.searchsorted(starts, nearest, "right"), return_index=True)[1]]]
        kept[at] = at[best[cell]]
        moved = np.linalg.norm(own - p[kept[at]], axis=1)
        begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        error[g[begins]] = np.maximum.reduceat(moved, begins) / span[g[begins]]
        c = kept[t[tri]]
        q[tri], left[tri] = c, (c[:, 0] != c[:, 1]) & (c[:, 1] != c[:, 2]) & (c[:, 0] != c[:, 2])
        live &= np.bincount(tri_of[left], minlength=groups) > ratio * total
        cells //= 2
    return q, left, error, span


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the keys, and where in it each key begins."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    return order, np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])


def _simplified(rows: pa.Table, ratio: float) -> pa.RecordBatch:
    """SIMPLIFIED of the vertices (ti null) and triangles of whole primitives, whose rows stand together."""
    prim = rows.column("prim_id").combine_chunks()
    known = prim.fill_null(0).to_numpy(zero_copy_only=False)
    null = prim.is_null().to_numpy(zero_copy_only=False)
    of = np.cumsum(np.r_[False, (known[1:] != known[:-1]) | (null[1:] != null[:-1])])
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    is_tri = rows.column("ti").is_valid().to_numpy()
    number = lambda c, m: rows.column(c).filter(pa.array(m)).to_numpy()
    vi, ti = number("i0", ~is_tri), number("ti", is_tri)
    v, tr = np.lexsort((vi, of[~is_tri])), np.lexsort((ti, of[is_tri]))
    vi, v_of, t_of = vi[v], of[~is_tri][v], of[is_tri][tr]
    p = np.stack([number(a, ~is_tri).astype(float)[v] for a in "xyz"], 1)
    corners = np.stack([number(c, is_tri)[tr] for c in ("i0", "i1", "i2")], 1)
    # a vertex is found by its primitive and the rank of its number
    names = np.unique(vi)
    rank = np.searchsorted(names, corners)
    keys, sought = v_of * len(names) + np.searchsorted(names, vi), t_of[:, None] * len(names) + rank
    t = np.searchsorted(keys, sought)
    if len(t) and not (len(names) and (rank < len(names)).all() and (t < len(keys)).all() and (vi[t] == corners).all() and (v_of[t] == t_of[:, None]).all()):
        raise ValueError("a triangle has a corner that is not among its primitive's vertices")
    q, left, error, span = clustered(v_of, p, t_of, t, len(heads), ratio)
    before, after = np.bincount(t_of, minlength=len(heads)), np.bincount(t_of[left], minlength=len(heads))
    g = np.concatenate([t_of[left], np.flatnonzero(after == 0)])
    order = np.argsort(g, kind="stable")
    g = g[order]
    c = np.concatenate([vi[q[left]], np.full((int((after == 0).sum()), 3), -1)])[order]
    place = np.arange(len(g)) - np.searchsorted(g, np.arange(len(heads)))[g]
    columns = [prim.take(pa.array(heads[g])), np.where(after[g] > 0, place, -1), c[:, 0], c[:, 1], c[:, 2], error[g], before[g], span[g]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns], [f.split()[0] for f in SIMPLIFIED.split(", ")])


def simplified(triangles: DataFrame, vertices: DataFrame, ratio: float) -> DataFrame:
    """The triangles that are left of each primitive (SIMPLIFIED): vertices are clustered on a grid whose cell grows
    until at most ratio of the triangles remain, and a cluster keeps its vertex nearest to its mean.

    error is the longest move of a vertex, per diagonal. A primitive of which nothing is left gives one row with ti -1
    and no corner. Vertex clustering is chosen for the contract (ratio and error bound), not for equal bytes.
    Primitives pass in the order of their ids, many at a time; a primitive's own rows are held together, and
    primitives are bounded by the tiling that comes first."""
    from scenespark.session import prepare

    prepare(triangles.sparkSession)
    long, double = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("double"))
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    v = vertices.select(long("prim_id").alias("prim_id"), none("long", "ti"), long("vi").alias("i0"), none("long", "i1"), none("long", "i2"), *[double(a).alias(a) for a in "xyz"])
    t = triangles.select(long("prim_id").alias("prim_id"), F.coalesce(long("ti"), F.lit(0).cast("long")).alias("ti"), *[long(c).alias(c) for c in ("i0", "i1", "i2")], *[none("double", a) for a in "xyz"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            # the last primitive may go on in the next batch
            if size >= TOGETHER and held[0].column(0)[0] != batch.column(0)[-1]:
                rows = pa.Table.from_batches(held)
                last = pc.equal(batch.column(0), batch.column(0)[-1]).fill_null(False).to_numpy(zero_copy_only=False)
                begins = int(np.argmax(last)) if batch.column(0)[-1].is_valid else 0
                cut = size - batch.num_rows + begins
                if begins == 0:  # the whole batch is one primitive, which may begin before it
                    own = rows.column("prim_id")
                    while cut and own[cut - 1] == batch.column(0)[-1]:
                        cut -= 1
                yield _simplified(rows.slice(0, cut), ratio)
                held, size = rows.slice(cut).to_batches(), size - cut
        if held:
            yield _simplified(pa.Table.from_batches(held), ratio)

    return v.unionByName(t).repartition("prim_id").sortWithinPartitions("prim_id").mapInArrow(run, SIMPLIFIED)


def simplify(triangles: DataFrame, vertices: DataFrame, ratio: float) -> DataFrame:
    """prim_id, triangles before and after, and the error per diagonal of ``simplified``."""
    rows = simplified(triangles, vertices, ratio)
    return rows.groupBy("prim_id").agg(F.max("before").alias("before"), F.count_if(F.col("ti") >= 0).alias("after"), F.max("error").alias("error"))


def lod_errors(rows: DataFrame) -> DataFrame:
    """prim_id, lod_error: the error of a simplified primitive as a length, its share times the diagonal."""
    return rows.groupBy("prim_id").agg((F.max("error") * F.max("diagonal")).alias("lod_error"))
