"""Queries on counts, boxes, areas and covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.operators import metrics as m
from scenespark.queries import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

MODES = ("TRIANGLES", "TRIANGLE_STRIP", "TRIANGLE_FAN", "QUADS", "QUAD_STRIP", "POINTS")
_MODE_SQL = "CASE CAST(prim_id % 6 AS INT) " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(MODES)) + " END"
_COUNT_SQL = "CASE mode WHEN 'TRIANGLES' THEN n // 3 WHEN 'TRIANGLE_STRIP' THEN greatest(n - 2, 0) WHEN 'TRIANGLE_FAN' THEN greatest(n - 2, 0) WHEN 'QUADS' THEN 2 * (n // 4) WHEN 'QUAD_STRIP' THEN n ELSE 0 END"
BOX_SQL = "SELECT prim_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM sc_vertices GROUP BY prim_id"
_D = "sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2)"
_V = "(max_x - min_x) * (max_y - min_y) * (max_z - min_z)"


def with_mode(counts):
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("prim_id") % 6 + 1).cast("int"))
    return counts.withColumn("mode", mode)


R.add("a1_triangle_count", "sc_counts", lambda c: m.triangle_counts(with_mode(c), ("mode",)), f", p AS (SELECT n, {_MODE_SQL} AS mode FROM sc_counts) SELECT mode, sum({_COUNT_SQL})::BIGINT AS triangles FROM p GROUP BY mode")
R.add(
    "a1_triangle_count_indexed",
    "sc_counts",
    lambda c: m.triangle_counts(with_mode(c).withColumn("indexed", F.col("prim_id") % 2 == 0), ("mode",), "indexed"),
    f", p AS (SELECT prim_id, n, {_MODE_SQL} AS mode FROM sc_counts) SELECT mode, sum(CASE WHEN prim_id % 2 = 0 THEN n // 3 ELSE {_COUNT_SQL} END)::BIGINT AS triangles FROM p GROUP BY mode",
)


def _drawables(vertices, geodes):
    repeats = vertices.groupBy("prim_id").agg(F.bool_or((F.abs("u") > 1) | (F.abs("v") > 1)).alias("repeats"))
    return repeats.join(geodes, F.col("prim_id") == F.col("geode_id")).select("class", F.col("node_id").alias("matrix_key"), F.col("material_id").alias("state_key"), "repeats")


R.add(
    "a2_drawcalls",
    "sc_vertices sc_geodes",
    lambda v, g: m.draw_calls(_drawables(v, g), ("class",)),
    ", r AS (SELECT prim_id, bool_or(abs(u) > 1 OR abs(v) > 1) AS rep FROM sc_vertices GROUP BY prim_id), d AS (SELECT DISTINCT class, node_id, material_id, rep FROM r JOIN sc_geodes ON prim_id = geode_id) SELECT class, count(*) AS draw_calls FROM d GROUP BY class",
)
R.add("a3_distinct_states", "sc_geodes", lambda g: g.groupBy("node_id").agg(F.count_distinct("material_id").alias("states")), "SELECT node_id, count(DISTINCT material_id) AS states FROM sc_geodes GROUP BY node_id")
R.add("a4_geode_aabb", "sc_vertices", m.boxes, BOX_SQL)
R.add(
    "a5_largest_geometry",
    "sc_vertices sc_geodes",
    lambda v, g: m.largest_box(m.boxes(v).join(g, F.col("prim_id") == F.col("geode_id")), "class", "prim_id").withColumn("diagonal", F.round("diagonal", 6)),
    f", b AS ({BOX_SQL}), r AS (SELECT class, prim_id, {_D} AS d FROM b JOIN sc_geodes ON prim_id = geode_id) SELECT class, prim_id, round(d, 6) AS diagonal FROM r QUALIFY row_number() OVER (PARTITION BY class ORDER BY d DESC, prim_id) = 1",
)
R.add(
    "a6_weighted_diagonal",
    "sc_vertices sc_geodes sc_triangles",
    lambda v, g, t: (
        m.weighted_diagonal(m.boxes(v).join(g, F.col("prim_id") == F.col("geode_id")), ("material_id",))
        .join(t.groupBy("prim_id").count().join(g, F.col("prim_id") == F.col("geode_id")).groupBy("material_id").agg(F.sum("count").alias("triangles")), "material_id", "left")
        .select("material_id", F.round("diagonal", 6).alias("diagonal"), F.round(F.col("volume") + 1e-6, 4).alias("volume"), F.coalesce("triangles", F.lit(0)).alias("triangles"))
    ),
    f", b AS ({BOX_SQL}), r AS (SELECT material_id, {_D} AS d, {_V} AS vol, coalesce(n, 0) AS n FROM b JOIN sc_geodes ON b.prim_id = geode_id LEFT JOIN (SELECT prim_id, count(*) AS n FROM sc_triangles GROUP BY prim_id) t ON t.prim_id = b.prim_id) SELECT material_id, round(CASE WHEN sum(vol) > 0 THEN sum(d * vol) / sum(vol) ELSE 0 END, 6) AS diagonal, round(sum(vol) + 1e-6, 4) AS volume, sum(n)::BIGINT AS triangles FROM r GROUP BY material_id",
)
R.add("a10_box_volume", "sc_vertices", lambda v: m.boxes(v).select("prim_id", F.round(m.volume(), 6).alias("volume")), f", b AS ({BOX_SQL}) SELECT prim_id, round(CASE WHEN max_x > min_x AND max_y > min_y AND max_z > min_z THEN {_V} ELSE 0 END, 6) AS volume FROM b")
R.add(
    "a11_max_level",
    "sc_vertices",
    lambda v: m.max_level(m.boxes(v)),
    f", b AS ({BOX_SQL}), w AS (SELECT min(least(nullif(max_x - min_x, 0), nullif(max_y - min_y, 0), nullif(max_z - min_z, 0))) AS lo, greatest(max(max_x) - min(min_x), max(max_y) - min(min_y), max(max_z) - min(min_z)) AS hi FROM b) SELECT lo AS min_extent, hi AS max_extent, floor(log2(hi / lo))::BIGINT AS max_level FROM w",
)
CORNER_SQL = "SELECT t.prim_id, t.ti, i0, i1, i2, a.x AS x0, a.y AS y0, a.z AS z0, a.u AS u0, a.v AS v0, b.x AS x1, b.y AS y1, b.z AS z1, b.u AS u1, b.v AS v1, c.x AS x2, c.y AS y2, c.z AS z2, c.u AS u2, c.v AS v2 FROM sc_triangles t JOIN sc_vertices a ON a.prim_id = t.prim_id AND a.vi = i0 JOIN sc_vertices b ON b.prim_id = t.prim_id AND b.vi = i1 JOIN sc_vertices c ON c.prim_id = t.prim_id AND c.vi = i2"
_AREA_SQL = f", k AS ({CORNER_SQL}), e AS (SELECT prim_id, x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x0 AS bx, y2 - y0 AS by_, z2 - z0 AS bz, abs((u1 - u0) * (v2 - v0) - (v1 - v0) * (u2 - u0)) / 2 AS uv FROM k), s AS (SELECT prim_id, sum(sqrt((ay * bz - az * by_) ** 2 + (az * bx - ax * bz) ** 2 + (ax * by_ - ay * bx) ** 2) / 2) AS area, sum(uv) AS uv_area FROM e GROUP BY prim_id)"


def corners(triangles, vertices):
    return m.with_corners(triangles, vertices, ("x", "y", "z", "u", "v"))


R.add("a12_areas", "sc_triangles sc_vertices", lambda t, v: m.surface_areas(corners(t, v)).select("prim_id", F.round("area", 4).alias("area"), F.round("uv_area", 4).alias("uv_area")), _AREA_SQL + " SELECT prim_id, round(area, 4) AS area, round(uv_area, 4) AS uv_area FROM s")
R.add(
    "a12_texel_density",
    "sc_triangles sc_vertices",
    lambda t, v: m.surface_areas(corners(t, v)).filter("uv_area * area > 0").select("prim_id", (F.lit(1024.0) / (F.col("uv_area") * F.col("area"))).alias("d")).agg(F.round(F.min("d"), 6).alias("density")),
    _AREA_SQL + " SELECT round(min(1024 / (uv_area * area)), 6) AS density FROM s WHERE uv_area * area > 0",
)
R.add(
    "a13_covariance",
    "sc_vertices",
    lambda v: m.covariance(v, ("prim_id",)).select("prim_id", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")]),
    "SELECT prim_id, round(covar_pop(x, x) + 1e-7, 4) AS cxx, round(covar_pop(x, y) + 1e-7, 4) AS cxy, round(covar_pop(x, z) + 1e-7, 4) AS cxz, round(covar_pop(y, y) + 1e-7, 4) AS cyy, round(covar_pop(y, z) + 1e-7, 4) AS cyz, round(covar_pop(z, z) + 1e-7, 4) AS czz FROM sc_vertices GROUP BY prim_id",
)
R.add("a14_obb", "sc_vertices", lambda v: m.oriented_box(v).select("prim_id", *[F.round(f"extent_{k}", 6).alias(f"extent_{k}") for k in range(3)]))
R.add("a15_obb_corners", "sc_vertices", lambda v: m.box_corners(m.oriented_box(v)))
R.add(
    "a16_accessor_bounds",
    "sc_vertices",
    lambda v: m.skipping_nan(v.withColumn("x", F.when(F.col("vi") % 5 == 0, float("nan")).otherwise(F.col("x"))), ("prim_id",), ("x", "u")),
    "SELECT prim_id, count(*) AS count, min(x) FILTER (WHERE vi % 5 <> 0) AS min_x, max(x) FILTER (WHERE vi % 5 <> 0) AS max_x, min(u) AS min_u, max(u) AS max_u FROM sc_vertices GROUP BY prim_id",
)
R.add(
    "a18_position_bounds",
    "sc_vertices",
    lambda v: m.boxes(v, ()).withColumn("scale", F.greatest(*[m.extent(a) for a in m.AXES])),
    "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS scale FROM sc_vertices",
)
R.add(
    "a19_uv_bounds_by_material",
    "sc_vertices sc_geodes",
    lambda v, g: v.join(g, F.col("prim_id") == F.col("geode_id")).groupBy("material_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("min", F.min), ("max", F.max))]),
    "SELECT material_id, min(u) AS min_u, max(u) AS max_u, min(v) AS min_v, max(v) AS max_v FROM sc_vertices JOIN sc_geodes ON prim_id = geode_id GROUP BY material_id",
)
R.add(
    "a33_scene_statistics",
    "sc_counts sc_geodes",
    lambda c, g: g.join(c, F.col("prim_id") == F.col("geode_id"), "left").agg(F.count("*").alias("geodes"), F.sum("n").alias("vertices"), F.count_distinct("material_id").alias("materials"), F.count_distinct("node_id").alias("transforms")),
    "SELECT count(*) AS geodes, sum(n)::BIGINT AS vertices, count(DISTINCT material_id) AS materials, count(DISTINCT node_id) AS transforms FROM sc_geodes LEFT JOIN sc_counts ON prim_id = geode_id",
)
R.add("p13_uv_out_of_range", "sc_vertices", lambda v: v.groupBy("prim_id").agg(F.bool_or((F.abs("u") > 1) | (F.abs("v") > 1)).alias("repeats")), "SELECT prim_id, max(CASE WHEN abs(u) > 1 OR abs(v) > 1 THEN 1 ELSE 0 END) = 1 AS repeats FROM sc_vertices GROUP BY prim_id")
R.add("p14_uv_outside_unit", "sc_vertices", lambda v: v.groupBy("prim_id").agg(F.bool_or((F.col("u") < 0) | (F.col("u") > 1) | (F.col("v") < 0) | (F.col("v") > 1)).alias("outside")), "SELECT prim_id, count(*) FILTER (WHERE NOT (u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)) > 0 AS outside FROM sc_vertices GROUP BY prim_id")
R.add("p16_empty_meshes", "sc_triangles sc_geodes", lambda t, g: g.join(t.groupBy("prim_id").count(), F.col("prim_id") == F.col("geode_id"), "left").groupBy("node_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("triangles")).filter("triangles > 0"), "SELECT node_id, count(*) AS triangles FROM sc_triangles JOIN sc_geodes ON prim_id = geode_id GROUP BY node_id")
