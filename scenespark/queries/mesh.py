"""Queries on triangles, indices, cleaning, skinning and tangents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.operators import mesh as m
from scenespark.queries import Registry
from scenespark.queries.metrics import _MODE_SQL, CORNER_SQL, corners, with_mode

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

INDEX_SQL = "SELECT prim_id, ti, max(CASE WHEN corner = 0 THEN idx END) AS i0, max(CASE WHEN corner = 1 THEN idx END) AS i1, max(CASE WHEN corner = 2 THEN idx END) AS i2 FROM sc_indices GROUP BY prim_id, ti"


def indexed(indices):
    """Triangles (prim_id, ti, i0, i1, i2) of the indices; corner is a row's place in its triangle."""
    return indices.groupBy("prim_id", "ti").agg(*[F.max(F.when(F.col("corner") == k, F.col("idx"))).alias(f"i{k}") for k in range(3)])


_G = "SELECT unnest(range(0, greatest(n, 0))) AS i, prim_id, n, mode FROM p"
_TRIANGULATE_SQL = f""", p AS (SELECT prim_id, n, {_MODE_SQL} AS mode FROM sc_counts), g AS ({_G}),
t AS (
 SELECT prim_id, i // 3 AS ti, i AS i0, i + 1 AS i1, i + 2 AS i2 FROM g WHERE mode = 'TRIANGLES' AND i % 3 = 0 AND i + 2 < n
 UNION ALL SELECT prim_id, i, i, i + 1 + i % 2, i + 2 - i % 2 FROM g WHERE mode = 'TRIANGLE_STRIP' AND i + 2 < n
 UNION ALL SELECT prim_id, i, 0, i + 1, i + 2 FROM g WHERE mode = 'TRIANGLE_FAN' AND i + 2 < n
 UNION ALL SELECT prim_id, i // 2, i, i + 1, i + 2 FROM g WHERE mode = 'QUADS' AND i % 4 = 0 AND i + 3 < n
 UNION ALL SELECT prim_id, i // 2 + 1, i, i + 2, i + 3 FROM g WHERE mode = 'QUADS' AND i % 4 = 0 AND i + 3 < n
 UNION ALL SELECT prim_id, i, i, i + 1, i + 2 FROM g WHERE mode = 'QUAD_STRIP' AND i % 2 = 0 AND i + 3 < n
 UNION ALL SELECT prim_id, i + 1, i + 1, i + 3, i + 2 FROM g WHERE mode = 'QUAD_STRIP' AND i % 2 = 0 AND i + 3 < n)
SELECT prim_id, ti::BIGINT AS ti, i0::BIGINT AS i0, i1::BIGINT AS i1, i2::BIGINT AS i2 FROM t"""
R.add("p9_triangulate", "sc_counts", lambda c: m.triangulate(with_mode(c)), _TRIANGULATE_SQL)
R.add("s3_mesh_triangles", "sc_counts sc_geodes", lambda c, g: m.triangulate(with_mode(c)).join(g, F.col("prim_id") == F.col("geode_id")).groupBy("material_id").agg(F.count("*").alias("triangles"), F.sum(F.col("i0") + F.col("i1") + F.col("i2")).alias("index_sum")), _TRIANGULATE_SQL.replace("SELECT prim_id, ti::BIGINT AS ti, i0::BIGINT AS i0, i1::BIGINT AS i1, i2::BIGINT AS i2 FROM t", "SELECT material_id, count(*) AS triangles, sum(i0 + i1 + i2)::BIGINT AS index_sum FROM t JOIN sc_geodes ON prim_id = geode_id GROUP BY material_id"))
R.add("p22_triangles_only", "sc_counts", lambda c: with_mode(c).filter("mode = 'TRIANGLES'").select("prim_id", "n"), "SELECT prim_id, n FROM sc_counts WHERE prim_id % 6 = 0")
R.add("p28_unsupported_modes", "sc_counts", lambda c: with_mode(c).filter(F.col("mode").isin("QUADS", "QUAD_STRIP", "PATCHES")).groupBy("mode").count(), f", p AS (SELECT {_MODE_SQL} AS mode FROM sc_counts) SELECT mode, count(*) AS count FROM p WHERE mode LIKE 'QUAD%' GROUP BY mode")
R.add("w12_strip_winding", "sc_counts", lambda c: m.triangulate(c.withColumn("mode", F.lit("TRIANGLE_STRIP"))), ", g AS (SELECT prim_id, n, unnest(range(0, n)) AS i FROM sc_counts) SELECT prim_id, i::BIGINT AS ti, i::BIGINT AS i0, (i + 1 + i % 2)::BIGINT AS i1, (i + 2 - i % 2)::BIGINT AS i2 FROM g WHERE i + 2 < n")

_POINTS = "x y z".split()


def _quads(v):
    four = v.groupBy("prim_id", F.expr("vi div 4").alias("quad")).agg(F.count("*").alias("k"), *[F.max(F.when(F.col("vi") % 4 == k, F.col(a))).alias(f"{a}{k}") for k in range(4) for a in _POINTS]).filter("k = 4")
    pts = [tuple(F.col(f"{a}{k}") for a in _POINTS) for k in range(4)]
    return four.select("prim_id", "quad", m.quad_split_02(*pts).alias("split_02"))


def _normal_sql(a, b, c):
    e = lambda p, q, ax: f"({ax}{q} - {ax}{p})"
    return [f"({e(a, b, p)} * {e(a, c, q)} - {e(a, b, q)} * {e(a, c, p)})" for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]


def _agree_sql(a, b, c, d):
    return " + ".join(f"{p} * {q}" for p, q in zip(_normal_sql(a, b, c), _normal_sql(a, c, d)))


R.add(
    "p10_quad_split",
    "sc_vertices",
    _quads,
    ", f AS (SELECT prim_id, vi // 4 AS quad, " + ", ".join(f"max(CASE WHEN vi % 4 = {k} THEN {a} END) AS {a}{k}" for k in range(4) for a in _POINTS) + f" FROM sc_vertices GROUP BY 1, 2 HAVING count(*) = 4) SELECT prim_id, quad, ({_agree_sql(0, 1, 2, 3)}) >= ({_agree_sql(1, 2, 3, 0)}) AS split_02 FROM f",
)
R.add(
    "p11_polygon_fan",
    "sc_vertices",
    lambda v: m.fan_of_polygons(v.groupBy(F.col("prim_id").alias("polygon")).agg(F.array_sort(F.collect_list("vi")).alias("corners"))),
    ", n AS (SELECT prim_id, count(*) AS n FROM sc_vertices GROUP BY prim_id) SELECT prim_id AS polygon, vi AS ti, 0::BIGINT AS i0, vi + 1 AS i1, vi + 2 AS i2 FROM sc_vertices JOIN n USING (prim_id) WHERE vi + 2 < n",
)
R.add("p11_ear_clipping", "sc_vertices", lambda v: m.ear_clip(v.groupBy(F.col("prim_id").alias("polygon")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vi", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("xy"))))
R.add("p12_degenerate", "sc_indices", lambda i: m.without_degenerate(indexed(i)), f", t AS ({INDEX_SQL}) SELECT * FROM t WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2")
R.add("j11_used_vertices", "sc_vertices sc_indices", lambda v, i: m.used_vertices(v, m.without_degenerate(indexed(i))).groupBy("prim_id").agg(F.count("*").alias("used"), F.sum("vi").alias("vi_sum")), f", t AS ({INDEX_SQL}), k AS (SELECT * FROM t WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2), u AS (SELECT prim_id, i0 AS vi FROM k UNION SELECT prim_id, i1 FROM k UNION SELECT prim_id, i2 FROM k) SELECT prim_id, count(*) AS used, sum(vi)::BIGINT AS vi_sum FROM u GROUP BY prim_id")
R.add("j12_unused_vertices", "sc_vertices sc_indices", lambda v, i: v.join(i.select("prim_id", F.col("idx").alias("vi")), ["prim_id", "vi"], "left_anti").select("prim_id", "vi"), "SELECT prim_id, vi FROM sc_vertices v WHERE NOT EXISTS (SELECT 1 FROM sc_indices i WHERE i.prim_id = v.prim_id AND i.idx = v.vi)")
R.add("w9_compact_ids", "sc_vertices sc_indices", lambda v, i: m.compact_ids(m.used_vertices(v, m.without_degenerate(indexed(i)))), f", t AS ({INDEX_SQL}), k AS (SELECT * FROM t WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2), u AS (SELECT prim_id, i0 AS vi FROM k UNION SELECT prim_id, i1 FROM k UNION SELECT prim_id, i2 FROM k) SELECT prim_id, vi, row_number() OVER (PARTITION BY prim_id ORDER BY vi) - 1 AS new_vi FROM u")
R.add("a26_vertex_dedup", "sc_vertices", lambda v: m.merge_vertices(v.withColumns({"x": F.floor(F.col("x") / 10), "y": F.floor(F.col("y") / 30)}), ("x", "y")), ", f AS (SELECT prim_id, vi, min(vi) OVER (PARTITION BY prim_id, floor(x / 10), floor(y / 30)) AS f FROM sc_vertices) SELECT prim_id, vi, dense_rank() OVER (PARTITION BY prim_id ORDER BY f) - 1 AS new_vi FROM f")
R.add("k7_export_vertices", "sc_vertices", lambda v: m.merge_vertices(v.withColumn("z", F.col("z") % 3), ("z",)).groupBy("prim_id").agg(F.count_distinct("new_vi").alias("written"), F.count("*").alias("read")), "SELECT prim_id, count(DISTINCT z % 3) AS written, count(*) AS read FROM sc_vertices GROUP BY prim_id")
R.add("p29_length_mismatch", "sc_counts sc_indices", lambda c, i: c.join(i.groupBy("prim_id").agg(F.count_distinct("idx").alias("used")), "prim_id", "left").filter("n = coalesce(used, 0)").select("prim_id", "n"), "SELECT c.prim_id, n FROM sc_counts c JOIN (SELECT prim_id, count(DISTINCT idx) AS used FROM sc_indices GROUP BY prim_id) i ON i.prim_id = c.prim_id WHERE n = used")
R.add("w4_base_vertex", "sc_counts sc_geodes", lambda c, g: m.base_vertices(c.join(g, F.col("prim_id") == F.col("geode_id")).select("material_id", "prim_id", "n"), ("material_id",), "prim_id", "n"), "SELECT material_id, prim_id, n, (sum(n) OVER (PARTITION BY material_id ORDER BY prim_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS base FROM sc_counts JOIN sc_geodes ON prim_id = geode_id")
R.add(
    "a27_tangents",
    "sc_triangles sc_vertices",
    lambda t, v: m.tangents(corners(t, v)).select("prim_id", "vi", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("tx", "ty", "tz")], "tw"),
    f""", k AS ({CORNER_SQL}), e AS (SELECT prim_id, i0, i1, i2, x1 - x0 AS ax, y1 - y0 AS ay, x2 - x0 AS bx, y2 - y0 AS by_, (u1 - u0) * (v2 - v0) - (u2 - u0) * (v1 - v0) AS det, v2 - v0 AS q2, v1 - v0 AS q1, u1 - u0 AS p1, u2 - u0 AS p2 FROM k),
    d AS (SELECT prim_id, unnest([i0, i1, i2]) AS vi, (q2 * ax - q1 * bx) / det AS sx, (q2 * ay - q1 * by_) / det AS sy, (p1 * bx - p2 * ax) / det AS tx, (p1 * by_ - p2 * ay) / det AS ty FROM e WHERE abs(det) >= 1e-6),
    s AS (SELECT prim_id, vi, sum(sx) AS sx, sum(sy) AS sy, sum(tx) AS tx, sum(ty) AS ty FROM d GROUP BY prim_id, vi)
    SELECT prim_id, vi, round(CASE WHEN sx * sx + sy * sy > 0 THEN sx / sqrt(sx * sx + sy * sy) ELSE 0 END + 1e-9, 5) AS tx, round(CASE WHEN sx * sx + sy * sy > 0 THEN sy / sqrt(sx * sx + sy * sy) ELSE 0 END + 1e-9, 5) AS ty, 0::DOUBLE AS tz, CASE WHEN sx * ty - sy * tx < 0 THEN -1 ELSE 1 END::DOUBLE AS tw FROM s""",
)


def _layers(v, g):
    pts = v.select(F.col("prim_id").alias("mesh"), (F.floor(F.col("vi") / 3)).cast("long").alias("polygon"), F.col("vi").alias("polygon_vertex"), (F.col("vi") * 5 % 7).alias("control_point"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: i * 11 % 60)
    el = g.select(
        F.col("geode_id").alias("mesh"),
        F.when(F.col("mode_no") < 2, "CONTROL_POINT").when(F.col("mode_no") < 4, "POLYGON_VERTEX").otherwise("POLYGON").alias("mapping"),
        F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: i * 3 + F.col("mode_no")).alias("direct"),
        F.when(F.col("mode_no") % 2 == 1, ids).alias("index"),
    )
    return m.layer_lookup(pts, el)


R.add(
    "j7_layer_lookup",
    "sc_vertices sc_geodes",
    _layers,
    ", r AS (SELECT prim_id AS mesh, vi // 3 AS polygon, vi AS polygon_vertex, vi * 5 % 7 AS control_point, mode_no FROM sc_vertices JOIN sc_geodes ON prim_id = geode_id), k AS (SELECT *, CASE WHEN mode_no < 2 THEN control_point WHEN mode_no < 4 THEN polygon_vertex ELSE polygon END AS b FROM r), p AS (SELECT *, CASE WHEN mode_no % 2 = 1 THEN b * 11 % 60 ELSE b END AS place FROM k) SELECT mesh, polygon::BIGINT AS polygon, polygon_vertex, control_point, (place * 3 + mode_no)::INT AS value FROM p",
)
_skin = lambda v: (v.select(F.col("prim_id").alias("mesh"), (F.col("vi") % 9).alias("control_point"), F.col("vi")), v.select(F.col("prim_id").alias("mesh"), (F.col("vi") % 9).alias("control_point"), (F.col("s") % 10).alias("bone"), F.col("w").alias("weight")))
_SKIN_SQL = "SELECT a.prim_id AS mesh, a.vi, b.s % 10 AS bone, b.w AS weight FROM sc_vertices a JOIN sc_vertices b ON a.prim_id = b.prim_id AND a.vi % 9 = b.vi % 9"
R.add("j8_skin_weights", "sc_vertices", lambda v: m.skin_influences(*_skin(v)[::-1]), _SKIN_SQL)
R.add("a36_bone_influences", "sc_vertices", lambda v: m.skin_influences(*_skin(v)[::-1]).groupBy("mesh", "bone").agg(F.array_join(F.array_sort(F.collect_list("vi")), ",").alias("vertices"), F.round(F.sum("weight"), 6).alias("weight")), f", k AS ({_SKIN_SQL}) SELECT mesh, bone, string_agg(vi::VARCHAR, ',' ORDER BY vi) AS vertices, round(sum(weight), 6) AS weight FROM k GROUP BY mesh, bone")
R.add(
    "j9_blend_shape",
    "sc_vertices",
    lambda v: m.blend_positions(v.select(F.col("prim_id").alias("mesh"), F.col("vi").alias("control_point"), "x", "y", "z"), v.filter("vi % 4 = 1").select(F.col("prim_id").alias("mesh"), F.col("vi").alias("control_point"), (F.col("x") * 2).alias("x"), "y", F.lit(0.0).alias("z"))),
    "SELECT prim_id AS mesh, vi AS control_point, CASE WHEN vi % 4 = 1 THEN x * 2 ELSE x END AS x, y, CASE WHEN vi % 4 = 1 THEN 0 ELSE z END::DOUBLE AS z FROM sc_vertices",
)
R.add("a37_polygons_by_material", "sc_vertices", lambda v: v.groupBy(F.col("prim_id").alias("mesh"), (F.col("s") % 3).alias("material")).agg(F.count_distinct(F.floor(F.col("vi") / 3)).alias("polygons")), "SELECT prim_id AS mesh, s % 3 AS material, count(DISTINCT vi // 3) AS polygons FROM sc_vertices GROUP BY prim_id, s % 3")
R.add("t9_simplify", "sc_triangles sc_vertices", lambda t, v: m.simplified(t, v, 0.5).drop("diagonal", "before"))
R.add("t9_counts", "sc_triangles sc_vertices", lambda t, v: m.simplify(t, v, 0.5).filter("after > 0.5 * before").select("prim_id"), "SELECT prim_id FROM sc_triangles WHERE false")
R.add("a30_lod_error", "sc_triangles sc_vertices sc_geodes", lambda t, v, g: m.lod_errors(m.simplified(t, v, 0.5)).join(g, F.col("prim_id") == F.col("geode_id")).groupBy("node_id").agg(F.max("lod_error").alias("lod_error")))
R.add("p27_narrow_texcoords", "sc_vertices", lambda v: v.select("prim_id", "vi", F.slice(F.array("u", "v", "z"), 1, 2).alias("uvw")).select("prim_id", "vi", F.col("uvw")[0].alias("u"), F.col("uvw")[1].alias("v")), "SELECT prim_id, vi, u, v FROM sc_vertices")
