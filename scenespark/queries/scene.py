"""Queries on hierarchies and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.functions import linalg as la
from scenespark.operators import model as md
from scenespark.operators import scene as sc
from scenespark.operators import transforms as tr
from scenespark.queries import Registry
from scenespark.queries import buffers as bf

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_WALK = ", walk AS (SELECT node_id, parent_id, kind, name, 0 AS depth, {root} FROM sc_nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, n.kind, n.name, w.depth + 1, {step} FROM sc_nodes n JOIN walk w ON n.parent_id = w.node_id)"
_COS, _SIN = "CASE {0}.q % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", "CASE {0}.q % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END"
# world matrices of similarity transforms about Z: a = s cos, b = s sin, k = s along z, and the translation
_WORLD = (
    ", l AS (SELECT *, s * ("
    + _COS.format("sc_nodes")
    + ") AS a, s * ("
    + _SIN.format("sc_nodes")
    + ") AS b FROM sc_nodes), walk AS (SELECT node_id, 0 AS depth, a::DOUBLE AS a, b::DOUBLE AS b, s AS k, tx, ty, tz FROM l WHERE parent_id IS NULL UNION ALL SELECT l.node_id, w.depth + 1, l.a * w.a - l.b * w.b, l.a * w.b + l.b * w.a, l.s * w.k, l.tx * w.a - l.ty * w.b + w.tx, l.tx * w.b + l.ty * w.a + w.ty, l.tz * w.k + w.tz FROM l JOIN walk w ON l.parent_id = w.node_id)"
)
_ENTRIES = {"m0": "a", "m1": "b", "m4": "-b", "m5": "a", "m10": "k", "m12": "tx", "m13": "ty", "m14": "tz"}


def _world(n):
    return sc.world_matrices(n, sc.local_matrix())


R.add("p1_world_matrix", "sc_nodes", lambda n: _world(n).select("node_id", "depth", *[(F.col("world")[int(k[1:])] + 0.0).alias(k) for k in _ENTRIES]), _WORLD + " SELECT node_id, depth, " + ", ".join(f"{v} + 0.0 AS {k}" for k, v in _ENTRIES.items()) + " FROM walk")
R.add(
    "p2_flatten",
    "sc_nodes sc_geodes sc_vertices",
    lambda n, g, v: sc.bake(v.join(g.select(F.col("geode_id").alias("prim_id"), "node_id"), "prim_id"), _world(n)).select("prim_id", "vi", *[F.round(F.col(a) + 1e-9, 6).alias(a) for a in "xyz"]),
    _WORLD + " SELECT prim_id, vi, round(v.x * a - v.y * b + tx + 1e-9, 6) AS x, round(v.x * b + v.y * a + ty + 1e-9, 6) AS y, round(v.z * k + tz + 1e-9, 6) AS z FROM sc_vertices v JOIN sc_geodes g ON prim_id = geode_id JOIN walk w ON w.node_id = g.node_id",
)
R.add("s2_node_scan", "sc_nodes", lambda n: sc.paths(n).select("node_id", "depth", "kind", "path"), _WALK.format(root="name AS path", step="w.path || '/' || n.name") + " SELECT node_id, depth, kind, path FROM walk")
R.add("a31_max_level", "sc_nodes", lambda n: sc.subtree_max(n.withColumn("level", F.col("node_id") % 50), "level"), ", walk AS (SELECT node_id, node_id AS up FROM sc_nodes UNION ALL SELECT w.node_id, n.parent_id FROM walk w JOIN sc_nodes n ON n.node_id = w.up WHERE n.parent_id IS NOT NULL) SELECT up AS node_id, max(node_id % 50) AS max_level FROM walk GROUP BY up")
R.add("a35_descendants", "sc_nodes", lambda n: sc.ancestors(n).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("below")), ", walk AS (SELECT node_id, node_id AS up FROM sc_nodes UNION ALL SELECT w.node_id, n.parent_id FROM walk w JOIN sc_nodes n ON n.node_id = w.up WHERE n.parent_id IS NOT NULL) SELECT up AS node_id, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS below FROM walk GROUP BY up")
R.add("j19_ancestor", "sc_nodes", lambda n: sc.nearest_ancestor(n, F.col("kind") != "skeleton"), _WALK.format(root="NULL::BIGINT AS found", step="CASE WHEN w.kind <> 'skeleton' THEN w.node_id ELSE w.found END") + " SELECT node_id, found AS ancestor_id FROM walk")
R.add("p15_prune", "sc_nodes sc_geodes", lambda n, g: sc.live_nodes(n, g).select("node_id", "kind"), ", walk AS (SELECT DISTINCT n.node_id FROM sc_nodes n JOIN sc_geodes g ON g.node_id = n.node_id UNION SELECT n.parent_id FROM walk w JOIN sc_nodes n ON n.node_id = w.node_id WHERE n.parent_id IS NOT NULL) SELECT node_id, kind FROM sc_nodes WHERE node_id IN (SELECT node_id FROM walk)")
R.add("p18_valid_tree", "sc_nodes", lambda n: sc.valid_tree(n.select(F.col("node_id").alias("tile_id"), "parent_id", F.when(F.col("node_id") >= 1000, 0.0).otherwise(F.col("node_id") % 9).alias("geometric_error"))), ", t AS (SELECT node_id, parent_id, CASE WHEN node_id >= 1000 THEN 0 ELSE node_id % 9 END AS e FROM sc_nodes) SELECT node_id AS tile_id, CASE WHEN NOT EXISTS (SELECT 1 FROM t c WHERE c.parent_id = t.node_id) THEN e = 0 ELSE NOT EXISTS (SELECT 1 FROM t c WHERE c.parent_id = t.node_id AND c.e >= t.e) END AS valid FROM t")
R.add("w1_batch_ids", "sc_nodes sc_geodes", lambda n, g: sc.batch_ids(g, sc.paths(n)).select("geode_id", "batch_id"), _WALK.format(root="lpad(node_id::VARCHAR, 12, '0') AS k", step="w.k || '/' || lpad(n.node_id::VARCHAR, 12, '0')") + " SELECT geode_id, row_number() OVER (ORDER BY k, geode_id) - 1 AS batch_id FROM sc_geodes g JOIN walk w ON w.node_id = g.node_id")
R.add("w2_parent_batch", "sc_nodes sc_geodes", lambda n, g: sc.batch_ids(g, sc.paths(n)).select("geode_id", "parent_batch_id"), _WALK.format(root="lpad(node_id::VARCHAR, 12, '0') AS k", step="w.k || '/' || lpad(n.node_id::VARCHAR, 12, '0')") + ", b AS (SELECT geode_id, g.node_id, row_number() OVER (ORDER BY k, geode_id) - 1 AS batch_id FROM sc_geodes g JOIN walk w ON w.node_id = g.node_id) SELECT geode_id, greatest(min(batch_id) OVER (PARTITION BY node_id) - 1, 0) AS parent_batch_id FROM b")
_KEY = "round(a, 9), round(b, 9), round(k, 9), round(tx, 9), round(ty, 9), round(tz, 9)"


def _placed(g, n):
    """Geodes with their world matrix; negative zeros become zeros, so that equal matrices are equal arrays."""
    world = _world(n).select("node_id", F.transform("world", lambda x: F.round(x, 9) + 0.0).alias("matrix"))
    return g.join(world, "node_id")


R.add("u3_group_by_matrix", "sc_geodes sc_nodes", lambda g, n: md.same_matrix(_placed(g, n).select("geode_id", "matrix"), "geode_id"), _WORLD + f" SELECT geode_id, min(geode_id) OVER w AS first_id, count(*) OVER w AS n FROM sc_geodes g JOIN walk USING (node_id) WINDOW w AS (PARTITION BY {_KEY})")
R.add("a22_merge_transforms", "sc_geodes sc_nodes", lambda g, n: _placed(g, n).groupBy("matrix").agg(F.count("*").alias("geodes"), F.count_distinct("node_id").alias("nodes"), F.min("geode_id").alias("first_id")).drop("matrix"), _WORLD + f" SELECT count(*) AS geodes, count(DISTINCT node_id) AS nodes, min(geode_id) AS first_id FROM sc_geodes JOIN walk USING (node_id) GROUP BY {_KEY}")
R.add("f31_matrix_key", "sc_nodes", lambda n: md.same_matrix(n.select("node_id", sc.local_matrix().alias("m")).select("node_id", F.transform("m", lambda x: F.round(x, 9) + 0.0).alias("matrix")), "node_id"), "SELECT node_id, min(node_id) OVER w AS first_id, count(*) OVER w AS n FROM sc_nodes WINDOW w AS (PARTITION BY tx, ty, tz, s, q % 4)")
R.add("p5_rotation", "sc_nodes", lambda n: n.select("node_id", tr.rotation_of(sc.local_matrix()).alias("r")).select("node_id", *[(F.round(F.col("r")[k], 6) + 0.0).alias(c) for k, c in enumerate("xyzw")]), "SELECT node_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, round(CASE q % 4 WHEN 0 THEN 0 WHEN 1 THEN sqrt(0.5) WHEN 2 THEN 1 ELSE -sqrt(0.5) END, 6)::DOUBLE AS z, round(CASE q % 4 WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE sqrt(0.5) END, 6)::DOUBLE AS w FROM sc_nodes")
_ATTR = "CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END"


def _grouped(g, n, c):
    prims = _placed(g, n).select(F.col("geode_id").alias("prim_id"), "matrix", "material_id")
    return md.merge_groups(bf.prim_accessors(c, g), prims)


_GROUPS = _WORLD + f", a AS (SELECT geode_id AS prim_id, material_id, size, {_ATTR} AS textured, n.n, {_KEY.replace('round(a, 9)', 'round(a, 9) AS ka').replace('round(b, 9)', 'round(b, 9) AS kb').replace('round(k, 9)', 'round(k, 9) AS kk').replace('round(tx, 9)', 'round(tx, 9) AS kx').replace('round(ty, 9)', 'round(ty, 9) AS ky').replace('round(tz, 9)', 'round(tz, 9) AS kz')} FROM sc_geodes JOIN walk USING (node_id) JOIN sc_counts n ON n.prim_id = geode_id), m AS (SELECT *, min(prim_id) OVER (PARTITION BY material_id, textured, ka, kb, kk, kx, ky, kz) AS group_id FROM a)"
R.add("a21_merge_groups", "sc_geodes sc_nodes sc_vertices sc_counts", lambda g, n, v, c: _grouped(g, n, v), _GROUPS + " SELECT prim_id, group_id, CASE textured WHEN 1 THEN 'POSITION,TEXCOORD_0,_BATCHID,indices' ELSE 'POSITION,_BATCHID,indices' END AS attributes FROM m")


def rounded(c, digits=6):
    """round as the oracle's engine does, on the product with 10^digits in binary: F.round goes by the shortest decimals
    of the number, so halves such as 0.5096415 (a little less in the product) go another way."""
    return F.round(c * 10.0**digits) / 10.0**digits


def _half(found, g):
    """Accessors of which those of every third size are quantised: then a group's members may differ."""
    short = g.select(F.col("geode_id").alias("prim_id"), (F.col("size") % 3 == 0).alias("short"))
    return found.join(short, "prim_id").withColumn("component", F.when(F.col("short") & (F.col("attribute") == "POSITION"), 5123).otherwise(F.col("component"))).drop("short")


_OK = _GROUPS + ", k AS (SELECT group_id, count(DISTINCT size % 3 = 0) = 1 AS compatible FROM m GROUP BY 1)"
R.add("p20_merge_compatible", "sc_geodes sc_nodes sc_vertices sc_counts", lambda g, n, v, c: md.compatible(_half(bf.prim_accessors(v, g), g), _grouped(g, n, v)), _OK + " SELECT * FROM k")
_MERGED = _OK + ", z AS (SELECT m.*, CASE WHEN compatible THEN m.group_id ELSE prim_id END AS gid FROM m JOIN k ON k.group_id = m.group_id)"
R.add("k14_merge_meshes", "sc_geodes sc_nodes sc_vertices sc_counts", lambda g, n, v, c: md.merged(_half(bf.prim_accessors(v, g), g), _grouped(g, n, v))[0].select("group_id", "attribute", "count", "component", *[rounded(F.get("min", F.lit(k))).alias(f"min{k}") for k in range(3)]), _MERGED + ", b AS (SELECT prim_id, min(x) AS x, min(y) AS y, min(z) AS z, min(u) AS u, min(v) AS v FROM sc_vertices GROUP BY 1), q AS (SELECT gid, sum(n)::BIGINT AS count, bool_or(size % 3 = 0) AS short, max(textured) AS textured, min(x) AS x, min(y) AS y, min(z) AS z, min(u) AS u, min(v) AS v FROM z JOIN b USING (prim_id) GROUP BY 1) SELECT gid AS group_id, 'POSITION' AS attribute, count, CASE WHEN short THEN 5123 ELSE 5126 END AS component, round(x, 6) AS min0, round(y, 6) AS min1, round(z, 6) AS min2 FROM q UNION ALL SELECT gid, 'TEXCOORD_0', count, 5126, round(u, 6), round(v, 6), NULL FROM q WHERE textured = 1 UNION ALL SELECT gid, '_BATCHID', count, 5126, NULL, NULL, NULL FROM q UNION ALL SELECT gid, 'indices', count, CASE WHEN count <= 255 THEN 5121 WHEN count <= 65535 THEN 5123 ELSE 5125 END, NULL, NULL, NULL FROM q")
R.add("k14_base_vertices", "sc_geodes sc_nodes sc_vertices sc_counts", lambda g, n, v, c: md.merged(_half(bf.prim_accessors(v, g), g), _grouped(g, n, v))[1], _MERGED + " SELECT gid AS group_id, prim_id, n AS count, (sum(n) OVER (PARTITION BY gid ORDER BY prim_id) - n)::BIGINT AS base FROM z")


def _tilted(n):
    """Nodes with angles that exercise every rotation order."""
    deg = [F.col("tx") * 15, F.col("ty") * 20, F.col("tz") * 40]
    order = F.element_at(F.array(*map(F.lit, tr.ORDERS)), (F.col("node_id") % 6 + 1).cast("int"))
    return n, deg, order


def _matmul_sql(a, b):
    return "list_transform(range(0, 16), lambda k: " + " + ".join(f"{a}[4 * (k // 4) + {i + 1}] * {b}[{4 * i} + k % 4 + 1]" for i in range(4)) + ")"


_ROTS = "[1.0, 0, 0, 0, 0, cos(rx), sin(rx), 0, 0, -sin(rx), cos(rx), 0, 0, 0, 0, 1] AS mx, [cos(ry), 0, -sin(ry), 0, 0, 1.0, 0, 0, sin(ry), 0, cos(ry), 0, 0, 0, 0, 1] AS my, [cos(rz), sin(rz), 0, 0, -sin(rz), cos(rz), 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1] AS mz"
_ORDERED = ", r AS (SELECT *, radians(tx * 15) AS rx, radians(ty * 20) AS ry, radians(tz * 40) AS rz FROM sc_nodes), m AS (SELECT *, " + _ROTS + " FROM r), o AS (SELECT *, CASE node_id % 6 " + " ".join(f"WHEN {k} THEN m{o[0].lower()}" for k, o in enumerate(tr.ORDERS)) + " END AS f1, CASE node_id % 6 " + " ".join(f"WHEN {k} THEN m{o[1].lower()}" for k, o in enumerate(tr.ORDERS)) + " END AS f2, CASE node_id % 6 " + " ".join(f"WHEN {k} THEN m{o[2].lower()}" for k, o in enumerate(tr.ORDERS)) + " END AS f3 FROM m), h AS (SELECT *, " + _matmul_sql("f1", "f2") + " AS f12 FROM o), w AS (SELECT *, " + _matmul_sql("f12", "f3") + " AS rot FROM h)"
_NINE = ("m0", "m1", "m2", "m4", "m5", "m6", "m8", "m9", "m10")
# the oracle multiplies rotation matrices where the operator multiplies quaternions
R.add(
    "p4_euler_quat",
    "sc_nodes",
    lambda n: n.select("node_id", la.rotation(tr.euler_quaternion(*_tilted(n)[1:])).alias("m")).select("node_id", *[F.round(F.col("m")[int(k[1:])] + 1e-9, 6).alias(k) for k in _NINE]),
    _ORDERED + " SELECT node_id, " + ", ".join(f"round(rot[{int(k[1:]) + 1}] + 1e-9, 6) AS {k}" for k in _NINE) + " FROM w",
)
R.add(
    "p5_compose",
    "sc_nodes",
    lambda n: n.select("node_id", tr.compose((F.col("tx"), F.col("ty"), F.col("tz")), tr.euler_quaternion(_tilted(n)[1], _tilted(n)[2]), (F.col("s"), F.col("s") * 2, F.col("s") * 3)).alias("m")).select("node_id", *[F.round(F.col("m")[k] + 1e-9, 6).alias(f"m{k}") for k in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14)]),
    _ORDERED + " SELECT node_id, " + ", ".join(f"round(rot[{k + 1}] * s * {k // 4 + 1} + 1e-9, 6) AS m{k}" for k in (0, 1, 2, 4, 5, 6, 8, 9, 10)) + ", round(tx + 1e-9, 6) AS m12, round(ty + 1e-9, 6) AS m13, round(tz + 1e-9, 6) AS m14 FROM w",
)
R.add("p5_decompose", "sc_nodes", lambda n: n.select("node_id", sc.local_matrix().alias("m")).select("node_id", *[x.alias(a) for x, a in zip((*tr.decompose(F.col("m"))[0], *tr.decompose(F.col("m"))[1]), ("tx", "ty", "tz", "sx", "sy", "sz"))]), "SELECT node_id, tx, ty, tz, s AS sx, s AS sy, s AS sz FROM sc_nodes")


def _fbx(n):
    n, deg, order = _tilted(n)
    x, y, z = F.col("tx"), F.col("ty"), F.col("tz")
    one = lambda k: [F.lit(float(k)), F.lit(0.0), F.lit(-float(k))]
    m = tr.fbx_local([x, y, z], one(1), [y, z, x], [z * 10, x * 5, y], deg, [x, y * 5, z * 20], one(2), [z, x, y], [F.col("s"), F.lit(1.0), F.lit(2.0)], order, F.col("node_id") % 2 == 0)
    return n.select("node_id", m.alias("m")).select("node_id", *[F.round(F.col("m")[k] + 1e-9, 6).alias(f"m{k}") for k in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14)])


def _rot_sql(name, ax, ay, az):
    """A matrix for turns about X, then Y, then Z, by angles in degrees."""
    a, b, c = (f"radians({v})" for v in (ax, ay, az))
    return f"[cos({b})*cos({c}), cos({b})*sin({c}), -sin({b}), 0, sin({a})*sin({b})*cos({c})-cos({a})*sin({c}), sin({a})*sin({b})*sin({c})+cos({a})*cos({c}), sin({a})*cos({b}), 0, cos({a})*sin({b})*cos({c})+sin({a})*sin({c}), cos({a})*sin({b})*sin({c})-sin({a})*cos({c}), cos({a})*cos({b}), 0, 0, 0, 0, 1] AS {name}"


def _move_sql(name, x, y, z):
    return f"[1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, {x}, {y}, {z}, 1] AS {name}"


R.add(
    "p3_local_matrix",
    "sc_nodes",
    _fbx,
    _ORDERED
    + ", f AS (SELECT *, "
    + ", ".join([_rot_sql("pre", "tz * 10", "tx * 5", "ty"), _rot_sql("post", "tx", "ty * 5", "tz * 20"), _rot_sql("plain", "tx * 15", "ty * 20", "tz * 40"), _move_sql("t1", "tx + 1 + ty", "ty + tz", "tz - 1 + tx"), _move_sql("t2", "2 + tz - ty", "tx - tz", "-2 + ty - tx"), _move_sql("t3", "-tz", "-tx", "-ty"), "[s, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1] AS sm"])
    + " FROM w), g AS (SELECT *, "
    + _matmul_sql("post", "rot")
    + " AS pr FROM f), g2 AS (SELECT *, CASE WHEN node_id % 2 = 0 THEN "
    + _matmul_sql("pr", "pre")
    + " ELSE plain END AS turn FROM g), g3 AS (SELECT *, "
    + _matmul_sql("turn", "t1")
    + " AS a1 FROM g2), g4 AS (SELECT *, "
    + _matmul_sql("t2", "a1")
    + " AS a2 FROM g3), g5 AS (SELECT *, "
    + _matmul_sql("sm", "a2")
    + " AS a3 FROM g4), g6 AS (SELECT *, "
    + _matmul_sql("t3", "a3")
    + " AS m FROM g5) SELECT node_id, "
    + ", ".join(f"round(m[{k + 1}] + 1e-9, 6) AS m{k}" for k in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14))
    + " FROM g6",
)
_AXES = ("X", "-X", "-Y", "Z", "-Z", "Y")
R.add(
    "p6_axis",
    "sc_geodes",
    lambda g: g.select("geode_id", *[(x + 0.0).alias(a) for x, a in zip(tr.to_y_up(F.element_at(F.array(*map(F.lit, _AXES)), (F.col("geode_id") % 6 + 1).cast("int")), (F.col("cx"), F.col("cy"), F.col("cz"))), "xyz")]),
    "SELECT geode_id, CASE geode_id % 6 WHEN 0 THEN -cy WHEN 1 THEN cy ELSE cx END + 0.0 AS x, CASE geode_id % 6 WHEN 0 THEN cx WHEN 1 THEN -cx WHEN 2 THEN -cy WHEN 3 THEN cz WHEN 4 THEN -cz ELSE cy END + 0.0 AS y, CASE geode_id % 6 WHEN 0 THEN cz WHEN 1 THEN cz WHEN 2 THEN -cz WHEN 3 THEN -cy WHEN 4 THEN cy ELSE cz END + 0.0 AS z FROM sc_geodes",
)
def _lla():
    return F.col("cx") * 3 - 80, F.col("cy") - 50, F.col("cz") * 100



_ECEF_SQL = ", r AS (SELECT geode_id, radians(cx * 3 - 80) AS lo, radians(cy - 50) AS la, cz * 100 AS alt FROM sc_geodes), e AS (SELECT *, 6378137.0 / sqrt(1 - (2 - 1 / 298.257223563) / 298.257223563 * sin(la) * sin(la)) AS n FROM r)"
R.add("p7_ecef", "sc_geodes", lambda g: g.select("geode_id", *[F.round(x, 3).alias(a) for x, a in zip(tr.ecef(*_lla()), "xyz")]), _ECEF_SQL + " SELECT geode_id, round((n + alt) * cos(la) * cos(lo), 3) AS x, round((n + alt) * cos(la) * sin(lo), 3) AS y, round((n * (1 - (2 - 1 / 298.257223563) / 298.257223563) + alt) * sin(la), 3) AS z FROM e")
R.add("p7_geodetic_round_trip", "sc_geodes", lambda g: g.select("geode_id", *[(F.round(x, 6) + 0.0).alias(a) for x, a in zip(tr.geodetic(tr.ecef(*_lla())), ("lng", "lat"))]), "SELECT geode_id, cx * 3 - 80 + 0.0 AS lng, cy - 50 + 0.0 AS lat FROM sc_geodes")
R.add("p8_ecef_frame", "sc_geodes", lambda g: g.select("geode_id", tr.ecef_frame(*_lla()).alias("m")).select("geode_id", *[F.round(F.col("m")[k] + 1e-9, 6).alias(f"m{k}") for k in (0, 1, 4, 5, 6, 8, 9, 10)]), _ECEF_SQL + " SELECT geode_id, round(-sin(lo) + 1e-9, 6) AS m0, round(cos(lo) + 1e-9, 6) AS m1, round(-sin(la) * cos(lo) + 1e-9, 6) AS m4, round(-sin(la) * sin(lo) + 1e-9, 6) AS m5, round(cos(la) + 1e-9, 6) AS m6, round(cos(la) * cos(lo) + 1e-9, 6) AS m8, round(cos(la) * sin(lo) + 1e-9, 6) AS m9, round(sin(la) + 1e-9, 6) AS m10 FROM e")
