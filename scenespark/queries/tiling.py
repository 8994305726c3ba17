"""Queries on spatial partitioning, levels of detail and geometric errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.operators import lod
from scenespark.operators import metrics as m
from scenespark.operators import spatial as sp
from scenespark.operators.order import numbered
from scenespark.plans import tiler
from scenespark.queries import Registry
from scenespark.queries.metrics import BOX_SQL

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def objects(g):
    """Objects of the tree builders: boxes of half size radius about the geodes' centres."""
    box = [(F.col(f"c{a}") + s * F.col("radius")).alias(f"{n}_{a}") for a in "xyz" for n, s in (("min", -1), ("max", 1))]
    return g.select(F.col("geode_id").alias("id"), "node_id", "class", "size", "brand", "cx", "cy", "cz", "radius", (F.col("size") * 100).cast("long").alias("triangles"), F.concat_ws("|", F.col("node_id").cast("string"), F.col("material_id").cast("string")).alias("key"), *box)


OBJ_SQL = ", o AS (SELECT geode_id AS id, node_id, class, size, brand, cx, cy, cz, radius, size * 100 AS triangles, node_id || '|' || material_id AS key, cx - radius AS min_x, cx + radius AS max_x, cy - radius AS min_y, cy + radius AS max_y, cz - radius AS min_z, cz + radius AS max_z FROM sc_geodes)"
_cell = lambda c, lo, hi, n: f"least(greatest(ceil(({c} - {lo}) / ({hi} - {lo}) * {n}) - 1, 0), {n - 1})::BIGINT"
_LIM = ", w AS (SELECT min(cx) AS lx, max(cx) AS hx, min(cy) AS ly, max(cy) AS hy, min(cz) AS lz, max(cz) AS hz FROM o)"


def _cells(g, axes, level=3):
    o = objects(g)
    b = sp.bounds_of(o)
    return o.select("id", *[sp.cell_of(F.col(f"c{a}"), F.lit(b[f"min_{a}"]), F.lit(b[f"max_{a}"]), level).alias(a) for a in axes])


R.add("j1_cell_quad", "sc_geodes", lambda g: _cells(g, "xy"), OBJ_SQL + _LIM + f" SELECT id, {_cell('cx', 'lx', 'hx', 8)} AS x, {_cell('cy', 'ly', 'hy', 8)} AS y FROM o, w")
R.add("j1_cell_oct", "sc_geodes", lambda g: _cells(g, "xyz"), OBJ_SQL + _LIM + f" SELECT id, {_cell('cx', 'lx', 'hx', 8)} AS x, {_cell('cy', 'ly', 'hy', 8)} AS y, {_cell('cz', 'lz', 'hz', 8)} AS z FROM o, w")
R.add("p17_centre_in_cell", "sc_geodes", lambda g: objects(g).withColumns({f"cell_{n}_{a}": F.lit(v) for a in "xyz" for n, v in (("min", 5.0), ("max", 20.0))}).select("id", sp.centre_in("cell_").alias("inside")), OBJ_SQL + " SELECT id, cx >= 5 AND cx <= 20 AND cy >= 5 AND cy <= 20 AND cz >= 5 AND cz <= 20 AS inside FROM o")
R.add(
    "t5_grid_split",
    "sc_geodes",
    lambda g: g.groupBy("node_id").agg(*[f(f"c{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).join(g, "node_id").groupBy("node_id", *[sp.grid_key(F.col(f"c{a}"), F.col(f"lo_{a}"), F.col(f"hi_{a}")).alias(f"k{a}") for a in "xyz"]).count(),
    ", w AS (SELECT node_id, min(cx) AS lx, max(cx) AS hx, min(cy) AS ly, max(cy) AS hy, min(cz) AS lz, max(cz) AS hz FROM sc_geodes GROUP BY node_id) SELECT g.node_id, least(floor((cx - lx) / (hx - lx) * 2), 1)::BIGINT AS kx, least(floor((cy - ly) / (hy - ly) * 2), 1)::BIGINT AS ky, least(floor((cz - lz) / (hz - lz) * 2), 1)::BIGINT AS kz, count(*) AS count FROM sc_geodes g JOIN w ON w.node_id = g.node_id GROUP BY 1, 2, 3, 4",
)
R.add("o10_split_axis", "sc_vertices", lambda v: m.boxes(v).select("prim_id", sp.unsplit_axis(*[m.extent(a) for a in "xyz"]).alias("axis")), f", b AS ({BOX_SQL}), d AS (SELECT prim_id, max_x - min_x AS x, max_y - min_y AS y, max_z - min_z AS z FROM b) SELECT prim_id, CASE least(x, y, z) WHEN x THEN 'x' WHEN y THEN 'y' ELSE 'z' END AS axis FROM d")
_BUCKET = "least(greatest(floor(12 * ({c} - {lo}) / ({hi} - {lo})), 0), 11)::INT"
_HIST = (
    OBJ_SQL
    + ", w AS (SELECT min(min_x) AS lx, max(max_x) AS hx, min(min_y) AS ly, max(max_y) AS hy, min(min_z) AS lz, max(max_z) AS hz, count(*) AS n FROM o), e AS ("
    + " UNION ALL ".join(f"SELECT {k} AS axis, {_BUCKET.format(c='c' + a, lo='l' + a, hi='h' + a)} AS bucket, o.* FROM o, w" for k, a in enumerate("xyz"))
    + "), h AS (SELECT axis, bucket, count(*) AS count, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min(min_z) AS min_z, max(max_z) AS max_z FROM e GROUP BY axis, bucket)"
)
_SIDES = _HIST + ", s AS (SELECT a.axis, b.i AS bucket, " + ", ".join(f"coalesce(sum(count) FILTER ({c}), 0)::BIGINT AS {n}_count, " + ", ".join(f"{f}({f}_{x}) FILTER ({c}) AS {n}_{f}_{x}" for x in "xyz" for f in ("min", "max")) for n, c in (("left", "bucket <= b.i"), ("right", "bucket > b.i"))) + " FROM (VALUES (0), (1), (2)) a(axis), (SELECT unnest(range(0, 11)) AS i) b LEFT JOIN h ON h.axis = a.axis GROUP BY 1, 2)".replace("(VALUES (0), (1), (2)) a(axis), (SELECT", "(VALUES (0), (1), (2)) a(axis) CROSS JOIN (SELECT")
R.add("a20_sah_histogram", "sc_geodes", lambda g: sp.sah_histogram(objects(g)), _HIST + " SELECT * FROM h")
R.add("w3_sah_prefix_suffix", "sc_geodes", lambda g: sp.prefix_suffix(sp.sah_histogram(objects(g))), _SIDES + " SELECT axis, bucket::INT AS bucket, " + ", ".join(f"{n}_count, " + ", ".join(f"{n}_{f}_{x}" for x in "xyz" for f in ("min", "max")) for n in ("left", "right")) + " FROM s")
_sa = lambda p: "2 * (" + " + ".join(f"({p}max_{a} - {p}min_{a}) * ({p}max_{b} - {p}min_{b})" for a, b in (("x", "y"), ("y", "z"), ("z", "x"))) + ")"


def _whole(o):
    return o.agg(F.count("*").alias("n"), *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


R.add(
    "o11_best_split",
    "sc_geodes",
    lambda g: sp.best_split(sp.prefix_suffix(sp.sah_histogram(objects(g))), _whole(objects(g))).select("axis", F.round("position", 6).alias("position"), F.round("cost", 4).alias("cost"), "pays"),
    _SIDES
    + f", t AS (SELECT *, {_sa('').replace('max_', 'h').replace('min_', 'l')} AS area FROM w), c AS (SELECT axis, bucket, round(1 + 1.5 * ({_sa('left_')} / area * left_count + {_sa('right_')} / area * right_count), 9) AS cost, n, CASE axis WHEN 0 THEN lx + (hx - lx) * (bucket + 1) / 12 WHEN 1 THEN ly + (hy - ly) * (bucket + 1) / 12 ELSE lz + (hz - lz) * (bucket + 1) / 12 END AS position FROM s, t WHERE left_count > 0 AND right_count > 0) SELECT axis, round(position, 6) AS position, round(cost, 4) AS cost, cost < 1.5 * n AS pays FROM c ORDER BY c.cost, axis, bucket LIMIT 1",
)
_inst = lambda g: g.select(F.col("geode_id").alias("instance_id"), "cx", "cy", "cz")
_tile = lambda g, half=6.0: objects(g).select(F.col("id").alias("tile_id"), (F.col("id") * 7 % 1009 * 100_000 + F.col("id")).alias("preorder"), *[(F.col(f"c{a}") + s * half).alias(f"{n}_{a}") for a in "xyz" for n, s in (("min", -1), ("max", 1))])
R.add("j2_instance_to_tile", "sc_geodes", lambda g: sp.first_tile_of(_inst(g), _tile(g)), ", h AS (SELECT i.geode_id AS i, arg_min(t.geode_id, t.geode_id * 7 % 1009 * 100000 + t.geode_id) AS t FROM sc_geodes i JOIN sc_geodes t ON abs(i.cx - t.cx) <= 6 AND abs(i.cy - t.cy) <= 6 AND abs(i.cz - t.cz) <= 6 GROUP BY 1) SELECT i.geode_id AS instance_id, h.t AS tile_id FROM sc_geodes i LEFT JOIN h ON h.i = i.geode_id")
# tiles reach as far as their object's radius along z only, so some instances have none
_flat = lambda g: _tile(g, F.col("radius") / 4).withColumns({"min_x": F.col("min_x") + 0.25, "max_x": F.col("max_x") + 0.25})
R.add("j12_unmatched", "sc_geodes", lambda g: sp.first_tile_of(_inst(g), _flat(g)).filter("tile_id IS NULL").select("instance_id"), "SELECT geode_id AS instance_id FROM sc_geodes i WHERE NOT EXISTS (SELECT 1 FROM sc_geodes t WHERE abs(i.cx - (t.cx + 0.25)) <= t.radius / 4 AND abs(i.cy - t.cy) <= t.radius / 4 AND abs(i.cz - t.cz) <= t.radius / 4)")
R.add("a23_instancing", "sc_geodes", lambda g: sp.instances(g.withColumnRenamed("geode_id", "id"), ("class", "size", "brand")).select("class", "size", "brand", "n", "first_id"), "SELECT class, size, brand, count(*) AS n, min(geode_id) AS first_id FROM sc_geodes GROUP BY class, size, brand HAVING count(*) > 1")
R.add("j13_duplicate_geodes", "sc_geodes", lambda g: sp.placements(g, sp.instances(g.withColumnRenamed("geode_id", "id"), ("class", "size", "brand")), ("class", "size", "brand")).filter("geode_id <> first_id").select("first_id", "geode_id"), "SELECT f AS first_id, geode_id FROM (SELECT geode_id, min(geode_id) OVER (PARTITION BY class, size, brand) AS f FROM sc_geodes) x WHERE f <> geode_id")
R.add("o1_radius_order", "sc_geodes", lambda g: numbered(g.select("geode_id", "radius"), F.desc("radius"), "geode_id"), "SELECT geode_id, radius, row_number() OVER (ORDER BY radius DESC, geode_id) AS place FROM sc_geodes")
R.add("o2_instance_order", "sc_geodes", lambda g: numbered(sp.placements(g, sp.instances(g.withColumnRenamed("geode_id", "id"), ("class", "size")), ("class", "size")).select("geode_id", "radius"), F.desc("radius"), "geode_id"), "SELECT geode_id, radius, row_number() OVER (ORDER BY radius DESC, geode_id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY class, size) AS n FROM sc_geodes) x WHERE n > 1")
R.add("o7_first_match", "sc_geodes", lambda g: g.groupBy("class").agg(F.min(F.when(F.col("size") > 40, F.col("geode_id"))).alias("first_id")), "SELECT class, min(geode_id) FILTER (size > 40) AS first_id FROM sc_geodes GROUP BY class")


def _greedy(g):
    return sp.greedy_select(objects(g), ("node_id",), 30_000, 5)


_FOLD = OBJ_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY radius DESC, id) AS rn FROM o), f AS (SELECT node_id, rn, id, triangles <= 30000 AS took, CASE WHEN triangles <= 30000 THEN triangles ELSE 0 END AS tri, CASE WHEN triangles <= 30000 THEN [key] ELSE [] END AS keys FROM r WHERE rn = 1 UNION ALL SELECT r.node_id, r.rn, r.id, f.tri + triangles <= 30000 AND (len(f.keys) < 5 OR list_contains(f.keys, key)), CASE WHEN f.tri + triangles <= 30000 AND (len(f.keys) < 5 OR list_contains(f.keys, key)) THEN f.tri + triangles ELSE f.tri END, CASE WHEN f.tri + triangles <= 30000 AND len(f.keys) < 5 AND NOT list_contains(f.keys, key) THEN list_append(f.keys, key) ELSE f.keys END FROM f JOIN r ON r.node_id = f.node_id AND r.rn = f.rn + 1), n AS (SELECT node_id, bool_or(took) AS hit FROM f GROUP BY 1), k AS (SELECT f.node_id, id, took OR (NOT hit AND rn = 1) AS accepted FROM f JOIN n ON n.node_id = f.node_id)"
R.add("o4_greedy_select", "sc_geodes", lambda g: _greedy(g).select("node_id", "id", "accepted"), _FOLD + " SELECT * FROM k")
R.add("u4_difference", "sc_geodes", lambda g: objects(g).select("id").join(_greedy(g).filter("accepted").select("id"), "id", "left_anti"), _FOLD + " SELECT id FROM k WHERE NOT accepted")
R.add("t1_quadtree", "sc_geodes", lambda g: sp.tree(objects(g), "quadtree", 4, 20_000, 20))
R.add("t2_octree", "sc_geodes", lambda g: sp.tree(objects(g), "octree", 3, 20_000, 20))
R.add("t3_kdtree", "sc_geodes", lambda g: sp.kd_tree(objects(g), 5, 20_000, 20))
R.add("t4_instance_tiles", "sc_geodes", lambda g: sp.instances(g.withColumnRenamed("geode_id", "id"), ("class", "size", "brand")).select("first_id", F.lit(0).alias("level"), F.col("n").alias("placements")), "SELECT min(geode_id) AS first_id, 0 AS level, count(*) AS placements FROM sc_geodes GROUP BY class, size, brand HAVING count(*) > 1")
R.add("t6_tile_builder", "sc_geodes", lambda g: sp.tree(sp.placements(objects(g), sp.instances(objects(g), ("class", "size", "brand")), ("class", "size", "brand"), "left_anti"), "quadtree", 4, 20_000, 20).groupBy("level", "x", "y", "z").agg(F.count("*").alias("members")))

_diag = lambda g: g.select(F.col("geode_id").alias("tile_id"), (F.col("radius") * 20).alias("diagonal"))
R.add("t8_lod_parameters", "sc_geodes", lambda g: lod.parameters(_diag(g)), "SELECT geode_id AS tile_id, lod, CASE lod WHEN 2 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS sample_ratio, CASE lod WHEN 2 THEN least(5.0 / (radius * 20), 0.3) WHEN 1 THEN least(0.6 / (radius * 20), 0.075) ELSE 0.01 / (radius * 20) END AS target_error, CASE lod WHEN 2 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS texture_factor FROM sc_geodes, (VALUES (0), (1), (2)) l(lod)")
_lods = lambda g: g.select(F.col("geode_id").alias("tile_id"), F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("lod"), "size").withColumn("lod_error", F.floor(F.col("size") * F.col("lod") / 20).cast("long")).drop("size")
R.add("w11_drop_redundant_lods", "sc_geodes", lambda g: lod.without_redundant(_lods(g)), ", l AS (SELECT geode_id AS tile_id, lod, (size * lod // 20)::BIGINT AS lod_error FROM sc_geodes, (VALUES (0), (1), (2)) l(lod)) SELECT a.* FROM l a LEFT JOIN l b ON b.tile_id = a.tile_id AND b.lod = a.lod - 1 WHERE b.lod IS NULL OR b.lod_error <> a.lod_error")
R.add("t7_lod_chain", "sc_geodes", lambda g: lod.without_redundant(_lods(g)).groupBy("tile_id").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("lod"))), ">").alias("chain")), ", l AS (SELECT geode_id AS tile_id, lod, size * lod // 20 AS e FROM sc_geodes, (VALUES (0), (1), (2)) l(lod)), k AS (SELECT a.* FROM l a LEFT JOIN l b ON b.tile_id = a.tile_id AND b.lod = a.lod - 1 WHERE b.lod IS NULL OR b.e <> a.e) SELECT tile_id, string_agg(lod::VARCHAR, '>' ORDER BY lod DESC) AS chain FROM k GROUP BY tile_id")
_DEN, _TAN = "(2 * tan(atan(tan(pi() / 6) / 2)))", "tan(atan(tan(pi() / 6) / 2))"
_GE_PX = "({den} * 16 * ({r}) / tan(2 * atan(tan(pi() / 6) / 2) / 936 * ({px}) / 2) / 936)"
R.add(
    "t10_geometric_error",
    "sc_geodes",
    lambda g: g.select("geode_id", F.round(lod.error_of_pixels(F.lit(25.0), F.col("radius")), 9).alias("by_pixels"), F.round(lod.error_at(F.col("radius") * 100), 9).alias("by_distance"), F.round(lod.error_of_lod(F.col("size") / 100, F.col("radius")), 9).alias("by_lod")),
    f"SELECT geode_id, round({_GE_PX.format(den=_DEN, r='radius', px='25')}, 9) AS by_pixels, round({_DEN} * 16 * radius * 100 / 936, 9) AS by_distance, round({_DEN} * 16 * (size / 100 / ({_TAN} * 2 / 936) + radius) / 936, 9) AS by_lod FROM sc_geodes",
)
_PX = "CASE WHEN node_id >= 100 THEN 100 WHEN node_id > 0 THEN 50 ELSE 25 END"


def _tiles(n, g):
    size = g.groupBy("node_id").agg(F.sum("radius").alias("volume"), F.max("radius").alias("diagonal"))
    level = F.when(F.col("node_id") == 0, 0).when(F.col("node_id") < 100, 1).when(F.col("node_id") < 1000, 2).otherwise(3)
    return n.join(size, "node_id", "left").select(F.col("node_id").alias("tile_id"), "parent_id", level.alias("level"), F.coalesce("diagonal", F.lit(1.0)).alias("diagonal"), F.coalesce("volume", F.lit(1.0)).alias("volume"))


_UP = ", z AS (SELECT n.node_id, n.parent_id, coalesce(max(radius), 1) AS d, coalesce(sum(radius), 1) AS v FROM sc_nodes n LEFT JOIN sc_geodes g ON g.node_id = n.node_id GROUP BY 1, 2)"


def _level_sql(name, child, below, px):
    e = _GE_PX.format(den=_DEN, r="z.d * 0.7", px=px)
    return f", {name} AS (SELECT z.parent_id AS id, CASE WHEN max(c.e) >= sum({e} * z.v) / sum(z.v) THEN max(c.e) + 0.1 ELSE sum({e} * z.v) / sum(z.v) END AS e FROM z JOIN {child} c ON c.id = z.node_id GROUP BY z.parent_id)"


# leaves are suppliers; nations without suppliers have error 0 as well
_UP_SQL = _UP + ", l3 AS (SELECT node_id AS id, 0::DOUBLE AS e FROM z WHERE node_id >= 1000)" + _level_sql("k2", "l3", 3, 100) + ", l2 AS (SELECT node_id AS id, coalesce(e, 0) AS e FROM z LEFT JOIN k2 ON k2.id = node_id WHERE node_id BETWEEN 100 AND 999)" + _level_sql("l1", "l2", 2, 50) + _level_sql("l0", "l1", 1, 25) + " SELECT id AS tile_id, round(e, 6) AS geometric_error FROM (SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0) x"
R.add("a7_error_rollup", "sc_nodes sc_geodes", lambda n, g: lod.roll_up(_tiles(n, g)).select("tile_id", F.round("geometric_error", 6).alias("geometric_error")), _UP_SQL)
R.add("t13_tile_pipeline", "sc_nodes sc_geodes", lambda n, g: lod.roll_up(_tiles(n, g)).join(_tiles(n, g), "tile_id").groupBy("level").agg(F.count("*").alias("tiles"), F.round(F.max("geometric_error"), 6).alias("max_error")), _UP_SQL.replace("SELECT id AS tile_id, round(e, 6) AS geometric_error FROM", "SELECT CASE WHEN id = 0 THEN 0 WHEN id < 100 THEN 1 WHEN id < 1000 THEN 2 ELSE 3 END AS level, count(*) AS tiles, round(max(e), 6) AS max_error FROM") + " GROUP BY 1")
R.add("a8_tileset_error", "sc_geodes", lambda g: g.select("geode_id", F.round(lod.tileset_error(F.col("radius"), F.col("size") / 10), 9).alias("error")), f"SELECT geode_id, round(greatest({_GE_PX.format(den=_DEN, r='radius', px='25')}, 1.5 * (size / 10)), 9) AS error FROM sc_geodes")
R.add("a9_weighted_scene_error", "sc_geodes", lambda g: g.agg(F.round(F.sum(lod.error_of_pixels(F.lit(25.0), F.col("radius")) * F.col("size")) / F.sum("size"), 6).alias("error")), f"SELECT round(sum({_GE_PX.format(den=_DEN, r='radius', px='25')} * size) / sum(size), 6) AS error FROM sc_geodes")
R.add("t11_bounding_volumes", "sc_vertices", lambda v: m.boxes(v).select("prim_id", lod.box12().alias("b"), lod.sphere4().alias("s")).select("prim_id", *[(F.col("b")[k] + 0.0).alias(f"b{k}") for k in (0, 1, 2, 3, 7, 11)], F.round(F.col("s")[3], 6).alias("radius")), f", b AS ({BOX_SQL}) SELECT prim_id, (min_x + max_x) / 2 AS b0, 0.0 - (min_z + max_z) / 2 AS b1, (min_y + max_y) / 2 AS b2, (max_x - min_x) / 2 AS b3, 0.0 - (max_z - min_z) / 2 AS b7, (max_y - min_y) / 2 AS b11, round(sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2) / 2, 6) AS radius FROM b")
R.add("t12_uris", "sc_geodes", lambda g: g.select("geode_id", lod.uri(F.when(F.col("geode_id") % 4 == 0, "i3dm").otherwise("b3dm"), F.col("size"), F.col("node_id"), F.col("material_id"), F.col("geode_id"), F.col("mode_no") - 1).alias("uri")), "SELECT geode_id, CASE WHEN mode_no = 0 THEN NULL WHEN geode_id % 4 = 0 THEN 'InstanceTiles/Tile_L' || (mode_no - 1) || '_' || geode_id || '.i3dm' ELSE size || '/Tile_L' || (mode_no - 1) || '_' || node_id || '_' || material_id || '_' || geode_id || '.b3dm' END AS uri FROM sc_geodes")


def _built(g):
    return tiler.build(objects(g), ("class", "size", "brand"), tiler.Options(levels=4, max_triangles=20_000))


R.add("plan_tileset_tiles", "sc_geodes", lambda g: _built(g)["tiles"].select("tile_id", "level", "members", "triangles", "geometric_error", "uri"))
R.add("plan_tileset_root", "sc_geodes", lambda g: tiler.tileset(_built(g)["tiles"]))
