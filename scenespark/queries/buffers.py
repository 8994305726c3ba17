"""Queries on columnar buffers, attribute tables, containers, atlases and scalar encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenespark.functions import linalg as la
from scenespark.operators import attributes as at
from scenespark.operators import gltf as gl
from scenespark.operators import metrics as m
from scenespark.operators import model as md
from scenespark.operators import pack
from scenespark.queries import Registry
from scenespark.queries.metrics import BOX_SQL
from scenespark.sources import containers as ct
from scenespark.sources import gltf as gf

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_B = f", b AS ({BOX_SQL}), c AS (SELECT b.*, n, material_id FROM b JOIN sc_counts k ON k.prim_id = b.prim_id JOIN sc_geodes ON geode_id = b.prim_id)"
_LO, _HI = ["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"]
R.add("a17_accessor_merge", "sc_vertices sc_counts sc_geodes", lambda v, c, g: gl.merge_accessors(m.boxes(v).join(c.withColumnRenamed("n", "count"), "prim_id").join(g, F.col("prim_id") == F.col("geode_id")), ("material_id",), _LO, _HI), _B + " SELECT material_id, sum(n)::BIGINT AS count, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM c GROUP BY 1")


def prim_accessors(v, g):
    """The accessors of the geodes' primitives; those of even size have texture coordinates."""
    return md.accessors(v, g.select(F.col("geode_id").alias("prim_id"), (F.col("size") % 2 == 0).alias("textured")))


_ACC = ", b AS (SELECT prim_id, count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz, min(u) AS lu, min(v) AS lv, max(u) AS hu, max(v) AS hv FROM sc_vertices GROUP BY 1), w AS (SELECT b.*, material_id, size % 2 = 0 AS textured, CASE WHEN n <= 255 THEN 5121 WHEN n <= 65535 THEN 5123 ELSE 5125 END AS ic FROM b JOIN sc_geodes ON geode_id = prim_id), acc AS (SELECT prim_id, material_id, 0 AS slot, 'POSITION' AS attribute, 'VEC3' AS type, 5126 AS component, n AS count, [lx, ly, lz] AS min, [hx, hy, hz] AS max, n * 12 AS bytes FROM w UNION ALL SELECT prim_id, material_id, 1, 'TEXCOORD_0', 'VEC2', 5126, n, [lu, lv], [hu, hv], n * 8 FROM w WHERE textured UNION ALL SELECT prim_id, material_id, 2, '_BATCHID', 'SCALAR', 5126, n, NULL, NULL, n * 4 FROM w UNION ALL SELECT prim_id, material_id, 3, 'indices', 'SCALAR', ic, n, NULL, NULL, n * CASE ic WHEN 5121 THEN 1 WHEN 5123 THEN 2 ELSE 4 END FROM w), vw AS (SELECT material_id AS buffer_id, prim_id, slot, attribute, count, bytes, (row_number() OVER (PARTITION BY material_id ORDER BY prim_id, slot) - 1) AS view_id, (sum((bytes + 3) // 4 * 4) OVER (PARTITION BY material_id ORDER BY prim_id, slot ROWS UNBOUNDED PRECEDING) - (bytes + 3) // 4 * 4)::BIGINT AS \"offset\" FROM acc)"
_byte = lambda v, g: prim_accessors(v, g).join(g.select(F.col("geode_id").alias("prim_id"), F.col("material_id").alias("buffer_id")), "prim_id")
R.add("p19_quantisable", "sc_vertices sc_geodes", lambda v, g: md.quantisable(prim_accessors(v, g)), _ACC + " SELECT prim_id, bool_or(attribute = 'POSITION' AND len(min) = 3) AS position, bool_or(attribute = 'TEXCOORD_0' AND len(min) = 2) AS texcoord FROM acc GROUP BY 1")
R.add("w5_aligned_offsets", "sc_counts sc_geodes", lambda c, g: gl.aligned_offsets(c.join(g, F.col("prim_id") == F.col("geode_id")).select("material_id", "prim_id", (F.col("n") * 3).alias("bytes")), ("material_id",), "prim_id", "bytes"), "SELECT material_id, prim_id, n * 3 AS bytes, (sum((n * 3 + 3) // 4 * 4) OVER (PARTITION BY material_id ORDER BY prim_id) - (n * 3 + 3) // 4 * 4)::BIGINT AS offset FROM sc_counts JOIN sc_geodes ON prim_id = geode_id")
R.add("k1_scene_buffers", "sc_vertices sc_geodes", prim_accessors, _ACC + " SELECT prim_id, slot, attribute, type, component, count, min, max, bytes FROM acc")
R.add("k1_buffer_views", "sc_vertices sc_geodes", lambda v, g: md.views(_byte(v, g)), _ACC + ' SELECT buffer_id, prim_id, slot, view_id, "offset", bytes FROM vw')
R.add("j4_accessor_deref", "sc_vertices sc_geodes", lambda v, g: (lambda a: md.dereference(a.drop("buffer_id"), md.views(a), md.buffers(a)).select("prim_id", "attribute", "buffer_id", "view_id", "offset", "count", "buffer_bytes"))(_byte(v, g)), _ACC + ' SELECT prim_id, attribute, buffer_id, view_id, "offset", count, (sum((bytes + 3) // 4 * 4) OVER (PARTITION BY buffer_id))::BIGINT AS buffer_bytes FROM vw')


def _with_values(v, g):
    """Accessors beside their positions and indices with their values as text: what their bytes are."""
    xyz = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("vi", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])))
    return prim_accessors(v, g).filter("slot <> 1").join(v.groupBy("prim_id").agg(xyz.alias("xyz")), "prim_id")


R.add("j18_dictionary", "sc_vertices sc_geodes", lambda v, g: md.shared_views(_with_values(v, g), F.when(F.col("slot") == 0, F.col("xyz")).otherwise(F.lit(""))), _ACC + ", p AS (SELECT prim_id, list([x, y, z] ORDER BY vi) AS xyz FROM sc_vertices GROUP BY 1) SELECT prim_id, slot, min(prim_id) OVER (PARTITION BY slot, type, component, count, CASE WHEN slot = 0 THEN xyz END) AS owner FROM acc JOIN p USING (prim_id) WHERE slot <> 1")
R.add("o8_view_removal", "sc_vertices sc_geodes", lambda v, g: md.without_views(md.views(_byte(v, g)), (F.col("slot") == 1) | (F.col("prim_id") % 3 == 0)), _ACC + ', r AS (SELECT *, slot = 1 OR prim_id % 3 = 0 AS gone FROM vw) SELECT buffer_id, prim_id, slot, view_id, "offset", bytes, (row_number() OVER w - 1) AS new_id, (sum((bytes + 3) // 4 * 4) OVER (PARTITION BY buffer_id ORDER BY view_id ROWS UNBOUNDED PRECEDING) - (bytes + 3) // 4 * 4)::BIGINT AS new_offset FROM r WHERE NOT gone WINDOW w AS (PARTITION BY buffer_id ORDER BY view_id)')
R.add("w6_i3dm_offsets", "sc_counts", lambda c: c.select("prim_id", F.lit(0).alias("position"), (F.col("n") * 12).alias("normal_up"), (F.col("n") * 24).alias("normal_right"), (F.col("n") * 36).alias("scale"), (F.col("n") * 48).alias("batch_id"), gl.index_width(F.col("n") * F.when(F.col("prim_id") % 3 == 0, 5000).otherwise(10)).alias("width")), "SELECT prim_id, 0 AS position, n * 12 AS normal_up, n * 24 AS normal_right, n * 36 AS scale, n * 48 AS batch_id, CASE WHEN n * CASE WHEN prim_id % 3 = 0 THEN 5000 ELSE 10 END < 256 THEN 'u8' WHEN n * CASE WHEN prim_id % 3 = 0 THEN 5000 ELSE 10 END < 65536 THEN 'u16' ELSE 'u32' END AS width FROM sc_counts")
R.add("f17_quantize", "sc_vertices", lambda v: v.select("prim_id", "vi", gl.quantise(F.col("u"), (F.col("vi") % 16 + 1).cast("int")).alias("q"), gl.quantise_signed(F.col("u") * 2 - 1, (F.col("vi") % 15 + 2).cast("int")).alias("qs")), "SELECT prim_id, vi, floor(least(greatest(u, 0), 1) * (2 ** (vi % 16 + 1) - 1) + 0.5)::BIGINT AS q, (sign(u * 2 - 1) * floor(abs(least(greatest(u * 2 - 1, -1), 1) * (2 ** (vi % 15 + 1) - 1)) + 0.5))::BIGINT AS qs FROM sc_vertices")
R.add("k11_mesh_quantisation", "sc_vertices", lambda v: v.join(F.broadcast(m.boxes(v, ())), how="left").withColumn("s", F.greatest(*[m.extent(a) for a in "xyz"])).select("prim_id", "vi", *[gl.quantise((F.col(a) - F.col(f"min_{a}")) / F.col("s"), F.lit(14)).alias(f"q{a}") for a in "xyz"]), ", b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM sc_vertices) SELECT prim_id, vi, floor((x - lx) / b.s * 16383 + 0.5)::BIGINT AS qx, floor((y - ly) / b.s * 16383 + 0.5)::BIGINT AS qy, floor((z - lz) / b.s * 16383 + 0.5)::BIGINT AS qz FROM sc_vertices, b")
_OCT = ", o AS (SELECT prim_id, vi, x / (x + y + abs(4 - z)) AS px, y / (x + y + abs(4 - z)) AS py, 4 - z AS nz FROM sc_vertices), p AS (SELECT prim_id, vi, CASE WHEN nz < 0 THEN 1 - py ELSE px END AS u, CASE WHEN nz < 0 THEN 1 - px ELSE py END AS v FROM o)"
R.add("f18_oct_encode", "sc_vertices", lambda v: v.select("prim_id", "vi", *[c.alias(n) for c, n in zip(gl.octahedral((F.col("x"), F.col("y"), 4 - F.col("z"))), ("ou", "ov"))]), _OCT + " SELECT prim_id, vi, floor(u * 127 + 0.5)::BIGINT AS ou, floor(v * 127 + 0.5)::BIGINT AS ov FROM p")
R.add("f20_exponent", "sc_vertices", lambda v: v.select("prim_id", "vi", gl.exponent(F.col("y")).alias("e"), gl.exponent(F.col("v")).alias("ev")), "SELECT prim_id, vi, CASE WHEN y = 0 THEN 0 ELSE floor(log2(abs(y))) + 1 END::INT AS e, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) + 1 END::INT AS ev FROM sc_vertices")
R.add("f21_bit_replication", "sc_vertices", lambda v: v.select("prim_id", "vi", gl.replicate_bits((F.col("x") * 5).cast("int"), 5).alias("c5")), "SELECT prim_id, vi, (((trunc(x * 5)::INT >> 3) << 3) | (trunc(x * 5)::INT >> 3 >> 2))::INT AS c5 FROM sc_vertices")
R.add("f22_uv_transform", "sc_vertices sc_geodes", lambda v, g: v.join(g, F.col("prim_id") == F.col("geode_id")).groupBy("material_id").agg(*[f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))]).select("material_id", F.col("min_u").alias("offset_u"), F.col("min_v").alias("offset_v"), ((F.col("max_u") - F.col("min_u")) / 4095).alias("scale_u"), ((F.col("max_v") - F.col("min_v")) / 4095).alias("scale_v")), "SELECT material_id, min(u) AS offset_u, min(v) AS offset_v, (max(u) - min(u)) / 4095 AS scale_u, (max(v) - min(v)) / 4095 AS scale_v FROM sc_vertices JOIN sc_geodes ON prim_id = geode_id GROUP BY 1")
R.add("f4_section_padding", "sc_counts", lambda c: c.select("prim_id", ct.padded_length(F.col("n"), 28).alias("b3dm"), ct.padded_length(F.col("n"), 32).alias("i3dm")), "SELECT prim_id, ((n + 28 + 7) // 8 * 8 - 28)::BIGINT AS b3dm, ((n + 32 + 7) // 8 * 8 - 32)::BIGINT AS i3dm FROM sc_counts")
R.add("f3_hex_pad", "sc_geodes", lambda g: g.select("geode_id", F.lpad(F.hex("geode_id"), 16, "0").alias("hex")), "SELECT geode_id, lpad(upper(to_hex(geode_id)), 16, '0') AS hex FROM sc_geodes")
_opts = lambda: F.concat_ws(" ", F.when(F.col("size") % 3 == 0, "ct=draco").when(F.col("size") % 3 == 1, " ct=meshopt"), F.concat(F.lit("vp="), F.col("size").cast("string")), F.when(F.col("mode_no") > 2, "noMergeMesh"), F.when(F.col("mode_no") == 1, "quantize=1  vp=9"), F.when(F.col("mode_no") == 5, "unlit=true"))
_OPT_SQL = ", o AS (SELECT geode_id, CASE size % 3 WHEN 0 THEN 'draco' WHEN 1 THEN 'meshopt' END AS ct, CASE WHEN mode_no = 1 THEN '9' ELSE size::VARCHAR END AS vp, mode_no FROM sc_geodes)"
R.add("f2_option_tokens", "sc_geodes", lambda g: g.select("geode_id", md.options(_opts()).alias("o")).select("geode_id", F.col("o")["ct"].alias("ct"), F.col("o")["vp"].alias("vp"), F.size("o").alias("n")), _OPT_SQL + " SELECT geode_id, ct, vp, (1 + (ct IS NOT NULL)::INT + (mode_no > 2)::INT + (mode_no = 1)::INT + (mode_no = 5)::INT)::INT AS n FROM o")
R.add("f5_prefix_match", "sc_geodes", lambda g: g.select("geode_id", F.lower("name").startswith("blue").alias("hit")), "SELECT geode_id, name ILIKE 'blue%' AS hit FROM sc_geodes")
R.add("f7_stringify", "sc_geodes", lambda g: g.select("geode_id", F.concat_ws(" ", F.col("cx").cast("int").cast("string"), F.col("cy").cast("int").cast("string"), F.col("cz").cast("int").cast("string")).alias("text")), "SELECT geode_id, cx::INT || ' ' || cy::INT || ' ' || cz::INT AS text FROM sc_geodes")
R.add("f12_vector_algebra", "sc_vertices", lambda v: v.select("prim_id", "vi", F.round(la.norm([F.col(a) for a in "xyz"]), 6).alias("length"), F.round(la.dot([F.col(a) for a in "xyz"], [F.col("u"), F.col("v"), F.col("w")]) + 1e-9, 6).alias("dot")), "SELECT prim_id, vi, round(sqrt(x * x + y * y + z * z), 6) AS length, round(x * u + y * v + z * w + 1e-9, 6) AS dot FROM sc_vertices")
R.add("f16_hash_combine", "sc_geodes", lambda g: g.groupBy(F.xxhash64("class", "size", "brand").alias("h"), "class", "size", "brand").agg(F.count("*").alias("n"), F.min("geode_id").alias("first_id")).select("first_id", "n"), "SELECT min(geode_id) AS first_id, count(*) AS n FROM sc_geodes GROUP BY class, size, brand")
R.add("f30_array_equality", "sc_vertices", lambda v: v.select("prim_id", "vi", F.forall(F.zip_with(F.array("u", "v"), F.array(F.round("u", 2), F.round("v", 2)), lambda a, b: F.abs(a - b) < 1e-3), lambda x: x).alias("equal")), "SELECT prim_id, vi, abs(u - round(u, 2)) < 1e-3 AND abs(v - round(v, 2)) < 1e-3 AS equal FROM sc_vertices")
R.add("f38_header_arithmetic", "sc_counts", lambda c: c.select("prim_id", (F.lit(28) + ct.padded_length(F.col("n"), 28) + ct.padded_length(F.col("n") * 2)).alias("bytes")), "SELECT prim_id, (28 + (n + 28 + 7) // 8 * 8 - 28 + (n * 2 + 7) // 8 * 8)::BIGINT AS bytes FROM sc_counts")


def _attrs(g):
    a = F.map_filter(F.create_map(F.lit("brand"), F.col("brand"), F.lit("size"), F.when(F.col("size") % 2 == 0, F.col("size").cast("string")), F.lit("type"), F.when(F.col("size") % 3 == 0, F.col("class"))), lambda k, v: v.isNotNull())
    return g.select(F.col("geode_id").alias("id"), a.alias("attrs"))


_SET = "'brand' || CASE WHEN size % 2 = 0 THEN ',size' ELSE '' END || CASE WHEN size % 3 = 0 THEN ',type' ELSE '' END"
R.add("a28_attribute_classes", "sc_geodes", lambda g: at.members(_attrs(g)), f", k AS (SELECT geode_id AS id, {_SET} AS key_set FROM sc_geodes) SELECT id, dense_rank() OVER (ORDER BY key_set) - 1 AS class_id FROM k")
R.add("a28_classes", "sc_geodes", lambda g: at.classes(_attrs(g)), f", k AS (SELECT {_SET} AS key_set, count(*) AS instances FROM sc_geodes GROUP BY 1) SELECT row_number() OVER (ORDER BY key_set) - 1 AS class_id, * FROM k")
R.add("w10_class_ids", "sc_geodes", lambda g: at.key_sets(_attrs(g)).groupBy("key_set").agg(F.min("id").alias("first_id")), f"SELECT {_SET} AS key_set, min(geode_id) AS first_id FROM sc_geodes GROUP BY 1")
R.add("j10_batch_table", "sc_geodes", lambda g: at.columns_of_classes(_attrs(g)).select("key_set", "key", F.sha2("values", 256).alias("values_sha256")), f", k AS (SELECT {_SET} AS s, geode_id AS id, brand, size, class FROM sc_geodes), r AS (SELECT s, id, 'brand' AS key, brand AS v FROM k UNION ALL SELECT s, id, 'size', size::VARCHAR FROM k WHERE size % 2 = 0 UNION ALL SELECT s, id, 'type', class FROM k WHERE size % 3 = 0) SELECT s AS key_set, key, sha256('[' || string_agg('\"' || v || '\"', ',' ORDER BY id) || ']') AS values_sha256 FROM r GROUP BY 1, 2")
R.add("u2_attribute_set_equality", "sc_geodes", lambda g: at.key_sets(_attrs(g)).select("id", (F.array_sort(F.map_keys("attrs")) == F.array(F.lit("brand"), F.lit("size"))).alias("equal")), "SELECT geode_id AS id, size % 2 = 0 AND size % 3 <> 0 AS equal FROM sc_geodes")
R.add("f32_map_keys", "sc_geodes", lambda g: _attrs(g).select("id", F.size(F.map_keys("attrs")).alias("n")), "SELECT geode_id AS id, (1 + (size % 2 = 0)::INT + (size % 3 = 0)::INT)::INT AS n FROM sc_geodes")
R.add("u5_extension_union", "sc_geodes", lambda g: g.groupBy("node_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("class"), F.lit("KHR")))))), ",").alias("extensions")), ", e AS (SELECT node_id, class AS x FROM sc_geodes UNION SELECT node_id, 'KHR' FROM sc_geodes) SELECT node_id, string_agg(x, ',' ORDER BY x) AS extensions FROM e GROUP BY 1")
R.add("o9_sorted_extensions", "sc_geodes", lambda g: g.groupBy("material_id").agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("extensions")), "SELECT material_id, string_agg(DISTINCT class, ',' ORDER BY class) AS extensions FROM sc_geodes GROUP BY 1")
R.add("a34_skeleton_links", "sc_vertices", lambda v: v.select((F.col("s") % 10).alias("bone")).distinct(), "SELECT DISTINCT s % 10 AS bone FROM sc_vertices")
R.add("a38_bind_matrices", "sc_vertices", lambda v: v.groupBy((F.col("s") % 10).alias("bone"), F.floor(F.col("w") * 100 + 0.5).cast("int").alias("matrix")).agg(F.count_distinct("prim_id").alias("rigs")), "SELECT s % 10 AS bone, floor(w * 100 + 0.5)::INT AS matrix, count(DISTINCT prim_id) AS rigs FROM sc_vertices GROUP BY 1, 2")
R.add("j20_bone_bindings", "sc_vertices", lambda v: v.select((F.col("s") % 10).alias("bone"), F.floor(F.col("w") * 100 + 0.5).cast("int").alias("matrix")).distinct().withColumn("copy", F.row_number().over(Window.partitionBy("bone").orderBy("matrix")) - 1), ", d AS (SELECT DISTINCT s % 10 AS bone, floor(w * 100 + 0.5)::INT AS matrix FROM sc_vertices) SELECT bone, matrix, (row_number() OVER (PARTITION BY bone ORDER BY matrix) - 1)::INT AS copy FROM d")


def _tiles(v):
    xyz = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vi", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])))
    return v.groupBy(F.col("prim_id").alias("tile_id")).agg(F.count("*").cast("int").alias("batch_length"), xyz.alias("xyz")).withColumn("kind", F.when(F.col("tile_id") % 4 == 0, "i3dm").otherwise("b3dm"))


R.add("k3_container_bytes", "sc_vertices", lambda v: ct.header_fields(ct.write_tiles(_tiles(v))))


def _instances(v):
    """Every fourth primitive's vertices as instances: a quarter turn about z by the supplier, a scale by the line."""
    turn, one = F.col("s") % 4, F.lit(1.0)
    cos, sin = F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0), F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0)
    own = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "up_x": -sin, "up_y": cos, "up_z": one * 0, "right_x": cos, "right_y": sin, "right_z": one * 0, "sx": F.col("z"), "sy": F.col("z") * 2, "sz": one}
    return v.filter("prim_id % 4 = 0").select(F.col("prim_id").alias("tile_id"), F.col("vi").alias("batch_id"), *[c.alias(n) for n, c in own.items()])


R.add("k4_i3dm_table", "sc_vertices", lambda v: gf.read_instances(gf.instance_tables(_instances(v))).select("tile_id", "batch_id", *[(F.round(c, 3) + 0.0).alias(c) for c in gf.COLUMNS]), "SELECT prim_id AS tile_id, vi AS batch_id, round(x::FLOAT::DOUBLE, 3) AS x, round(y::FLOAT::DOUBLE, 3) AS y, z, -(CASE s % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)::DOUBLE + 0.0 AS up_x, (CASE s % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::DOUBLE AS up_y, 0.0::DOUBLE AS up_z, (CASE s % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::DOUBLE AS right_x, (CASE s % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)::DOUBLE AS right_y, 0.0::DOUBLE AS right_z, z AS sx, z * 2 AS sy, 1.0::DOUBLE AS sz FROM sc_vertices WHERE prim_id % 4 = 0")
R.add("s12_b3dm_scan", "sc_vertices", lambda v: ct.parse_tiles(ct.write_tiles(_tiles(v))).select("tile_id", "magic", F.coalesce(F.get_json_object("feature", "$.BATCH_LENGTH"), F.get_json_object("feature", "$.INSTANCES_LENGTH")).cast("long").alias("batch_length"), "error"), "SELECT prim_id AS tile_id, CASE WHEN prim_id % 4 = 0 THEN 'i3dm' ELSE 'b3dm' END AS magic, count(*) AS batch_length, NULL::VARCHAR AS error FROM sc_vertices GROUP BY 1")


def _meshes(v, g):
    flat = lambda cols: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vi", *cols))), lambda p: F.array(*[p[c] for c in cols])))
    tiles = v.groupBy(F.col("prim_id").alias("tile_id")).agg(flat("xyz").alias("xyz"), flat("uv").alias("all_uv"))
    return tiles.join(g.select(F.col("geode_id").alias("tile_id"), (F.col("size") % 2 == 0).alias("textured")), "tile_id").withColumn("uv", F.when(F.col("textured"), F.col("all_uv")))


R.add("k6_payload_extraction", "sc_vertices sc_geodes", lambda v, g: gf.read_meshes(gf.write_meshes(_meshes(v, g))).select("tile_id", "vi", "triangles", *[F.round(c, 3).alias(c) for c in "xyzuv"]), ", n AS (SELECT prim_id, count(*) AS n FROM sc_vertices GROUP BY 1) SELECT v.prim_id AS tile_id, vi, n // 3 AS triangles, round(x::FLOAT::DOUBLE, 3) AS x, round(y::FLOAT::DOUBLE, 3) AS y, z, CASE WHEN size % 2 = 0 THEN round(u::FLOAT::DOUBLE, 3) END AS u, CASE WHEN size % 2 = 0 THEN round(v::FLOAT::DOUBLE, 3) END AS v FROM sc_vertices v JOIN n ON n.prim_id = v.prim_id JOIN sc_geodes ON geode_id = v.prim_id")
_rec = lambda g: g.select(F.col("geode_id").alias("tile_id"), F.array(F.col("cx"), F.col("cy"), F.col("cz")).alias("box"), F.col("size").alias("geometric_error"), F.lit("REPLACE").alias("refine"), F.when(F.col("mode_no") > 0, F.concat(F.lit("t"), F.col("geode_id").cast("string"))).alias("uri"))
R.add("f33_tile_json", "sc_geodes", lambda g: ct.tileset_json(_rec(g)), """SELECT geode_id AS tile_id, '{"boundingVolume":{"box":[' || cx || ',' || cy || ',' || cz || ']},"geometricError":' || size || ',"refine":"REPLACE"' || CASE WHEN mode_no > 0 THEN ',"content":{"uri":"t' || geode_id || '"}' ELSE '' END || '}' AS json FROM sc_geodes""")
_tree = lambda n: n.select(F.col("node_id").alias("tile_id"), "parent_id", F.when(F.col("node_id") == 0, 0).when(F.col("node_id") < 100, 1).when(F.col("node_id") < 1000, 2).otherwise(3).alias("level"), (F.col("node_id") % 9).alias("geometric_error"), F.array("tx", "ty", "tz", *[F.lit(float(k in (0, 4, 8))) for k in range(9)]).alias("box"), F.when(F.col("kind") == "skeleton", "ADD").otherwise("REPLACE").alias("refine"), F.when(F.col("node_id") % 3 == 0, F.concat(F.lit("tiles/"), "name", F.lit(".b3dm"))).alias("uri"))
R.add("k5_tileset_json", "sc_nodes", lambda n: gf.tileset(_tree(n)))
R.add("s14_tileset_scan", "sc_nodes", lambda n: gf.read_tileset(gf.tileset(_tree(n))), "SELECT node_id AS tile_id, parent_id, CASE WHEN node_id = 0 THEN 0 WHEN node_id < 100 THEN 1 WHEN node_id < 1000 THEN 2 ELSE 3 END AS level, (node_id % 9)::DOUBLE AS geometric_error, CASE kind WHEN 'skeleton' THEN 'ADD' ELSE 'REPLACE' END AS refine, CASE WHEN node_id % 3 = 0 THEN 'tiles/' || name || '.b3dm' END AS uri, [tx, ty, tz, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] AS box FROM sc_nodes")
R.add("f34_json_get", "sc_geodes", lambda g: ct.tileset_json(_rec(g)).select("tile_id", F.coalesce(F.get_json_object("json", "$.content.uri"), F.lit("")).alias("uri"), F.coalesce(F.get_json_object("json", "$.missing").cast("int"), F.lit(-1)).alias("missing")), "SELECT geode_id AS tile_id, CASE WHEN mode_no > 0 THEN 't' || geode_id ELSE '' END AS uri, -1 AS missing FROM sc_geodes")
R.add("f35_feature_table", "sc_counts", lambda c: c.select("prim_id", F.to_json(F.struct(F.col("n").alias("BATCH_LENGTH"))).alias("json")), """SELECT prim_id, '{"BATCH_LENGTH":' || n || '}' AS json FROM sc_counts""")
_img = lambda i: i.select(F.col("format").cast("long").alias("atlas_key"), "image_id", "w", "h")
R.add("o5_atlas_fill", "sc_images", lambda i: pack.greedy_fill(_img(i), ("atlas_key",), 256 * 256))
R.add("o6_pack", "sc_images", lambda i: pack.skyline_pack(_img(i), 512, 512))
R.add("k15_atlas", "sc_images", lambda i: pack.atlas_json(pack.skyline_pack(_img(i), 512, 512)).select("atlas_key", "atlas", F.length("json").alias("bytes")))
R.add("f36_atlas_json", "sc_images", lambda i: pack.atlas_json(pack.skyline_pack(_img(i), 512, 512)))
R.add("k2_writer_options", "sc_geodes", lambda g: g.select("geode_id", md.options(_opts()).alias("o")).select("geode_id", md.processors(F.col("o")).alias("processors")), _OPT_SQL + " SELECT geode_id, 'mergeMaterial' || CASE WHEN mode_no > 2 THEN '' ELSE ',mergeMesh' END || CASE WHEN mode_no = 1 THEN ',quantize' ELSE '' END || coalesce(',' || ct, '') || CASE WHEN mode_no = 5 THEN ',unlit' ELSE '' END AS processors FROM o")
R.add("f13_surface_area", "sc_vertices", lambda v: m.boxes(v).select("prim_id", F.round(2 * (m.extent("x") * m.extent("y") + m.extent("y") * m.extent("z") + m.extent("z") * m.extent("x")) + 1e-9, 6).alias("area")), f", b AS ({BOX_SQL}) SELECT prim_id, round(2 * ((max_x - min_x) * (max_y - min_y) + (max_y - min_y) * (max_z - min_z) + (max_z - min_z) * (max_x - min_x)) + 1e-9, 6) AS area FROM b")
R.add("w13_serpentine_order", "sc_geodes", lambda g: g.withColumn("row", F.floor(F.col("cy") / 10)).withColumn("along", F.when(F.col("row") % 2 == 0, F.col("cx")).otherwise(-F.col("cx"))).select("geode_id", F.row_number().over(Window.partitionBy("row").orderBy("along", "geode_id")).alias("place"), F.col("row")), "SELECT geode_id, (row_number() OVER (PARTITION BY floor(cy / 10) ORDER BY CASE WHEN floor(cy / 10) % 2 = 0 THEN cx ELSE -cx END, geode_id))::INT AS place, floor(cy / 10)::BIGINT AS row FROM sc_geodes")
R.add("f9_nearest_pow2", "sc_counts", lambda c: c.select("prim_id", F.pow(F.lit(2.0), F.floor(F.log2("n") + 0.5)).cast("long").alias("nearest"), F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long").alias("below")), "SELECT prim_id, (2 ** floor(log2(n) + 0.5))::BIGINT AS nearest, (2 ** floor(log2(n)))::BIGINT AS below FROM sc_counts")
R.add("f10_clamp", "sc_vertices", lambda v: v.select("prim_id", "vi", F.least(F.greatest(F.col("y"), F.lit(25.0)), F.lit(75.0)).alias("y")), "SELECT prim_id, vi, CASE WHEN y < 25 THEN 25 WHEN y > 75 THEN 75 ELSE y END::DOUBLE AS y FROM sc_vertices")
R.add("f11_math", "sc_vertices", lambda v: v.select("prim_id", "vi", *[F.round(e + 1e-9, 6).alias(n) for n, e in (("log2", F.log2("x")), ("tan", F.tan(F.col("u") / 2)), ("atan", F.atan("y")), ("sqrt", F.sqrt("x")), ("pow", F.pow("u", F.lit(3.0))))]), "SELECT prim_id, vi, round(log2(x) + 1e-9, 6) AS log2, round(tan(u / 2) + 1e-9, 6) AS tan, round(atan(y) + 1e-9, 6) AS atan, round(sqrt(x) + 1e-9, 6) AS sqrt, round(u * u * u + 1e-9, 6) AS pow FROM sc_vertices")
R.add("f19_oct32p", "sc_vertices", lambda v: v.select("prim_id", "vi", *[c.alias(n) for c, n in zip(gl.oct32p((F.col("x"), F.col("y"), 4 - F.col("z"))), ("ou", "ov"))]), _OCT + " SELECT prim_id, vi, floor((u * 0.5 + 0.5) * 65535)::BIGINT AS ou, floor((v * 0.5 + 0.5) * 65535)::BIGINT AS ov FROM p")
R.add("f37_little_endian", "sc_counts", lambda c: c.select("prim_id", F.hex(gl.little_endian(F.col("n") * 1000)).alias("bytes")), ", h AS (SELECT prim_id, lpad(upper(to_hex(n * 1000)), 8, '0') AS h FROM sc_counts) SELECT prim_id, h[7:8] || h[5:6] || h[3:4] || h[1:2] AS bytes FROM h")
R.add("f39_deep_equality", "sc_geodes", lambda g: g.groupBy(F.struct("class", "size", F.struct("brand", "mode_no")).alias("content")).agg(F.min("geode_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("first_id", "n"), "SELECT min(geode_id) AS first_id, count(*) AS n FROM sc_geodes GROUP BY class, size, brand, mode_no HAVING count(*) > 1")
