"""Queries on materials, textures, images, cameras and lights."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.operators import materials as mt
from scenespark.operators.order import numbered
from scenespark.queries import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_CONTENT = ("kind", "metallic", "roughness", "color_tex")
_G = ", ".join(_CONTENT)
R.add("a24_material_dedup", "sc_materials", lambda m: mt.dense_ids(m, "material_id", _CONTENT), f"SELECT {_G}, row_number() OVER (ORDER BY min(material_id)) - 1 AS new_id FROM sc_materials GROUP BY {_G}")
R.add("j3_material_remap", "sc_geodes sc_materials", lambda g, m: mt.remap(g.select("geode_id", "material_id"), mt.dedup(m, "material_id", _CONTENT), "material_id"), f", k AS (SELECT material_id, min(material_id) OVER (PARTITION BY {_G}) AS kept FROM sc_materials) SELECT geode_id, kept AS material_id FROM sc_geodes JOIN k USING (material_id)")
R.add("j14_state_registry", "sc_materials", lambda m: m.select(*_CONTENT).distinct(), f"SELECT DISTINCT {_G} FROM sc_materials")
R.add("f40_material_equality", "sc_materials", lambda m: mt.dedup(m, "material_id", _CONTENT).filter("kept <> material_id"), ", p AS (SELECT a.material_id, min(b.material_id) AS kept FROM sc_materials a JOIN sc_materials b ON a.kind = b.kind AND a.metallic = b.metallic AND a.roughness = b.roughness AND a.color_tex IS NOT DISTINCT FROM b.color_tex GROUP BY 1) SELECT * FROM p WHERE kept <> material_id")
R.add("p21_has_texture", "sc_materials", lambda m: m.select("material_id", F.coalesce("color_tex", F.lit(None)).isNotNull().alias("textured")), "SELECT material_id, color_tex IS NOT NULL AS textured FROM sc_materials")
R.add("p23_alpha_mode", "sc_materials", lambda m: m.select("material_id", mt.alpha_mode(F.col("metallic") > 0.3).alias("alpha_mode"), (F.col("roughness") < 0.5).alias("double_sided")), "SELECT material_id, CASE WHEN metallic > 0.3 THEN 'BLEND' ELSE 'OPAQUE' END AS alpha_mode, roughness < 0.5 AS double_sided FROM sc_materials")
_WRAPS = ("CLAMP", "REPEAT", "CLAMP_TO_BORDER", "MIRRORED_REPEAT", "CLAMP_TO_EDGE")
_wrap = lambda c: F.element_at(F.array(*map(F.lit, _WRAPS)), (c % 5 + 1).cast("int"))
R.add("p24_wrap_modes", "sc_geodes", lambda g: g.select("geode_id", mt.clamp_wrap(_wrap(F.col("geode_id"))).alias("wrap")), "SELECT geode_id, CASE WHEN geode_id % 5 = 1 THEN 'REPEAT' WHEN geode_id % 5 = 3 THEN 'MIRRORED_REPEAT' ELSE 'CLAMP_TO_EDGE' END AS wrap FROM sc_geodes")
_EXTS = ("png", "JPG", "jpeg", "ktx2", "webp", "tga", "KTX")
_file = lambda: F.concat(F.lit("dir.x/"), F.col("image_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("image_id") % 7 + 1).cast("int")))
_EXT_SQL = "CASE image_id % 7 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_EXTS)) + " END"
R.add("p25_mime_types", "sc_images", lambda i: i.select("image_id", mt.mime_type(_file()).alias("mime")), "SELECT image_id, CASE image_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/ktx2' WHEN 4 THEN 'image/webp' WHEN 6 THEN 'image/ktx' END AS mime FROM sc_images")
R.add("s13_image_files", "sc_images", lambda i: mt.image_files(i.select("image_id", _file().alias("file"))), f"SELECT image_id, 'dir.x/' || image_id || '.' || {_EXT_SQL} AS file FROM sc_images WHERE image_id % 7 <> 5")
R.add("f1_extension", "sc_images", lambda i: i.select("image_id", mt.extension(_file()).alias("ext"), F.regexp_extract(_file(), r"([^/]+)\.[^.]+$", 1).alias("stem")), f"SELECT image_id, lower({_EXT_SQL}) AS ext, image_id::VARCHAR AS stem FROM sc_images")
R.add("p26_v_flip", "sc_vertices", lambda v: v.select("prim_id", "vi", *[x.alias(n) for x, n in zip(mt.flip_v(F.col("u"), F.col("v")), ("offset_y", "scale_y"))]).withColumn("scale_y", F.col("scale_y") + 0.0), "SELECT prim_id, vi, 1 - u AS offset_y, -v + 0.0 AS scale_y FROM sc_vertices")
R.add("a25_image_dedup", "sc_images", mt.distinct_images, "SELECT image_id, min(image_id) OVER (PARTITION BY file <> '', CASE WHEN file = '' THEN sha256(text) ELSE file END) AS kept FROM sc_images")
R.add("a32_image_hash", "sc_images", lambda i: i.select("image_id", F.sha2(F.concat_ws("|", F.col("w").cast("string"), F.col("h").cast("string"), F.col("format").cast("string"), "text"), 256).alias("hash")), "SELECT image_id, sha256(w || '|' || h || '|' || format || '|' || text) AS hash FROM sc_images")
R.add("k10_texture_export", "sc_images", lambda i: i.select(F.sha2("text", 256).alias("hash"), "image_id").groupBy("hash").agg(F.min("image_id").alias("written")), "SELECT sha256(text) AS hash, min(image_id) AS written FROM sc_images GROUP BY 1")
R.add("o3_image_order", "sc_images", lambda i: numbered(i.select("image_id", "h", "w"), F.desc("h"), F.desc("w"), "image_id"), "SELECT image_id, h, w, row_number() OVER (ORDER BY h DESC, w DESC, image_id) AS place FROM sc_images")
R.add("j17_texture_reuse", "sc_images", lambda i: mt.dedup(i.filter("file <> ''").withColumn("wrap", _wrap(F.col("image_id"))), "image_id", ("file", "wrap")), "SELECT image_id, min(image_id) OVER (PARTITION BY file, image_id % 5) AS kept FROM sc_images WHERE file <> ''")


def _resolve(i):
    paths = [F.concat(F.lit(p), F.col("image_id").cast("string")) for p in ("a", "b", "c", "d")]
    files = i.select("image_id", *[p.alias(f"p{k}") for k, p in enumerate(paths)])
    there = i.filter("image_id % 3 = 0").select(F.concat(F.lit("c"), F.col("image_id").cast("string")).alias("path")).unionByName(i.filter("image_id % 2 = 0").select(F.concat(F.lit("b"), F.col("image_id").cast("string")).alias("path")))
    return mt.resolve_path(files, there, ["p0", "p1", "p2", "p3"])


R.add("s5_path_resolution", "sc_images", _resolve, "SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'b' || image_id WHEN image_id % 3 = 0 THEN 'c' || image_id END AS path FROM sc_images")
R.add("s6_first_valid_layer", "sc_vertices", lambda v: mt.first_valid(v.withColumn("tex", F.when(F.col("s") % 3 == 0, F.col("s"))), "prim_id", "vi", "tex"), "SELECT prim_id, arg_min(s, vi) AS tex FROM sc_vertices WHERE s % 3 = 0 GROUP BY prim_id")
R.add("j15_uv_fallback", "sc_geodes", lambda g: g.alias("a").join(g.filter("size > 25").select(F.col("geode_id").alias("named")), F.col("a.geode_id") + 1 == F.col("named"), "left").join(g.filter("size > 10").select(F.col("geode_id").alias("typed")), F.col("a.geode_id") + 2 == F.col("typed"), "left").select("geode_id", F.coalesce("named", "typed").alias("uv_set")), "SELECT a.geode_id, coalesce(b.geode_id, c.geode_id) AS uv_set FROM sc_geodes a LEFT JOIN sc_geodes b ON b.geode_id = a.geode_id + 1 AND b.size > 25 LEFT JOIN sc_geodes c ON c.geode_id = a.geode_id + 2 AND c.size > 10")
R.add("j5_image_to_atlas", "sc_geodes sc_images", lambda g, i: g.join(i.select(F.col("image_id").alias("geode_id"), "w", "h"), "geode_id").groupBy("geode_id").agg(F.max("w").alias("w"), F.max("h").alias("h")), "SELECT geode_id, w, h FROM sc_geodes JOIN sc_images ON image_id = geode_id")
R.add("a29_invert_alpha", "sc_vertices", lambda v: mt.invert_alpha(v.withColumn("alpha", F.col("w") * 10), "prim_id"), "SELECT prim_id, count(*) FILTER (w * 10 < 0.001) AS zeros, count(*) FILTER (w * 10 > 0.999) AS ones, count(*) FILTER (w * 10 < 0.001) > count(*) FILTER (w * 10 > 0.999) AS invert FROM sc_vertices GROUP BY prim_id")
R.add("p30_transparency", "sc_vertices", lambda v: v.groupBy("prim_id").agg(F.bool_or((F.col("w") < 0.005) | (F.col("s") % 50 == 0)).alias("transparent")), "SELECT prim_id, count(*) FILTER (w < 0.005 OR s % 50 = 0) > 0 AS transparent FROM sc_vertices GROUP BY prim_id")
R.add("p33_phong_record", "sc_materials", lambda m: m.select("material_id", (1 - F.col("metallic")).alias("transparency"), F.round(2 / F.greatest(F.col("roughness") * F.col("roughness"), F.lit(0.01)) - 2, 6).alias("shininess")), "SELECT material_id, 1 - metallic AS transparency, round(2 / greatest(roughness * roughness, 0.01) - 2, 6) AS shininess FROM sc_materials")
R.add("s4_material_scan", "sc_materials", lambda m: m.select("material_id", F.when(F.col("kind") == "MR", F.col("metallic")).otherwise(0.0).alias("metallic"), F.when(F.col("kind") == "MR", F.col("roughness")).otherwise(1 - F.col("roughness")).alias("roughness")), "SELECT material_id, CASE kind WHEN 'MR' THEN metallic ELSE 0 END::DOUBLE AS metallic, CASE kind WHEN 'MR' THEN roughness ELSE 1 - roughness END AS roughness FROM sc_materials")
R.add("s7_cameras", "sc_geodes", lambda g: g.select("geode_id", (F.col("size") + 20.0).alias("fov"), F.when(F.col("mode_no") == 0, "HORIZONTAL").when(F.col("mode_no") == 1, "VERTICAL").otherwise("UNSUPPORTED").alias("mode")), "SELECT geode_id, size + 20.0::DOUBLE AS fov, CASE mode_no WHEN 0 THEN 'HORIZONTAL' WHEN 1 THEN 'VERTICAL' ELSE 'UNSUPPORTED' END AS mode FROM sc_geodes")
R.add(
    "s8_lights",
    "sc_geodes",
    lambda g: g.select("geode_id", F.when(F.col("mode_no") < 3, F.round(mt.spot_exponent(F.col("size") / 10.0), 6)).alias("exponent"), F.round(F.col("radius") * 0.01, 9).alias("intensity"), F.when(F.col("mode_no") == 1, F.col("cx")).alias("linear"), F.when(F.col("mode_no").isin(2, 3), F.col("cx")).alias("quadratic")),
    "SELECT geode_id, CASE WHEN mode_no < 3 THEN round((180.0 / greatest(size / 10.0, 0.467532) - 1.0) / 3.0, 6) END AS exponent, round(radius * 0.01, 9) AS intensity, CASE WHEN mode_no = 1 THEN cx END AS linear, CASE WHEN mode_no IN (2, 3) THEN cx END AS quadratic FROM sc_geodes",
)
R.add("f14_pow2_resize", "sc_images", lambda i: i.select("image_id", mt.power_of_two(F.col("w"), 512).alias("w2"), mt.power_of_two(F.col("h"), 512).alias("h2")), "SELECT image_id, least(CASE WHEN w - 2 ** floor(log2(w)) > 2 * 2 ** floor(log2(w)) - w THEN 2 * 2 ** floor(log2(w)) ELSE 2 ** floor(log2(w)) END, 512)::INT AS w2, least(CASE WHEN h - 2 ** floor(log2(h)) > 2 * 2 ** floor(log2(h)) - h THEN 2 * 2 ** floor(log2(h)) ELSE 2 ** floor(log2(h)) END, 512)::INT AS h2 FROM sc_images")
R.add("f15_mips", "sc_images", lambda i: i.select("image_id", F.explode(mt.mips(F.col("w"), F.col("h"))).alias("m")).select("image_id", "m.level", "m.w", "m.h"), ", l AS (SELECT image_id, w, h, unnest(range(0, floor(log2(greatest(w, h)))::INT + 1))::INT AS level FROM sc_images) SELECT image_id, level, greatest(1, w >> level)::INT AS w, greatest(1, h >> level)::INT AS h FROM l")
R.add("f23_luma", "sc_vertices", lambda v: v.select("prim_id", "vi", mt.luma((F.col("x") * 5).cast("int"), (F.col("y") * 2).cast("int"), (F.col("z") * 30).cast("int")).alias("luma")), "SELECT prim_id, vi, floor(0.299 * trunc(x * 5) + 0.587 * trunc(y * 2) + 0.114 * trunc(z * 30) + 1e-9)::INT AS luma FROM sc_vertices")
_PIX = ", p AS (SELECT vec_id, i - 1 AS i, round(least(greatest(0.5 + embedding[i]::DOUBLE, 0), 1), 6) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) e)"
_pix = lambda: F.transform("embedding", lambda e: F.round(F.least(F.greatest(0.5 + e.cast("double"), F.lit(0.0)), F.lit(1.0)), 6))
_n = lambda dx, dy: f"(SELECT v FROM p q WHERE q.vec_id = p.vec_id AND q.i = least(greatest(p.i // 8 + {dy}, 0), 7) * 8 + least(greatest(p.i % 8 + {dx}, 0), 7))"
R.add(
    "f24_sobel",
    "embeddings",
    lambda e: e.select("vec_id", F.posexplode(mt.sobel(_pix())).alias("i", "s")).select("vec_id", "i", *[F.round(F.col(f"s.{k}") + 1e-9, 5).alias(k) for k in ("nx", "ny", "nz")]),
    "WITH " + _PIX[2:] + f", d AS (SELECT vec_id, i, {_n(1, -1)} + 2 * {_n(1, 0)} + {_n(1, 1)} - {_n(-1, -1)} - 2 * {_n(-1, 0)} - {_n(-1, 1)} AS dx, {_n(-1, 1)} + 2 * {_n(0, 1)} + {_n(1, 1)} - {_n(-1, -1)} - 2 * {_n(0, -1)} - {_n(1, -1)} AS dy FROM p) SELECT vec_id, i::INT AS i, round(-dx / sqrt(dx * dx + dy * dy + 1) * 0.5 + 0.5 + 1e-9, 5) AS nx, round(-dy / sqrt(dx * dx + dy * dy + 1) * 0.5 + 0.5 + 1e-9, 5) AS ny, round(0.5 / sqrt(dx * dx + dy * dy + 1) + 0.5 + 1e-9, 5) AS nz FROM d",
)
R.add("f25_channel_pack", "embeddings", lambda e: e.select("vec_id", F.posexplode(mt.pack_channels(F.slice(_pix(), 1, 16), F.slice(_pix(), 17, 16), F.slice(_pix(), 33, 16))).alias("i", "s")).select("vec_id", "i", "s.r", "s.g", "s.b"), "WITH " + _PIX[2:] + " SELECT a.vec_id, a.i::INT AS i, a.v AS r, b.v AS g, c.v AS b FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.i = a.i + 16 JOIN p c ON c.vec_id = a.vec_id AND c.i = a.i + 32 WHERE a.i < 16")
R.add("f26_metallic_estimate", "sc_vertices", lambda v: v.select("prim_id", "vi", F.round(mt.metallic(F.col("x") / 50, F.col("u")) + 1e-9, 6).alias("metallic")), "SELECT prim_id, vi, round(CASE WHEN x / 50 < 0.04 THEN 0 ELSE least(1.0, greatest(0, (x / 50 - 0.04) / greatest(x / 50 + u - 0.04, 1e-6))) END + 1e-9, 6) AS metallic FROM sc_vertices")
_KINDS = ("u16", "i16", "u32", "i32", "f32")
R.add("f27_pixel_convert", "sc_vertices", lambda v: v.select("prim_id", "vi", mt.to_byte(F.col("x") * 1000, F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("vi") % 5 + 1).cast("int"))).alias("byte")), "SELECT prim_id, vi, floor(least(greatest(x * 1000 / CASE vi % 5 WHEN 0 THEN 65535.0 WHEN 1 THEN 32767.0 WHEN 2 THEN 4294967295.0 WHEN 3 THEN 2147483647.0 ELSE 1.0 END, 0), 1) * 255)::INT AS byte FROM sc_vertices")
R.add("f28_format_map", "sc_images", lambda i: i.join(F.broadcast(i.sparkSession.createDataFrame([(k, *f) for k, f in enumerate(mt.FORMATS)], "format int, gl int, srgb int, vulkan int")), "format").select("image_id", "gl", "srgb", "vulkan"), "SELECT image_id, CASE format WHEN 0 THEN 32849 WHEN 1 THEN 32856 ELSE 33321 END AS gl, CASE format WHEN 0 THEN 35905 WHEN 1 THEN 35907 ELSE 36797 END AS srgb, CASE format WHEN 0 THEN 23 WHEN 1 THEN 37 ELSE 9 END AS vulkan FROM sc_images")
R.add("f29_roughness", "sc_vertices", lambda v: v.select("prim_id", "vi", F.round(mt.roughness(F.col("x")), 6).alias("roughness"), F.round(mt.glossiness(F.col("x") + 1), 6).alias("gloss"), F.round(mt.grey(F.col("u"), F.col("v"), F.col("w")) + 1e-9, 6).alias("grey")), "SELECT prim_id, vi, round(sqrt(2.0 / (2.0 + x)), 6) AS roughness, round(64 * ln(x + 1) / (5 * ln(2.0)), 6) AS gloss, round(0.30 * u + 0.59 * v + 0.11 * w + 1e-9, 6) AS grey FROM sc_vertices")
