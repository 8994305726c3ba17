"""Hand-computed micro fixtures and invariants."""

import json
import math

from pyspark.sql import functions as F

from scenespark.functions import linalg as la
from scenespark.operators import anim, gltf, lod, materials, mesh, metrics, pack, scene, spatial, transforms
from scenespark.sources import containers


def test_mode_counts(spark):
    modes = {"TRIANGLES": 3, "TRIANGLE_STRIP": 8, "TRIANGLE_FAN": 8, "POLYGON": 8, "QUADS": 4, "QUAD_STRIP": 10, "POINTS": 0}
    df = spark.createDataFrame([(m, 10) for m in modes], "mode string, n int")
    assert {r.mode: r.t for r in df.select("mode", metrics.triangles_of(F.col("mode"), F.col("n")).alias("t")).collect()} == modes


def test_cube(spark):
    rows = [(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2), 0.0, 0.0) for i in range(8)]
    v = spark.createDataFrame(rows, "prim_id long, vi long, x double, y double, z double, u double, v double")
    faces = [(0, 1, 3), (0, 3, 2), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 3, 7), (1, 7, 5)]
    t = spark.createDataFrame([(1, k, *f) for k, f in enumerate(faces)], "prim_id long, ti long, i0 long, i1 long, i2 long")
    box = metrics.boxes(v).select(metrics.diagonal().alias("d"), metrics.volume().alias("v")).first()
    assert round(box.d, 6) == 1.732051 and box.v == 1.0
    assert metrics.surface_areas(metrics.with_corners(t, v, ("x", "y", "z", "u", "v"))).first().area == 6.0


def test_draw_calls(spark):
    df = spark.createDataFrame([("g", "A", "s1", False), ("g", "A", "s1", False), ("g", "A", "s2", True), ("g", "B", "s1", False)], "g string, matrix_key string, state_key string, repeats boolean")
    assert metrics.draw_calls(df, ("g",)).first().draw_calls == 3


def test_degenerate_and_strip(spark):
    t = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 1, 2), (1, 2, 3, 4, 3)], "prim_id long, ti long, i0 long, i1 long, i2 long")
    assert [r.ti for r in mesh.without_degenerate(t).collect()] == [0]
    s = mesh.triangulate(spark.createDataFrame([(1, "TRIANGLE_STRIP", 5)], "prim_id long, mode string, n long"))
    assert sorted((r.i0, r.i1, r.i2) for r in s.collect()) == [(0, 1, 2), (1, 3, 2), (2, 3, 4)]


def test_quad_split(spark):
    quads = {"convex": ([(0, 0), (1, 0), (1, 1), (0, 1)], True), "reflex2": ([(0, 0), (1, 0), (0.2, 0.2), (0, 1)], True), "reflex1": ([(0, 1), (0.8, 0.8), (1, 0), (1, 1)], False)}
    for pts, want in quads.values():
        p = [tuple(F.lit(float(c)) for c in (*q, 0)) for q in pts]
        assert spark.range(1).select(mesh.quad_split_02(*p).alias("s")).first().s is want


def test_ear_clipping(spark):
    poly = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])], "polygon long, xy array<struct<x:double,y:double>>")
    assert mesh.ear_clip(poly).count() == 3


def test_asof(spark):
    k = spark.createDataFrame([(1, "X", 0.0, 1.0), (1, "X", 2.0, 3.0), (1, "Y", 1.0, 10.0)], "target long, axis string, t double, value double")
    got = sorted(tuple(r) for r in anim.forward_asof(k, ("X", "Y", "Z"), defaults={"Z": 5.0}).collect())
    assert got == [(1, 0.0, 1.0, 10.0, 5.0), (1, 1.0, 3.0, 10.0, 5.0), (1, 2.0, 3.0, 10.0, 5.0)]


def test_control_point_shift(spark):
    k = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "c", "d"), (1, 2, "e", "f")], "g long, i long, cp_in string, cp_out string")
    got = [(r.new_in, r.new_out) for r in anim.shifted_control_points(k, ("g",), "i").orderBy("i").collect()]
    assert got == [("b", "c"), ("d", "e"), ("f", "a")]


def test_offsets(spark):
    v = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 7)], "g long, i long, n long")
    assert [r.offset for r in gltf.aligned_offsets(v, ("g",), "i", "n").orderBy("i").collect()] == [0, 8, 12]
    c = spark.createDataFrame([(1, 0, 4), (1, 1, 3), (1, 2, 6)], "g long, i long, n long")
    assert [r.base for r in mesh.base_vertices(c, ("g",), "i", "n").orderBy("i").collect()] == [0, 4, 7]


def test_compaction(spark):
    v = spark.createDataFrame([(1, i) for i in range(6)], "prim_id long, vi long")
    t = spark.createDataFrame([(1, 0, 1, 4, 5)], "prim_id long, ti long, i0 long, i1 long, i2 long")
    got = {r.vi: r.new_vi for r in mesh.compact_ids(mesh.used_vertices(v, t)).collect()}
    assert got == {1: 0, 4: 1, 5: 2}


def test_box12(spark):
    b = spark.createDataFrame([(0.0, 2.0, 0.0, 4.0, 0.0, 6.0)], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    assert b.select(lod.box12().alias("b")).first().b == [1, -3, 2, 1, 0, 0, 0, -3, 0, 0, 0, 2]


def test_errors(spark):
    row = spark.range(1).select(lod.error_of_pixels(F.lit(25.0), F.lit(1.0)).alias("p"), lod.error_at(F.lit(100.0)).alias("d")).first()
    assert round(row.p, 6) == 1.314773 and round(row.d, 6) == 0.986924
    p = {r.lod: r for r in lod.parameters(spark.createDataFrame([(1, 10.0)], "tile_id long, diagonal double")).collect()}
    assert (p[2].sample_ratio, p[2].target_error) == (0.25, 0.3) and (p[1].sample_ratio, round(p[1].target_error, 9)) == (0.5, 0.06) and p[0].target_error == 0.001
    kids = spark.createDataFrame([(1, 2.0, 1.0, 1.0), (1, 4.0, 3.0, 1.0), (2, 1.0, 1.0, 1.0)], "parent_id long, error double, volume double, own double")
    assert {r.parent_id: round(r.geometric_error, 6) for r in lod.tile_error(kids).collect()} == {1: 3.5, 2: 1.1}


def test_encodings(spark):
    q = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double").select("v", gltf.quantise(F.col("v"), F.lit(14)).alias("q")).orderBy("v").collect()
    assert [r.q for r in q] == [0, 8192, 16383]
    o = spark.range(1).select(*[x.alias(n) for x, n in zip((*gltf.octahedral((F.lit(0.0), F.lit(0.0), F.lit(1.0))), *gltf.octahedral((F.lit(1.0), F.lit(0.0), F.lit(0.0)))), "abcd")]).first()
    assert tuple(o) == (0, 0, 127, 0)
    assert spark.range(1).select(materials.luma(F.lit(255), F.lit(0), F.lit(0)).alias("l")).first().l == 76
    m = spark.range(1).select(materials.mips(F.lit(8), F.lit(2)).alias("m")).first().m
    assert [(x.w, x.h) for x in m] == [(8, 2), (4, 1), (2, 1), (1, 1)]
    s = spark.createDataFrame([([0.3] * 64,)], "p array<double>").select(materials.sobel(F.col("p")).alias("s")).first().s
    assert {(x.nx, x.ny, x.nz) for x in s} == {(0.5, 0.5, 1.0)}
    assert spark.range(1).select(containers.padded_length(F.lit(41), 28).alias("n")).first().n == 44
    w = spark.createDataFrame([(255,), (256,), (65536,)], "n int").select(gltf.index_width(F.col("n")).alias("w")).collect()
    assert [r.w for r in w] == ["u8", "u16", "u32"]


def test_valid_tree(spark):
    t = spark.createDataFrame([(1, None, 5.0), (2, 1, 0.0), (3, 1, 0.0), (4, None, 5.0), (5, 4, 2.0), (6, None, 3.0), (7, 6, 3.0)], "tile_id long, parent_id long, geometric_error double")
    assert {r.tile_id: r.valid for r in scene.valid_tree(t).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}


def test_geodesy(spark):
    lng, lat, alt = F.lit(12.5), F.lit(41.9), F.lit(100.0)
    got = spark.range(1).select(*[x.alias(n) for x, n in zip(transforms.geodetic(transforms.ecef(lng, lat, alt)), ("a", "b", "c"))]).first()
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, (12.5, 41.9, 100.0)))


def test_matrices(spark):
    m = la.multiply(la.translation(1, 2, 3), la.scaling(2, 2, 2))
    assert spark.range(1).select(m.alias("m")).first().m[12:15] == [2.0, 4.0, 6.0]


def test_containers():
    data = containers.write_container(b"b3dm", {"BATCH_LENGTH": 2}, {"id": [0, 1]}, containers.glb({"asset": {"version": "2.0"}}, b"abc"))
    back = containers.read_container(data)
    assert len(data) % 8 == 0 and json.loads(back["feature"]) == {"BATCH_LENGTH": 2} and back["payload"][:4] == b"glTF"
    for bad in (b"nope" + data[4:], data[:-1]):
        try:
            containers.read_container(bad)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_trees_place_every_object_once(spark):
    rows = [(i, float(i * 37 % 101), float(i * 13 % 53), float(i * 7 % 11), float(i % 9), 10 + i % 40, f"k{i % 6}") for i in range(300)]
    o = spark.createDataFrame(rows, "id long, cx double, cy double, cz double, radius double, triangles long, key string")
    for kind in ("quadtree", "octree"):
        got = spatial.tree(o, kind, 4, 400, 20).join(o, "id").collect()
        assert sorted(r.id for r in got) == list(range(300))
        tiles: dict = {}
        for r in got:
            tiles.setdefault((r.level, r.x, r.y, r.z), []).append(r)
        for (level, *_), members in tiles.items():
            assert level == 4 or len(members) == 1 or (sum(r.triangles for r in members) <= 400 and len({r.key for r in members}) <= spatial.draw_call_budget(level, 20))
    boxed = o.select("*", *[(F.col(f"c{a}") + s).alias(f"{n}_{a}") for a in "xyz" for n, s in (("min", -1), ("max", 1))])
    assert sorted(r.id for r in spatial.kd_tree(boxed, 4, 30).collect()) == list(range(300))


def test_packing_does_not_overlap(spark):
    rows = [(1, i, 8 + i * 7 % 60, 8 + i * 13 % 50) for i in range(60)] + [(1, 99, 500, 5)]
    got = pack.skyline_pack(spark.createDataFrame(rows, "atlas_key long, image_id long, w int, h int"), 128, 128).collect()
    assert len(got) == 61 and [r.image_id for r in got if r.atlas is None] == [99]
    placed = [r for r in got if r.atlas is not None]
    for i, a in enumerate(placed):
        assert 0 <= a.x and a.x + a.w <= 128 and a.y + a.h <= 128
        for b in placed[i + 1 :]:
            assert a.atlas != b.atlas or a.x + a.w <= b.x or b.x + b.w <= a.x or a.y + a.h <= b.y or b.y + b.h <= a.y


def test_simplify_keeps_the_ratio(spark):
    n = 12
    v = [(1, i * n + j, float(i), float(j), math.sin(i + j)) for i in range(n) for j in range(n)]
    t = [(1, k, *q) for k, q in enumerate((a, b, c) for i in range(n - 1) for j in range(n - 1) for a, b, c in ((i * n + j, i * n + j + 1, (i + 1) * n + j), (i * n + j + 1, (i + 1) * n + j + 1, (i + 1) * n + j)))]
    row = mesh.simplify(spark.createDataFrame(t, "prim_id long, ti long, i0 long, i1 long, i2 long"), spark.createDataFrame(v, "prim_id long, vi long, x double, y double, z double"), 0.5).first()
    assert row.after <= 0.5 * row.before and row.error > 0
