"""The columnar model, mesh files, tilesets and trees against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.operators import mesh, model, order, spatial
from scenespark.queries.scene import rounded
from scenespark.sources import containers, gltf


def test_glb_round_trip():
    xyz, uv = np.arange(12.0).reshape(4, 3), np.arange(8.0).reshape(4, 2)
    data = gltf.mesh_glb(xyz, uv, np.array([[0, 1, 2], [0, 2, 3]]))
    back = gltf.read_glb(data)
    assert back["POSITION"].tolist() == xyz.tolist() and back["TEXCOORD_0"].tolist() == uv.tolist() and back["indices"].tolist() == [0, 1, 2, 0, 2, 3]
    size = int.from_bytes(data[12:16], "little")
    told = json.loads(data[20 : 20 + size])
    assert told["accessors"][0]["max"] == [9, 10, 11] and told["meshes"][0]["primitives"][0]["mode"] == 4 and len(data) % 4 == 0
    assert all(v["byteOffset"] % 4 == 0 for v in told["bufferViews"])
    assert len(gltf.read_glb(gltf.mesh_glb(np.zeros((0, 3)), None, np.zeros((0, 3), int)))["indices"]) == 0
    for bad in (b"glTX" + data[4:], containers.glb({}, b"")[:4] + b"\1" + data[5:]):
        with pytest.raises(ValueError):
            gltf.read_glb(bad)


def test_foreign_tileset(spark):
    text = {"asset": {"version": "1.1"}, "geometricError": 9, "root": {"boundingVolume": {"sphere": [0, 0, 0, 1]}, "geometricError": 4, "refine": "add", "children": [{"boundingVolume": {"box": [0] * 12}, "geometricError": 1, "content": {"url": "a.b3dm"}, "children": [{"geometricError": 0}]}, {"geometricError": 0, "refine": "REPLACE"}]}}
    rows = sorted(tuple(r)[:6] for r in gltf.read_tileset(spark.createDataFrame([(json.dumps(text),)], "json string")).collect())
    assert rows == [(0, None, 0, 4.0, "ADD", None), (1, 0, 1, 1.0, "ADD", "a.b3dm"), (2, 1, 2, 0.0, "ADD", None), (3, 0, 1, 0.0, "REPLACE", None)]


def test_options(spark):
    texts = ["ct=draco  vp=3\tunlit", "", " noMergeMesh noMergeMesh=0 x=a=b", None]
    got = [r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select(model.options(F.col("t")).alias("o")).collect()]
    assert got == [{"ct": "draco", "vp": "3", "unlit": "1"}, {}, {"noMergeMesh": "0", "x": "a=b"}, None]


def test_numbered(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    got = {r.k: (r.place, r.before) for r in order.numbered(spark.createDataFrame(rows, "k long, v long").repartition(5), "k", value="v").collect()}
    total = 0
    for place, (k, v) in enumerate(sorted(rows), 1):
        assert got[k] == (place, total)
        total += v
    assert order.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def brute_select(rows, most, calls):
    taken, keys, tri = [], set(), 0
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    for i, _, t, k in rows:
        if tri + t <= most and len(keys | {k}) <= calls:
            taken.append(i)
            keys.add(k)
            tri += t
    return set(taken or [rows[0][0]])


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_greedy_in_rounds(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(i, rnd.randrange(9) / 2.0, rnd.randrange(0, 60), f"k{rnd.randrange(6)}", rnd.randrange(3)) for i in range(90)] + [(900, 1.0, 10**6, "k", 7), (901, 2.0, 10**6, "k", 7)]
    got = spatial.greedy_select(spark.createDataFrame(rows, "id long, radius double, triangles long, key string, cell long"), ("cell",), 300, 3, chunk).collect()
    assert len(got) == len(rows)
    for cell in (0, 1, 2, 7):
        assert {r.id for r in got if r.cell == cell and r.accepted} == brute_select([r[:4] for r in rows if r[4] == cell], 300, 3)


def test_quadtree_against_a_plain_one(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.uniform(0, 8), rnd.uniform(0, 8), rnd.uniform(0, 1), rnd.random(), 10, f"k{i % 4}") for i in range(150)]
    got = {r.id: (r.level, r.x, r.y, r.z) for r in spatial.tree(spark.createDataFrame(rows, "id long, cx double, cy double, cz double, radius double, triangles long, key string"), "quadtree", 2, 100, 20).collect()}
    low, high = [min(r[k] for r in rows) for k in (1, 2)], [max(r[k] for r in rows) for k in (1, 2)]
    want, rest = {}, rows
    for level in range(3):
        n, cells = 1 << level, {}
        for r in rest:
            at = tuple(min(max(int(np.ceil((r[k + 1] - low[k]) / (high[k] - low[k]) * n)) - 1, 0), n - 1) for k in (0, 1))
            cells.setdefault(at, []).append(r)
        rest = []
        for at, own in cells.items():
            took = {r[0] for r in own} if level == 2 else brute_select([(r[0], r[4], r[5], r[6]) for r in own], 100, (level + 1) * 5)
            want |= {i: (level, *at, 0) for i in took}
            rest += [r for r in own if r[0] not in took]
    assert got == want


def test_kd_tree_budgets_and_indices(spark):
    rnd = random.Random(2)
    rows = [(i, *[rnd.uniform(0, 10) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame([(i, x, y, z, 0.1 + i / 1000, 10, f"k{i % 3}", *[v + s * 0.1 for v in (x, y, z) for s in (-1, 1)]) for i, x, y, z in rows], "id long, cx double, cy double, cz double, radius double, triangles long, key string, " + ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max")))
    got = spatial.kd_tree(df, 4, 100, 20).collect()
    assert sorted(r.id for r in got) == list(range(200))
    inner = {}
    for r in got:
        inner.setdefault((r.node, r.level, r.x, r.y, r.z), []).append(r.id)
        assert len(r.node) == r.level and r.x + r.y + r.z == sum(1 << (k % 3) for k, c in enumerate(r.node) if c == "r")
    has_below = lambda n: any(m != n and m.startswith(n) for m, *_ in inner)
    assert all(len(ids) <= 10 for (node, *_), ids in inner.items() if has_below(node)) and len({k[0] for k in inner}) == len(inner)


def test_first_tile_over_levels(spark):
    rnd = random.Random(3)
    pts = [(i, *[rnd.uniform(-50, 50) for _ in range(3)]) for i in range(80)]
    boxes = []
    for i in range(60):
        c, half = [rnd.uniform(-50, 50) for _ in range(3)], rnd.choice([0.0, 0.3, 5.0, 20.0, 300.0 if i == 0 else 9.0])
        boxes.append((i, rnd.randrange(1000) * 100 + i, *[v + s * half for v in c for s in (-1, 1)]))
    cols = ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max"))
    got = {r.instance_id: r.tile_id for r in spatial.first_tile_of(spark.createDataFrame(pts, "instance_id long, cx double, cy double, cz double"), spark.createDataFrame(boxes, f"tile_id long, preorder long, {cols}")).collect()}
    for i, x, y, z in pts:
        inside = [(p, t) for t, p, a, b, c, d, e, f in boxes if a <= x <= b and c <= y <= d and e <= z <= f]
        assert got[i] == (min(inside)[1] if inside else None)


def test_simplified_triangles(spark):
    n = 12
    v = [(1, i * n + j, float(i), float(j), 0.0) for i in range(n) for j in range(n)]
    t = []
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j
            t += [(1, len(t), a, a + 1, a + n), (1, len(t) + 1, a + 1, a + n + 1, a + n)]
    rows = mesh.simplified(spark.createDataFrame(t, "prim_id long, ti long, i0 long, i1 long, i2 long"), spark.createDataFrame(v, "prim_id long, vi long, x double, y double, z double"), 0.5).collect()
    assert 0 < len(rows) <= len(t) // 2 and all(0 <= i < n * n for r in rows for i in (r.i0, r.i1, r.i2)) and all(len({r.i0, r.i1, r.i2}) == 3 for r in rows)
    assert rows[0].before == len(t) and 0 < rows[0].error < 1 and abs(rows[0].diagonal - np.hypot(n - 1, n - 1)) < 1e-9


def test_rounding_as_the_oracle(spark):
    import duckdb

    values = [0.5096415, 0.037024499999999995, 0.2546455, -0.5096415, -0.2546455, 2.5e-7, 5e-7, 0.0, 1e300, 12.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(rounded(F.col("v"))).collect()]
    assert got == [duckdb.sql(f"SELECT round({'NULL' if v is None else repr(v)}::DOUBLE, 6)").fetchall()[0][0] for v in values]


def test_primitives_are_simplified_together(spark, monkeypatch):
    """Small batches cut between primitives, and each is simplified as by itself; one has no triangle, one no extent."""
    monkeypatch.setattr(mesh, "TOGETHER", 40)
    rnd = random.Random(4)
    sizes = {3: 60, 5: 7, 8: 30, 9: 2, 12: 300, 13: 9, 20: 45}
    v = [(k, i, float(rnd.randrange(50)) if k != 13 else 1.0, rnd.random() * 90, 1.0) if k != 13 else (k, i, 1.0, 1.0, 1.0) for k, n in sizes.items() for i in range(n)]
    t = [(k, i // 3, i, i + 1, i + 2) for k, n in sizes.items() for i in range(0, n - 2, 3)]
    frames = lambda vs, ts: (spark.createDataFrame(ts, "prim_id long, ti long, i0 long, i1 long, i2 long").coalesce(1), spark.createDataFrame(vs, "prim_id long, vi long, x double, y double, z double"))
    df = mesh.simplified(*frames(v, t), 0.5)
    assert "CoGroup" not in df._jdf.queryExecution().toString()  # a Python call for each primitive
    rows = df.collect()
    for k in sizes:
        got = sorted(tuple(r) for r in rows if r.prim_id == k)
        of, p = np.zeros(sizes[k], int), np.array([r[2:] for r in v if r[0] == k])
        own = np.array([r[2:] for r in t if r[0] == k], int).reshape(-1, 3)
        q, left, error, span = mesh.clustered(of, p, np.zeros(len(own), int), own, 1, 0.5)
        want = [(k, i, *map(int, c), error[0], len(own), span[0]) for i, c in enumerate(q[left])] or [(k, -1, -1, -1, -1, error[0], len(own), span[0])]
        assert got == want
    assert [r.ti for r in rows if r.prim_id == 9] == [-1] and sum(r.prim_id == 13 for r in rows) == 3
    with pytest.raises(Exception, match="corner that is not among"):
        mesh.simplified(*frames(v[:3], [(3, 0, 0, 1, 7)]), 0.5).collect()


def test_first_tile_in_rounds(spark, monkeypatch):
    """Centres that found a tile leave after the round; equal centres, boxes and preorders."""
    monkeypatch.setattr(spatial, "FIRST_TILES", 4)
    monkeypatch.setattr(spatial, "MORE_TILES", 2)
    met, inner = [], spatial._first_hits
    monkeypatch.setattr(spatial, "_first_hits", lambda p, t: (met.append((p.count(), t.count())), inner(p, t))[1])
    rnd = random.Random(6)
    pts = [(i, float(i % 26), 1.0, 2.0) for i in range(78)]
    boxes = [(i, (i * 7 % 40) // 2, *[v + s * 4.0 for v in (float(rnd.randrange(16)), 1.0, 2.0 + i % 9) for s in (-1, 1)]) for i in range(40)]
    cols = ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max"))
    got = {r.instance_id: r.tile_id for r in spatial.first_tile_of(spark.createDataFrame(pts, "instance_id long, cx double, cy double, cz double"), spark.createDataFrame(boxes, f"tile_id long, preorder long, {cols}")).collect()}
    for i, x, y, z in pts:
        inside = [(p, t) for t, p, a, b, c, d, e, f in boxes if a <= x <= b and c <= y <= d and e <= z <= f]
        assert got[i] == (min(inside)[1] if inside else None)
    assert None in got.values() and len(met) > 2 and met[0][0] == 26 and met[-1][0] < 20
