"""Ear clipping of whole polygons: number of triangles and area."""

import math
from collections import Counter

from scenespark import catalog
from scenespark.operators import mesh

SF = "/root/testdata/sf0.001"


def test_query_clips_whole_polygons(spark):
    got = Counter(r.polygon for r in catalog.queries()["p11_ear_clipping"](spark, SF).select("polygon").collect())
    fan = Counter(r.polygon for r in catalog.queries()["p11_polygon_fan"](spark, SF).select("polygon").collect())
    assert got == fan and max(got.values()) > 6


def test_area_of_concave_polygons(spark):
    rows = []
    for k, n in enumerate((11, 30, 53)):  # star-shaped around the origin, every second corner pulled in
        rows.append((k, [(math.cos(2 * math.pi * i / n) * (1 + i % 2), math.sin(2 * math.pi * i / n) * (1 + i % 2)) for i in range(n)]))
    df = spark.createDataFrame(rows, "polygon long, xy array<struct<x:double,y:double>>")
    tri = mesh.ear_clip(df).collect()
    for k, pts in rows:
        area = lambda ps: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ps, ps[1:] + ps[:1])) / 2
        own = [area([pts[t.i0], pts[t.i1], pts[t.i2]]) for t in tri if t.polygon == k]
        assert len(own) == len(pts) - 2 and all(a > 0 for a in own) and abs(sum(own) - area(pts)) < 1e-9
