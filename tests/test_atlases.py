"""Every image reaches the atlas packers."""

import random

from scenespark import catalog
from scenespark.operators import pack

SF = "/root/testdata/sf0.001"


def test_all_images_are_packed_or_reported(spark):
    q = catalog.queries()
    rows = q["o6_pack"](spark, SF).collect()
    filled = q["o5_atlas_fill"](spark, SF).collect()
    assert any(r.w > 256 or r.h > 256 for r in rows if r.atlas is not None)
    assert all((r.atlas is None) == (r.w > 512 or r.h > 512) for r in rows)
    area = {r.image_id: r.w * r.h for r in rows}
    assert len(rows) == len(area) and sorted(r.image_id for r in filled) == sorted(area)
    assert all((r.atlas is None) == (area[r.image_id] > 256 * 256) for r in filled)


def test_greedy_fill_in_one_pass(spark):
    rnd = random.Random(1)
    rows = [(k, n, rnd.randrange(1, 40), rnd.randrange(1, 40)) for n in range(5000) for k in (rnd.randrange(3),)] + [(7, 9000, 60, 60), (7, 9001, None, 3), (7, 9002, 1, 1)]
    df = pack.greedy_fill(spark.createDataFrame(rows, "key long, image_id long, w int, h int"), ("key",), 1600)
    assert "collect_list" not in df._jdf.queryExecution().toString()  # no row holds all images of a key
    got = {r.image_id: (r.key, r.atlas) for r in df.collect()}
    want, state = {}, {}
    for k, i, w, h in sorted(rows, key=lambda r: (-r[3], -(r[2] or 0), r[1])):
        atlas, used = state.get(k, (0, 0))
        if w is None or w * h > 1600:
            want[i] = (k, None)
            continue
        state[k] = (atlas, used + w * h) if used + w * h <= 1600 else (atlas + 1, w * h)
        want[i] = (k, state[k][0])
    assert got == want
