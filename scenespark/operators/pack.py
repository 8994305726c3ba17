"""Texture atlases: greedy choice by area and skyline packing. Both are sequential within one atlas;
atlases are bounded in size, so a group is the images of one key, packed into as many atlases as needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.session import prepare


def greedy_fill(images: DataFrame, by: tuple[str, ...], area: int) -> DataFrame:
    """by, image_id, atlas: images (w, h) in order of height and width go into the open atlas while its area
    lasts; what does not fit opens the next one. Images larger than the area, or of unknown size, get no atlas (null).

    One pass over the sorted images of a key, of which only the open atlas is remembered: a key may have any number
    of images, and their time is in proportion."""
    prepare(images.sparkSession)
    schema = T.StructType([*[images.schema[c] for c in by], T.StructField("image_id", T.LongType()), T.StructField("atlas", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, atlas, used = None, 0, 0
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(by))])) if by else [()] * batch.num_rows
            out = []
            for own, w, h in zip(keys, batch.column("w").to_pylist(), batch.column("h").to_pylist()):
                if own != key:
                    key, atlas, used = own, 0, 0
                if w is None or h is None or w * h > area:
                    out.append(None)
                    continue
                atlas, used = (atlas, used + w * h) if used + w * h <= area else (atlas + 1, w * h)
                out.append(atlas)
            columns = [batch.column(k) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("image_id"), pa.array(out, pa.int32())], schema.names)

    rows = images.select(*by, F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("long").alias(c) for c in "wh"])
    placed = rows.repartition(*by) if by else rows.repartition(1)
    return placed.sortWithinPartitions(*by, F.desc("h"), F.desc("w"), "image_id").mapInArrow(run, schema)


PACKED = "atlas_key long, image_id long, atlas int, x int, y int, w int, h int"


def skyline_pack(images: DataFrame, width: int, height: int) -> DataFrame:
    """Places (atlas_key, image_id, w, h) without overlap; images larger than an atlas are left out of it
    (atlas null). Lowest place first, leftmost on ties."""
    prepare(images.sparkSession)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out, atlas, sky = [], 0, [(0, 0, width)]
        for w, h, i in sorted(zip(f["w"], f["h"], f["image_id"]), key=lambda r: (-r[1], -r[0], r[2])):
            if w > width or h > height:
                out.append((key[0], i, None, None, None, w, h))
                continue
            while True:
                best = None
                for k, (x, _, _) in enumerate(sky):
                    if x + w > width:
                        break
                    y = max(t for s, t, n in sky if s < x + w and s + n > x)
                    if y + h <= height and (best is None or (y, x) < best):
                        best = (y, x)
                if best is not None:
                    break
                atlas, sky = atlas + 1, [(0, 0, width)]
            y, x = best
            out.append((key[0], i, atlas, x, y, w, h))
            cut = []
            for s, t, n in sky:
                if s < x:
                    cut.append((s, t, min(n, x - s)))
                if s + n > x + w:
                    a = max(s, x + w)
                    cut.append((a, t, s + n - a))
            sky = sorted([*cut, (x, y + h, w)])
        r = pd.DataFrame(out, columns=["atlas_key", "image_id", "atlas", "x", "y", "w", "h"])
        return r.astype({"atlas": "Int32", "x": "Int32", "y": "Int32"})

    return images.groupBy("atlas_key").applyInPandas(run, PACKED)


def atlas_json(packed: DataFrame) -> DataFrame:
    """atlas_key, atlas and the JSON of its places."""
    place = F.array_sort(F.collect_list(F.struct("image_id", "x", "y", "w", "h")))
    return packed.filter("atlas IS NOT NULL").groupBy("atlas_key", "atlas").agg(F.to_json(place).alias("json"))
