"""GLB files with meshes, I3DM instance tables and tilesets in the published formats, both ways."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark.session import prepare
from scenespark.sources.containers import glb, read_container, write_container

# Component types of the format and their numpy names: fixed values.
KINDS = {5121: "<u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3}


def mesh_glb(xyz: np.ndarray, uv: np.ndarray | None, triangles: np.ndarray) -> bytes:
    """One mesh as a GLB: positions, texture coordinates if any, batch ids and indices of the narrowest width."""
    n = len(xyz)
    width = 5121 if n <= 255 else 5123 if n <= 65535 else 5125
    parts = [("POSITION", xyz.astype("<f4"), 5126, "VEC3")] + ([("TEXCOORD_0", uv.astype("<f4"), 5126, "VEC2")] if uv is not None else [])
    parts += [("_BATCHID", np.arange(n, dtype="<f4"), 5126, "SCALAR"), ("indices", triangles.reshape(-1).astype(KINDS[width]), width, "SCALAR")]
    raw, views, found, names = b"", [], [], {}
    for name, data, kind, shape in parts:
        names[name] = len(found)
        views.append({"buffer": 0, "byteOffset": len(raw), "byteLength": data.nbytes, "target": 34963 if name == "indices" else 34962})
        one = {"bufferView": len(found), "componentType": kind, "type": shape, "count": len(data)}
        if shape != "SCALAR" and n:
            one |= {"min": data.min(0).tolist(), "max": data.max(0).tolist()}
        found.append(one)
        raw += data.tobytes() + b"\0" * (-data.nbytes % 4)
    primitive = {"attributes": {k: v for k, v in names.items() if k != "indices"}, "indices": names["indices"], "mode": 4}
    model = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [primitive]}], "accessors": found, "bufferViews": views, "buffers": [{"byteLength": len(raw)}]}
    return glb(model, raw)


def read_glb(data: bytes) -> dict[str, np.ndarray]:
    """The attributes and indices of a GLB's first primitive; raises ValueError for another file."""
    magic, version, total = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or total > len(data):
        raise ValueError("no GLB of version 2")
    size, kind = struct.unpack_from("<I4s", data, 12)
    if kind != b"JSON":
        raise ValueError("the first chunk is not JSON")
    model, at = json.loads(data[20 : 20 + size]), 20 + size + 8

    def values(k: int) -> np.ndarray:
        a = model["accessors"][k]
        v, parts = model["bufferViews"][a["bufferView"]], SHAPES[a["type"]]
        out = np.frombuffer(data, KINDS[a["componentType"]], a["count"] * parts, at + v.get("byteOffset", 0) + a.get("byteOffset", 0))
        return out.reshape(-1, parts) if parts > 1 else out

    p = model["meshes"][0]["primitives"][0]
    return {**{k: values(i) for k, i in p["attributes"].items()}, "indices": values(p["indices"])}


WRITE = "tile_id long, content binary"


def write_meshes(tiles: DataFrame) -> DataFrame:
    """tile_id, content: a B3DM with one mesh for each tile (tile_id, xyz, uv or null: flat arrays in vertex order;
    every three vertices are a triangle). A tile is one row, bounded by the tiling."""
    prepare(tiles.sparkSession)

    def one(xyz, uv) -> bytes:
        p = np.array(xyz, float).reshape(-1, 3)
        t = np.arange(len(p) // 3 * 3).reshape(-1, 3)
        return write_container(b"b3dm", {"BATCH_LENGTH": len(p)}, {"id": list(range(len(p)))}, mesh_glb(p, None if uv is None else np.array(uv, float).reshape(-1, 2), t))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tile_id": f["tile_id"], "content": [one(a, b) for a, b in zip(f["xyz"], f["uv"])]})

    return tiles.select("tile_id", "xyz", "uv").mapInPandas(run, WRITE)


READ = "tile_id long, vi long, x double, y double, z double, u double, v double, triangles long"


def read_meshes(files: DataFrame) -> DataFrame:
    """The vertices of the meshes in B3DM files (tile_id, content): the payload taken out of its container and parsed."""
    prepare(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile, content in zip(f["tile_id"], f["content"]):
                mesh = read_glb(read_container(bytes(content))["payload"])
                p, uv = mesh["POSITION"].astype(float), mesh.get("TEXCOORD_0")
                out = pd.DataFrame({"tile_id": tile, "vi": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
                out["u"], out["v"] = (uv[:, 0].astype(float), uv[:, 1].astype(float)) if uv is not None else (None, None)
                yield out.assign(triangles=len(mesh["indices"]) // 3).astype({"u": float, "v": float})

    return files.select("tile_id", "content").mapInPandas(run, READ)


TABLE = (("POSITION", ("x", "y", "z")), ("NORMAL_UP", ("up_x", "up_y", "up_z")), ("NORMAL_RIGHT", ("right_x", "right_y", "right_z")), ("SCALE_NON_UNIFORM", ("sx", "sy", "sz")))
COLUMNS = tuple(c for _, cs in TABLE for c in cs)


def instance_tables(instances: DataFrame) -> DataFrame:
    """tile_id, content: I3DM files from instances (tile_id, batch_id, and position, up, right and scale as COLUMNS).

    Batch ids are written as narrowly as their number allows. One tile's instances are one group, bounded by the
    tiler's division of instances."""
    prepare(instances.sparkSession)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("batch_id")
        n, raw, feature = len(f), b"", {"INSTANCES_LENGTH": len(f)}
        for name, cols in TABLE:
            feature[name] = {"byteOffset": len(raw)}
            raw += f[list(cols)].to_numpy("<f4").tobytes()
        kind, label = ("<u1", "UNSIGNED_BYTE") if n < 256 else ("<u2", "UNSIGNED_SHORT") if n < 65536 else ("<u4", "UNSIGNED_INT")
        feature["BATCH_ID"] = {"byteOffset": len(raw), "componentType": label}
        raw += np.arange(n).astype(kind).tobytes()
        return pd.DataFrame({"tile_id": [int(key[0])], "content": [write_container(b"i3dm", feature, {"id": f["batch_id"].astype(int).tolist()}, glb({"asset": {"version": "2.0"}}, b""), raw)]})

    return instances.select("tile_id", "batch_id", *COLUMNS).groupBy("tile_id").applyInPandas(run, WRITE)


def read_instances(files: DataFrame) -> DataFrame:
    """The instances of I3DM files (tile_id, content): tile_id, batch_id and COLUMNS."""
    prepare(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile, content in zip(f["tile_id"], f["content"]):
                c = read_container(bytes(content))
                feature, raw = json.loads(c["feature"]), c["feature_bin"]
                n, out = feature["INSTANCES_LENGTH"], {"tile_id": tile, "batch_id": json.loads(c["batch"])["id"]}
                for name, cols in TABLE:
                    values = np.frombuffer(raw, "<f4", 3 * n, feature[name]["byteOffset"]).reshape(-1, 3).astype(float)
                    out |= {k: values[:, j] for j, k in enumerate(cols)}
                yield pd.DataFrame(out)

    return files.select("tile_id", "content").mapInPandas(run, f"tile_id long, batch_id long, {', '.join(f'{c} double' for c in COLUMNS)}")


def tileset(tiles: DataFrame) -> DataFrame:
    """One row, json: a tileset of a hierarchy (tile_id, parent_id, level, box array<double>, geometric_error, refine,
    uri or null), from the deepest level up. The text of a tile holds its children's, as the format demands."""
    levels = sorted((r[0] for r in tiles.select("level").distinct().collect()), reverse=True)
    own = F.to_json(F.struct(F.struct("box").alias("boundingVolume"), F.col("geometric_error").cast("double").alias("geometricError"), "refine", F.when(F.col("uri").isNotNull(), F.struct("uri")).alias("content"), F.struct(F.col("tile_id").alias("id")).alias("extras")))
    open_ = F.substring(own, F.lit(1), F.length(own) - 1)
    below = None
    for level in levels:
        text = tiles.filter(F.col("level") == level)
        kids = F.lit("")
        if below is not None:
            rows = F.array_sort(F.collect_list(F.struct("tile_id", "json")))
            text = text.join(below.groupBy(F.col("parent_id").alias("__up")).agg(F.array_join(F.transform(rows, lambda r: r["json"]), ",").alias("__kids")), F.col("tile_id") == F.col("__up"), "left")
            kids = F.coalesce(F.concat(F.lit(',"children":['), F.col("__kids"), F.lit("]")), F.lit(""))
        below = text.select("tile_id", "parent_id", F.col("geometric_error").cast("double").alias("error"), F.concat(open_, kids, F.lit("}")).alias("json"))
    root = F.concat(F.lit('{"asset":{"version":"1.0"},"geometricError":'), F.to_json(F.array("error")).substr(F.lit(2), F.length(F.to_json(F.array("error"))) - 2), F.lit(',"root":'), F.col("json"), F.lit("}"))
    return below.select(root.alias("json"))


TILES = "tile_id long, parent_id long, level int, geometric_error double, refine string, uri string, box array<double>"


def read_tileset(texts: DataFrame) -> DataFrame:
    """The tiles of tilesets (json), children included. A tile's number is extras.id or, where a file has none, its place
    in pre-order; refinement is inherited; of the content's url and uri either counts; only boxes are read as volumes."""
    prepare(texts.sparkSession)

    def rows(text: str) -> Iterator[tuple]:
        todo, count = [(json.loads(text)["root"], None, 0, None)], 0
        while todo:
            t, up, level, refine = todo.pop()
            own = (t.get("extras") or {}).get("id", count)
            refine, content = (t.get("refine") or refine or "REPLACE").upper(), t.get("content") or {}
            yield own, up, level, float(t["geometricError"]), refine, content.get("uri", content.get("url")), (t.get("boundingVolume") or {}).get("box")
            count += 1
            todo += [(k, own, level + 1, refine) for k in reversed(t.get("children", []))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["json"]:
                out = pd.DataFrame(list(rows(text)), columns=["tile_id", "parent_id", "level", "geometric_error", "refine", "uri", "box"])
                yield out.astype({"parent_id": "Int64"})

    return texts.select("json").mapInPandas(run, TILES)
