"""Tile containers: B3DM and I3DM bytes, GLB chunks, and readers of them and of tilesets.

A container is a header, JSON and binary sections of a feature and a batch table, and a payload, all
numbers little-endian. Sections are padded with blanks so that what follows begins on eight bytes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.session import prepare

HEADER = {b"b3dm": 28, b"i3dm": 32}


def padded_length(n: Column, header: int = 0) -> Column:
    """A section's length with the blanks that bring header and section to a multiple of eight."""
    return (F.ceil((n + header) / 8) * 8 - header).cast("long")


def pad(text: str, header: int = 0) -> bytes:
    raw = text.encode()
    return raw + b" " * (-(len(raw) + header) % 8)


def write_container(magic: bytes, feature: dict, batch: dict | None, payload: bytes, feature_bin: bytes = b"") -> bytes:
    size = HEADER[magic]
    feature_bin += b"\0" * (-len(feature_bin) % 8)
    f, b = pad(json.dumps(feature, separators=(",", ":")), size), pad(json.dumps(batch, separators=(",", ":"))) if batch is not None else b""
    payload += b"\0" * (-len(payload) % 8)
    total = size + len(f) + len(feature_bin) + len(b) + len(payload)
    head = magic + struct.pack("<6I", 1, total, len(f), len(feature_bin), len(b), 0)
    if magic == b"i3dm":
        head += struct.pack("<I", 1)
    return head + f + feature_bin + b + payload


def read_container(data: bytes) -> dict:
    """Sections of a container; raises ValueError for another magic, version or length."""
    magic = data[:4]
    if magic not in HEADER:
        raise ValueError(f"unknown magic {magic!r}")
    version, total, fj, fb, bj, bb = struct.unpack_from("<6I", data, 4)
    if version != 1 or total != len(data):
        raise ValueError("wrong version or length")
    at, parts = HEADER[magic], []
    for n in (fj, fb, bj, bb):
        parts.append(data[at : at + n])
        at += n
    return {"magic": magic.decode(), "feature": parts[0].decode().rstrip(), "feature_bin": parts[1], "batch": parts[2].decode().rstrip(), "batch_bin": parts[3], "payload": data[at:]}


def glb(model: dict, binary: bytes) -> bytes:
    j = json.dumps(model, separators=(",", ":")).encode()
    j += b" " * (-len(j) % 4)
    binary += b"\0" * (-len(binary) % 4)
    chunks = struct.pack("<I4s", len(j), b"JSON") + j + struct.pack("<I4s", len(binary), b"BIN\0") + binary
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks


def write_tiles(tiles: DataFrame) -> DataFrame:
    """tile_id, content: containers of tiles (tile_id, kind, batch_length, xyz array<double>), one row at a time."""
    prepare(tiles.sparkSession)

    def one(kind: str, n: int, xyz) -> bytes:
        raw = struct.pack(f"<{len(xyz)}f", *xyz)
        model = {"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(raw)}]}
        if kind == "i3dm":
            width = ("B", "UNSIGNED_BYTE") if n < 256 else ("H", "UNSIGNED_SHORT") if n < 65536 else ("I", "UNSIGNED_INT")
            ids = struct.pack(f"<{n}{width[0]}", *range(n))
            feature = {"INSTANCES_LENGTH": n, "POSITION": {"byteOffset": 0}, "BATCH_ID": {"byteOffset": len(raw), "componentType": width[1]}}
            return write_container(b"i3dm", feature, {"id": list(range(n))}, glb(model, b""), raw + ids)
        return write_container(b"b3dm", {"BATCH_LENGTH": n}, {"id": list(range(n))}, glb(model, raw))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tile_id": f["tile_id"], "content": [one(*r) for r in zip(f["kind"], f["batch_length"], f["xyz"])]})

    return tiles.select("tile_id", "kind", "batch_length", "xyz").mapInPandas(run, "tile_id long, content binary")


def parse_tiles(files: DataFrame) -> DataFrame:
    """tile_id, magic, feature, batch, payload_bytes and error of containers (tile_id, content)."""
    prepare(files.sparkSession)

    def one(data: bytes) -> tuple:
        try:
            c = read_container(bytes(data))
            return c["magic"], c["feature"], c["batch"], len(c["payload"]), None
        except (ValueError, struct.error) as e:
            return None, None, None, None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([one(c) for c in f["content"]], columns=["magic", "feature", "batch", "payload_bytes", "error"])
            out.insert(0, "tile_id", f["tile_id"].to_numpy())
            out["payload_bytes"] = out["payload_bytes"].astype("Int64")
            yield out

    return files.select("tile_id", "content").mapInPandas(run, "tile_id long, magic string, feature string, batch string, payload_bytes long, error string")


def header_fields(files: DataFrame) -> DataFrame:
    """tile_id, magic, version, bytes: the header read with built-in functions only."""
    word = lambda at: F.conv(F.concat(*[F.lpad(F.hex(F.substring("content", at + 4 - k, 1)), 2, "0") for k in range(1, 5)]), 16, 10).cast("long")
    return files.select("tile_id", F.substring("content", 1, 4).cast("string").alias("magic"), word(5).alias("version"), word(9).alias("bytes"))


def read_binary(spark: SparkSession, path: str, suffix: str = "b3dm") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")


def tileset_json(tiles: DataFrame) -> DataFrame:
    """The JSON of each tile's own record: error, box, refinement and content."""
    record = F.struct(F.struct(F.col("box").alias("box")).alias("boundingVolume"), F.col("geometric_error").alias("geometricError"), F.col("refine"), F.when(F.col("uri").isNotNull(), F.struct("uri")).alias("content"))
    return tiles.select("tile_id", F.to_json(record).alias("json"))


def tileset_tree(tiles: DataFrame) -> DataFrame:
    """One row, json: the nested tileset of a hierarchy (tile_id, parent_id, level, geometric_error), deepest
    levels first. A parent holds its children's text, as the format itself does."""
    levels = sorted((r[0] for r in tiles.select("level").distinct().collect()), reverse=True)
    own = F.concat(F.lit('{"id":'), F.col("tile_id").cast("string"), F.lit(',"geometricError":'), F.col("geometric_error").cast("string"))
    below = None
    for level in levels:
        here = tiles.filter(F.col("level") == level)
        if below is None:
            text = here.select("tile_id", "parent_id", F.concat(own, F.lit("}")).alias("json"))
        else:
            kids = below.groupBy(F.col("parent_id").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_id", "json"))), lambda x: x["json"]), ",").alias("kids"))
            text = here.join(kids, F.col("tile_id") == F.col("_p"), "left").select("tile_id", "parent_id", F.concat(own, F.coalesce(F.concat(F.lit(',"children":['), "kids", F.lit("]")), F.lit("")), F.lit("}")).alias("json"))
        below = text
    return below.select("json")


TREE_ROWS = "tile_id long, parent_id long, geometric_error double"


def read_tileset(texts: DataFrame) -> DataFrame:
    """tile_id, parent_id, geometric_error of nested tilesets (json), children included."""
    prepare(texts.sparkSession)

    def rows(text: str) -> Iterator[tuple]:
        todo = [(json.loads(text), None)]
        while todo:
            t, up = todo.pop()
            yield t["id"], up, float(t["geometricError"])
            todo += [(k, t["id"]) for k in t.get("children", [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["json"]:
                out = pd.DataFrame(list(rows(text)), columns=["tile_id", "parent_id", "geometric_error"])
                out["parent_id"] = out["parent_id"].astype("Int64")
                yield out

    return texts.select("json").mapInPandas(run, TREE_ROWS)
