"""The columnar model of a scene: accessors, buffer views and buffers, their merging, removal and quantisation.

Primitives are (prim_id, n, owner, material_id) with an attribute set; an accessor is one attribute of one
primitive; its values' bytes lie in a view, views behind each other in a buffer, each on four bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.operators.gltf import aligned, aligned_offsets

# Component types, their bytes, and components of element types: fixed values of the format.
COMPONENTS = {5121: 1, 5123: 2, 5125: 4, 5126: 4}
SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3}
FLOAT, BYTE, SHORT, INT = 5126, 5121, 5123, 5125
#: slot, attribute, element type.
ATTRIBUTES = ((0, "POSITION", "VEC3"), (1, "TEXCOORD_0", "VEC2"), (2, "_BATCHID", "SCALAR"), (3, "indices", "SCALAR"))


def _known(column: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]


def index_component(count: Column) -> Column:
    """The narrowest component type of indices below count."""
    return F.when(count <= 255, BYTE).when(count <= 65535, SHORT).otherwise(INT)


def accessors(vertices: DataFrame, primitives: DataFrame) -> DataFrame:
    """prim_id, slot, attribute, type, component, count, min, max, bytes of every attribute that a primitive has.

    vertices: prim_id, vi, x, y, z, u, v; primitives: prim_id, textured. Only POSITION and TEXCOORD_0 have bounds;
    values that are not a number don't count for them."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    sizes = vertices.groupBy("prim_id").agg(F.count("*").alias("count"), *[f(real(c)).alias(f"{n}_{c}") for c in "xyzuv" for n, f in (("min", F.min), ("max", F.max))])
    none = F.lit(None).cast("array<double>")
    rows = []
    for slot, name, shape in ATTRIBUTES:
        axes = {"POSITION": "xyz", "TEXCOORD_0": "uv"}.get(name)
        bounds = [F.array(*[F.col(f"{n}_{a}") for a in axes]) if axes else none for n in ("min", "max")]
        component = index_component(F.col("count")) if name == "indices" else F.lit(FLOAT)
        row = F.struct(F.lit(slot).alias("slot"), F.lit(name).alias("attribute"), F.lit(shape).alias("type"), component.alias("component"), bounds[0].alias("min"), bounds[1].alias("max"))
        rows.append(F.when(F.col("textured"), row) if name == "TEXCOORD_0" else row)
    every = sizes.join(primitives, "prim_id").select("prim_id", "count", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("a")).select("prim_id", "a.slot", "a.attribute", "a.type", "a.component", "count", "a.min", "a.max")
    return every.withColumn("bytes", F.col("count") * _known(F.col("type"), SHAPES) * _known(F.col("component"), COMPONENTS))


def views(found: DataFrame, buffer: str = "buffer_id") -> DataFrame:
    """buffer_id, prim_id, slot, view_id (from 0 in its buffer), offset, bytes: one view for each accessor."""
    placed = aligned_offsets(found.withColumn("__at", F.struct("prim_id", "slot")), (buffer,), "__at", "bytes")
    return placed.select(buffer, "prim_id", "slot", (F.row_number().over(Window.partitionBy(buffer).orderBy("__at")) - 1).cast("long").alias("view_id"), "offset", "bytes")


def buffers(of: DataFrame, buffer: str = "buffer_id") -> DataFrame:
    return of.groupBy(buffer).agg(F.sum(aligned(F.col("bytes"))).cast("long").alias("buffer_bytes"))


def dereference(found: DataFrame, of: DataFrame, whole: DataFrame, buffer: str = "buffer_id") -> DataFrame:
    """Accessors with their view's place and their buffer's length: accessor to view to buffer."""
    return found.join(of.drop("bytes"), ["prim_id", "slot"]).join(whole, buffer)


def shared_views(found: DataFrame, content: Column) -> DataFrame:
    """prim_id, slot, owner: accessors of equal content share the view of the smallest primitive that has it.

    The content is compared by a 256-bit digest together with what the accessor says of it."""
    key = ["slot", "type", "component", "count", "__digest"]
    rows = found.withColumn("__digest", F.sha2(content, 256))
    first = rows.groupBy(*key).agg(F.min("prim_id").alias("owner"))
    return rows.join(first, key).select("prim_id", "slot", "owner")


def without_views(of: DataFrame, removed: Column, buffer: str = "buffer_id") -> DataFrame:
    """The views that stay, with view_id closed up (new_id) and the bytes moved up (new_offset)."""
    rows = of.withColumn("__gone", removed)
    w = Window.partitionBy(buffer).orderBy("view_id").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda v: F.coalesce(F.sum(F.when(F.col("__gone"), v).otherwise(0)).over(w), F.lit(0)).cast("long")
    moved = rows.select(*of.columns, "__gone", (F.col("view_id") - gone(F.lit(1))).alias("new_id"), (F.col("offset") - gone(aligned(F.col("bytes")))).alias("new_offset"))
    return moved.filter("NOT __gone").drop("__gone")


def quantisable(found: DataFrame) -> DataFrame:
    """prim_id, position, texcoord: whether the accessors have the bounds that quantisation needs (no accessor, no)."""
    has = lambda name, n: F.coalesce(F.bool_or((F.col("attribute") == name) & (F.size("min") == n) & (F.size("max") == n)), F.lit(False))
    return found.groupBy("prim_id").agg(has("POSITION", 3).alias("position"), has("TEXCOORD_0", 2).alias("texcoord"))


def merge_groups(found: DataFrame, primitives: DataFrame) -> DataFrame:
    """prim_id, group_id, attributes: primitives of one world matrix, material and set of attribute names; a group is
    named by its smallest primitive.

    primitives: prim_id, matrix (array of 16 doubles), material_id."""
    sets = found.groupBy("prim_id").agg(F.array_join(F.array_sort(F.collect_list("attribute")), ",").alias("attributes"))
    keyed = primitives.join(sets, "prim_id")
    key = ["matrix", "material_id", "attributes"]
    first = keyed.groupBy(*key).agg(F.min("prim_id").alias("group_id"))
    return keyed.join(first, key).select("prim_id", "group_id", "attributes")


def same_matrix(rows: DataFrame, ident: str) -> DataFrame:
    """ident, first_id, n: rows of one matrix under its smallest ident, and how many they are."""
    first = rows.groupBy("matrix").agg(F.min(ident).alias("first_id"), F.count("*").alias("n"))
    return rows.join(first, "matrix").select(ident, "first_id", "n")


def compatible(found: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, compatible: whether all members agree, attribute by attribute, in component, shape and stride, and have
    positions. Indices may differ in width: merging writes them anew."""
    stride = _known(F.col("type"), SHAPES) * _known(F.col("component"), COMPONENTS)
    kinds = found.filter("attribute <> 'indices'").join(groups.select("prim_id", "group_id"), "prim_id").groupBy("group_id", "attribute").agg(F.count_distinct("component", "type", stride).alias("kinds"))
    return kinds.groupBy("group_id").agg(((F.max("kinds") == 1) & F.bool_or(F.col("attribute") == "POSITION")).alias("compatible"))


def merged(found: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged accessors (group_id, attribute, type, component, count, min, max) and, by primitive, the base of its
    vertices in its group: groups that are not compatible stay apart, each primitive by itself."""
    ok = groups.join(compatible(found, groups), "group_id").select("prim_id", F.when(F.col("compatible"), F.col("group_id")).otherwise(F.col("prim_id")).alias("group_id"))
    rows = found.join(ok, "prim_id")
    low = F.array(*[F.min(F.get("min", F.lit(k))) for k in range(3)])
    high = F.array(*[F.max(F.get("max", F.lit(k))) for k in range(3)])
    whole = lambda b: F.when(F.max(F.size("min")) > 0, F.filter(b, lambda x: x.isNotNull()))
    out = rows.groupBy("group_id", "attribute", "type").agg(F.sum("count").cast("long").alias("count"), F.max("component").alias("component"), whole(low).alias("min"), whole(high).alias("max"))
    out = out.withColumn("component", F.when(F.col("attribute") == "indices", index_component(F.col("count"))).otherwise(F.col("component")))
    sizes = rows.filter("attribute = 'POSITION'").select("group_id", "prim_id", "count")
    base = F.coalesce(F.sum("count").over(Window.partitionBy("group_id").orderBy("prim_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return out, sizes.select("group_id", "prim_id", "count", base.alias("base"))


def options(text: Column) -> Column:
    """map<string,string> of an option string: words apart by white space, key=value or a bare key (value 1); the last
    of repeated keys counts."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.when(F.contains(w, F.lit("=")), F.regexp_extract(w, "=(.*)$", 1)).otherwise(F.lit("1")).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def processors(o: Column) -> Column:
    """The post-processing steps that options ask for, in the order in which they run."""
    on = lambda k: F.coalesce(o[k], F.lit("")).isin("1", "true")
    steps = [F.when(~on("noMergeMaterial"), F.lit("mergeMaterial")), F.when(~on("noMergeMesh"), F.lit("mergeMesh")), F.when(on("quantize") | (o["ct"] == "quantize"), F.lit("quantize")), F.when(o["ct"].isin("draco", "meshopt"), o["ct"]), F.when(on("unlit"), F.lit("unlit"))]
    return F.concat_ws(",", *steps)
