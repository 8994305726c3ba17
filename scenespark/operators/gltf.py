"""Columnar scene buffers: accessors, views, merging, quantisation and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(n: Column, to: int = 4) -> Column:
    return (F.ceil(n / to) * to).cast("long")


def aligned_offsets(views: DataFrame, by: tuple[str, ...], order: str, length: str) -> DataFrame:
    """The views with their byte offset: lengths before it, each rounded up to four."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return views.withColumn("offset", (F.sum(aligned(F.col(length))).over(w) - aligned(F.col(length))).cast("long"))


def merge_accessors(accessors: DataFrame, by: tuple[str, ...], lows: list[str], highs: list[str]) -> DataFrame:
    return accessors.groupBy(*by).agg(F.sum("count").cast("long").alias("count"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


def quantise(v: Column, bits: Column) -> Column:
    """A value from 0 to 1 as an unsigned integer of so many bits."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (F.pow(F.lit(2.0), bits) - 1) + 0.5).cast("long")


def quantise_signed(v: Column, bits: Column) -> Column:
    x = F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * (F.pow(F.lit(2.0), bits - 1) - 1)
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def octahedral(n, bits: int = 8) -> tuple[Column, Column]:
    """A unit normal folded onto an octahedron, as two signed integers."""
    x, y, z = n
    size = F.abs(x) + F.abs(y) + F.abs(z)
    px, py = x / size, y / size
    sign = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    fold = z < 0
    u, v = F.when(fold, (1 - F.abs(py)) * sign(px)).otherwise(px), F.when(fold, (1 - F.abs(px)) * sign(py)).otherwise(py)
    return quantise_signed(u, F.lit(bits)), quantise_signed(v, F.lit(bits))


def exponent(v: Column) -> Column:
    """The e for which v = m * 2 ** e with 0.5 <= |m| < 1; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.floor(F.log2(F.abs(v))) + 1).cast("int")


def replicate_bits(v: Column, bits: int) -> Column:
    """A colour channel of 8 bits cut to fewer bits, then widened again by repeating its high bits."""
    top = F.shiftright(v, 8 - bits)
    return F.shiftleft(top, 8 - bits).bitwiseOR(F.shiftright(top, 2 * bits - 8) if 2 * bits >= 8 else F.lit(0))


def index_width(n: Column) -> Column:
    return F.when(n < 256, "u8").when(n < 65536, "u16").otherwise("u32")


def scene_buffers(vertices: DataFrame) -> DataFrame:
    """One buffer view per primitive and attribute: prim_id, attribute, slot, count, bytes, offset."""
    attrs = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(n).alias("attribute"), F.lit(b).alias("size")) for k, (n, b) in enumerate((("POSITION", 12), ("TEXCOORD_0", 8), ("_BATCHID", 4)))])
    counts = vertices.groupBy("prim_id").agg(F.count("*").alias("count"))
    views = counts.select("prim_id", "count", F.explode(attrs).alias("a")).select("prim_id", "a.slot", "a.attribute", "count", (F.col("count") * F.col("a.size")).alias("bytes"))
    return aligned_offsets(views, ("prim_id",), "slot", "bytes")


def oct32p(n) -> tuple[Column, Column]:
    """A unit normal as two unsigned 16-bit numbers, cut off; the zero vector maps to the middle."""
    x, y, z = n
    size = F.abs(x) + F.abs(y) + F.abs(z)
    px, py = (F.when(size > 0, c / size).otherwise(0.0) for c in (x, y))
    sign = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    u, v = F.when(z < 0, (1 - F.abs(py)) * sign(px)).otherwise(px), F.when(z < 0, (1 - F.abs(px)) * sign(py)).otherwise(py)
    return tuple(F.floor((w * 0.5 + 0.5) * 65535).cast("long") for w in (u, v))


def little_endian(n: Column, size: int = 4) -> Column:
    """A non-negative integer as bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)]))
