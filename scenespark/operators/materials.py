"""Materials, textures and images: conversions, deduplication, lookups and pixel arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.operators.order import numbered

# Image types by extension: fixed values.
MIME = {"ktx": "image/ktx", "ktx2": "image/ktx2", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
#: GL formats and their linear-to-sRGB and Vulkan numbers: fixed values of the formats in use here.
FORMATS = ((0x8051, 0x8C41, 23), (0x8058, 0x8C43, 37), (0x8229, 0x8FBD, 9), (0x822B, 0x8FBE, 16))


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./\\]+)$", 1))


def mime_type(file: Column) -> Column:
    """Null for what no writer takes."""
    ext = extension(file)
    out = F.lit(None).cast("string")
    for e, m in MIME.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def image_files(files: DataFrame) -> DataFrame:
    return files.filter(extension(F.col("file")).isin(*MIME))


def dedup(rows: DataFrame, ident: str, content: tuple[str, ...]) -> DataFrame:
    """ident and kept: the smallest id among rows whose content is equal (nulls equal each other)."""
    return rows.select(ident, F.min(ident).over(Window.partitionBy(*content)).alias("kept"))


def dense_ids(rows: DataFrame, ident: str, content: tuple[str, ...]) -> DataFrame:
    """content and new_id: numbers in order of first appearance (smallest ident). The different contents
    are few beside the rows; only they are numbered."""
    first = rows.groupBy(*content).agg(F.min(ident).alias("first"))
    return numbered(first, "first").select(*content, (F.col("place") - 1).alias("new_id"))


def remap(users: DataFrame, kept: DataFrame, ident: str) -> DataFrame:
    return users.join(kept, ident).withColumn(ident, F.col("kept")).drop("kept")


def distinct_images(images: DataFrame) -> DataFrame:
    """image_id, kept: nameless images by the hash of their content, named ones by their file."""
    named = F.col("file") != ""
    return images.select("image_id", F.min("image_id").over(Window.partitionBy(named, F.when(named, F.col("file")).otherwise(F.sha2("text", 256)))).alias("kept"))


def alpha_mode(blending: Column) -> Column:
    return F.when(blending, "BLEND").otherwise("OPAQUE")


def clamp_wrap(mode: Column) -> Column:
    return F.when(mode.isin("CLAMP", "CLAMP_TO_BORDER"), "CLAMP_TO_EDGE").otherwise(mode)


def flip_v(offset_y: Column, scale_y: Column) -> tuple[Column, Column]:
    return 1 - offset_y, -scale_y


def roughness(shininess: Column) -> Column:
    return F.sqrt(2.0 / (2.0 + shininess))


def glossiness(x: Column) -> Column:
    return 64 * F.ln(x) / (5 * F.ln(F.lit(2.0)))


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.30 * r + 0.59 * g + 0.11 * b


def luma(r: Column, g: Column, b: Column) -> Column:
    """Bytes to a byte, cut off."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 1e-9).cast("int")


def metallic(specular: Column, diffuse: Column) -> Column:
    """An estimate from grey values; below the dielectric reflectance nothing is metal."""
    d = 0.04
    return F.when(specular < d, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (specular - d) / F.greatest(specular + diffuse - d, F.lit(1e-6)))))


def spot_exponent(hotspot: Column) -> Column:
    return (180.0 / F.greatest(hotspot, F.lit(0.467532)) - 1.0) / 3.0


def power_of_two(n: Column, most: int) -> Column:
    """The nearest power of two (the lower one on ties), at most ``most``."""
    low = F.pow(F.lit(2.0), F.floor(F.log2(n) + 1e-12))
    return F.least(F.when(n - low > 2 * low - n, 2 * low).otherwise(low), F.lit(float(most))).cast("int")


def mips(w: Column, h: Column) -> Column:
    """array<struct<level, w, h>> down to 1 x 1."""
    last = F.floor(F.log2(F.greatest(w, h)) + 1e-12).cast("int")
    half = lambda s, level: F.greatest(F.lit(1), F.floor(s / F.pow(F.lit(2.0), level)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("level"), half(w, k).alias("w"), half(h, k).alias("h")))


def to_byte(value: Column, kind: Column) -> Column:
    """A pixel of another type as a byte: u16, i16, u32, i32 by their range, floats from 0 to 1."""
    top = F.when(kind == "u16", 65535.0).when(kind == "i16", 32767.0).when(kind == "u32", 4294967295.0).when(kind == "i32", 2147483647.0).otherwise(1.0)
    return F.floor(F.least(F.greatest(value / top, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def sobel(pixels: Column, size: int = 8) -> Column:
    """array<struct<nx, ny, nz>> of a square height map (array of size * size), clamped at its edges."""
    at = lambda x, y: F.element_at(pixels, (F.least(F.greatest(y, F.lit(0)), F.lit(size - 1)) * size + F.least(F.greatest(x, F.lit(0)), F.lit(size - 1)) + 1).cast("int"))

    def normal(i: Column) -> Column:
        x, y = i % size, F.floor(i / size).cast("int")
        dx = at(x + 1, y - 1) + 2 * at(x + 1, y) + at(x + 1, y + 1) - at(x - 1, y - 1) - 2 * at(x - 1, y) - at(x - 1, y + 1)
        dy = at(x - 1, y + 1) + 2 * at(x, y + 1) + at(x + 1, y + 1) - at(x - 1, y - 1) - 2 * at(x, y - 1) - at(x + 1, y - 1)
        return F.struct(dx.alias("dx"), dy.alias("dy"))

    def unit(d: Column) -> Column:
        n = F.sqrt(d["dx"] * d["dx"] + d["dy"] * d["dy"] + 1)
        return F.struct((-d["dx"] / n * 0.5 + 0.5).alias("nx"), (-d["dy"] / n * 0.5 + 0.5).alias("ny"), (1 / n * 0.5 + 0.5).alias("nz"))

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), normal), unit)


def pack_channels(occlusion: Column, rough: Column, metal: Column) -> Column:
    """array<struct<r, g, b>> of three maps of one size."""
    return F.zip_with(F.zip_with(occlusion, rough, lambda a, b: F.struct(a.alias("r"), b.alias("g"))), metal, lambda s, c: F.struct(s["r"].alias("r"), s["g"].alias("g"), c.alias("b")))


def resolve_path(files: DataFrame, existing: DataFrame, candidates: list[str]) -> DataFrame:
    """image_id and path: the first candidate column that exists, else null.

    Candidates become rows, so one join decides them all whatever their number."""
    rows = files.select("image_id", F.posexplode(F.array(*candidates)).alias("rank", "path"))
    found = rows.join(existing.select("path").distinct(), "path", "left_semi").groupBy("image_id").agg(F.min_by("path", "rank").alias("path"))
    return files.select("image_id").join(found, "image_id", "left")


def first_valid(layers: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return layers.filter(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, order).alias(value))


def invert_alpha(alphas: DataFrame, by: str) -> DataFrame:
    """by, zeros, ones, and whether transparency means the opposite of what it says."""
    counts = alphas.groupBy(by).agg(F.count_if(F.col("alpha") < 0.001).alias("zeros"), F.count_if(F.col("alpha") > 0.999).alias("ones"))
    return counts.withColumn("invert", F.col("zeros") > F.col("ones"))
