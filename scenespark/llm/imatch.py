"""Document fingerprints by I-Match with randomised lexicons.

A term counts if its document frequency lies in a band of the collection; the band's terms are the
lexicon. From it, random sub-lexicons are drawn by bits of the terms' hashes: for each of several
seeds, nested ones, each of half the density of the one before. A text's fingerprint has one part for
each seed, a hash of its distinct terms, sorted (by their 64-bit hash), in the sparsest sub-lexicon of
that seed which has any of them, or ``-`` if none has: so long and short texts alike are hashed over a
few terms. The likeness of two fingerprints is the share of equal parts among the parts that either has,
in expectation nearly the Jaccard similarity of their terms; two fingerprints without any are equal.

Only DataFrame functions. The lexicon has at most (mean distinct terms) / (lower frequency) terms,
whatever the number of documents; it is broadcast if its counted size is within a bound and joined by
a shuffle beyond. Neighbours in the order of doc_id meet without one global sort: quantiles of
doc_id (a bounded list) cut the ids into ranges, each range also gets the first document of the next
one, and each text crosses the network once.

Null texts count as empty: they have no term. A null doc_id comes before all others; documents with
the same doc_id follow each other by the hash of their texts; ids that are no integers count as null.
Repeated rows are documents of their own; very long texts are read whole. An empty table gives an empty
result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark.functions.linalg import let
from scenespark.session import cut

#: The band: a term is kept if it occurs in a share of all documents within these limits.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.02
#: Seeds, and the sub-lexicons of each: the first is the whole lexicon, the next has every second term and so on,
#: SLICE times.
SEEDS, SLICE, SLICES = 16, 14, 4
#: Terms of a lexicon that is broadcast (16 bytes each); a larger one is joined by a shuffle.
BROADCAST_TERMS = 2_000_000
#: Documents of a range of doc_id, and the most ranges.
RANGE_DOCS, MOST_RANGES = 500, 16_384
FIRST = -(1 << 63)


def _depth(h: Column, seed: int) -> Column:
    """A number that rises with the sparsest sub-lexicon of the seed that has a term: the lowest bit set in the
    seed's slice of the term's hash, or of the hash's own hash for further seeds."""
    bits = h
    for _ in range(seed // SLICES):
        bits = F.xxhash64(bits)
    own = F.shiftrightunsigned(bits, SLICE * (seed % SLICES)).bitwiseAND((1 << SLICE) - 1).bitwiseOR(F.lit(1 << SLICE))
    return own.bitwiseAND(-own)


def distinct_terms(text: Column) -> Column:
    """array<long>: the hashes of all distinct terms."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[DataFrame, int]:
    """Terms (h) whose document frequency is in the band, and how many there are."""
    n = docs.count()
    terms = docs.select(F.explode(distinct_terms(F.coalesce(F.col(text), F.lit("")))).alias("h"))
    found = cut(terms.groupBy("h").count().filter((F.col("count") >= least * n) & (F.col("count") <= max(1.0, most * n))).select("h"))
    return found, found.count()


def marks(h: Column) -> Column:
    """A term's depth in the sub-lexicons of each seed, as the power of two that ``_depth`` is: 4 bits a seed."""
    fours = [F.shiftleft(F.length(F.bin(_depth(h, s))).cast("long") - 1, 4 * s) for s in range(SEEDS)]
    return reduce(Column.bitwiseOR, fours)


def spread(known: Column) -> list[Column]:
    """The depths of a term's marks as single bits, SLICES seeds to a number: those of several terms can be joined by OR."""
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(known, 4 * s).bitwiseAND(15).cast("int") + (SLICE + 1) * (s % SLICES))
    return [reduce(Column.bitwiseOR, [bit(s) for s in range(k, min(SEEDS, k + SLICES))]) for k in range(0, SEEDS, SLICES)]


def _greatest(bits: list[Column]) -> Column:
    """The greatest depth of each seed, 4 bits a seed, of joined ``spread`` bits."""
    one = lambda s: F.shiftrightunsigned(bits[s // SLICES], (SLICE + 1) * (s % SLICES)).bitwiseAND((2 << SLICE) - 1)
    return reduce(Column.bitwiseOR, [F.shiftleft(F.length(F.bin(one(s))).cast("long") - 1, 4 * s) for s in range(SEEDS)])


def _fingerprint(terms: Column, bits: list[Column]) -> Column:
    """The fingerprint of an array of lexicon terms (h, marks) in any order; bits: their joined ``spread``.

    Only the terms that are deepest for a seed are looked at for each seed; there are few."""
    ones = int("1" * 16, 16)

    def deepest(top: Column) -> Column:
        rows = F.transform(terms, lambda r: F.struct(r["h"].alias("h"), r["marks"].bitwiseXOR(top).alias("x")))
        any_bit = lambda x: reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, k) for k in (1, 2, 3)], x)
        return F.array_sort(F.filter(rows, lambda r: any_bit(r["x"]).bitwiseAND(ones) != ones))

    def part(rows: Column, seed: int) -> Column:
        own = F.transform(F.filter(rows, lambda r: F.shiftrightunsigned(r["x"], 4 * seed).bitwiseAND(15) == 0), lambda r: r["h"])
        return F.lower(F.lpad(F.hex(F.xxhash64(own)), 16, "0"))

    found = let(let(_greatest(bits), deepest), lambda rows: F.concat_ws(".", *[part(rows, s) for s in range(SEEDS)]))
    return F.when(F.size(terms) > 0, found).otherwise(F.lit(".".join("-" * SEEDS)))


def fingerprint_of(terms: Column) -> Column:
    """The fingerprint of an array of lexicon terms."""

    def whole(rows: Column) -> Column:
        joined = lambda k: F.aggregate(rows, F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(spread(r["marks"])[k]))
        return _fingerprint(rows, [joined(k) for k in range(-(-SEEDS // SLICES))])

    return let(F.transform(terms, lambda h: F.struct(h.alias("h"), marks(h).alias("marks"))), whole)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal parts among those that either fingerprint has."""
    pairs = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    some = F.size(F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-")))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != "-") & (p["x"] == p["y"])))
    return F.when(some > 0, same / some).otherwise(F.lit(1.0))


def _ranges(docs: DataFrame) -> tuple[list[int], int | None]:
    """Ids that begin a range (not the first one), and the smallest id (FIRST for null)."""
    o = F.coalesce(F.col("doc_id").cast("string").try_cast("long"), F.lit(FIRST))
    n, low = docs.agg(F.count("*"), F.min(o)).first()
    if not n:
        return [], None
    many = max(1, min(MOST_RANGES, n // RANGE_DOCS))
    if many == 1:
        return [], low
    cuts = docs.agg(F.percentile_approx(o, [k / many for k in range(1, many)], 4 * many)).first()[0]
    return sorted({c for c in cuts if c > low}), low


def _range_of(o: Column, starts: list[int]) -> Column:
    """How many starts are not above o: a search in two steps."""
    if not starts:
        return F.lit(0)
    g = math.isqrt(len(starts) - 1) + 1
    groups = [starts[k : k + g] for k in range(0, len(starts), g)]
    heads = F.from_json(F.lit(json.dumps([x[0] for x in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    c = F.size(F.filter(heads, lambda x: x <= o))
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * g + F.size(F.filter(F.element_at(inner, F.greatest(c, F.lit(1))), lambda x: x <= o)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), next_text (of the next document by doc_id), and the row's place: bucket, at, copy.

    Rows with copy > 0 are the first rows of another range; they only serve their predecessors."""
    starts, low = _ranges(docs)
    o = F.coalesce(F.col("doc_id").cast("string").try_cast("long"), F.lit(FIRST))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), o.alias("o")).withColumn("b", _range_of(F.col("o"), starts))
    places = [F.struct(F.col("b").alias("bucket"), F.lit(0).alias("copy"))]
    if starts:
        begins = F.element_at(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.greatest(F.col("b"), F.lit(1)))
        places.append(F.when((F.col("b") > 0) & (F.col("o") == begins), F.struct((F.col("b") - 1).alias("bucket"), F.lit(1).alias("copy"))))
    places.append(F.when(F.col("o") == (FIRST if low is None else low), F.struct(F.lit(len(starts)).alias("bucket"), F.lit(2).alias("copy"))))
    dealt = rows.select("doc_id", "text", "o", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p")).select("doc_id", "text", "o", "p.bucket", "p.copy", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy(F.col("copy") == 2, "o", "tie", "copy")
    return dealt.select("doc_id", "text", "bucket", "copy", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("at"))


def imatch_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    docs = docs.select("doc_id", "text")
    words, size = lexicon(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = with_next(docs).select("doc_id", "bucket", "at", "copy", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    own, changed = distinct_terms(F.col("text")), distinct_terms(F.col("edited"))
    tagged = lambda a, k: F.transform(a, lambda h: F.struct(h.alias("h"), F.lit(k).alias("of")))
    head = F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # the document's own columns ride on one row of it only
    marker = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("of")))
    terms = rows.select("bucket", "at", "copy", head.alias("head"), F.explode(F.concat(marker, tagged(own, 1), tagged(changed, 2))).alias("x"))
    terms = terms.select("bucket", "at", "copy", F.when(F.col("x.of") == 0, F.col("head")).alias("head"), F.col("x.h").alias("h"), F.col("x.of").alias("of"))
    known = words.withColumn("marks", marks(F.col("h")))
    kept = terms.join(F.broadcast(known) if size <= BROADCAST_TERMS else known, "h", "left").filter("marks IS NOT NULL OR of = 0")
    bits = spread(F.col("marks"))
    kept = kept.select("bucket", "at", "copy", "head", "of", F.struct("h", "marks").alias("term"), *[x.alias(f"bits{k}") for k, x in enumerate(bits)])
    by_doc = kept.groupBy("bucket", "at").agg(
        F.max("copy").alias("copy"),
        F.max("head").alias("head"),
        *[F.collect_list(F.when(F.col("of") == i, F.col("term"))).alias(name) for i, name in ((1, "own"), (2, "changed"))],
        *[F.bit_or(F.when(F.col("of") == i, F.col(f"bits{k}"))).alias(f"{name}{k}") for i, name in ((1, "own"), (2, "changed")) for k in range(len(bits))],
    )
    of = lambda name: _fingerprint(F.col(name), [F.col(f"{name}{k}") for k in range(len(bits))])
    prints = by_doc.select("bucket", "at", "copy", "head", of("own").alias("fingerprint"), of("changed").alias("edited_fingerprint"))
    after = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("at"))).filter("copy = 0")
    return after.select(
        "head.doc_id",
        "head.n_chars",
        "head.edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint")).alias("near_next"),
    )
