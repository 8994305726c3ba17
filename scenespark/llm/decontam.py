"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. A document's words are streamed
through it; at each word the automaton knows the longest suffix read so far that occurs in some item.
Where that length reaches the window (13 words, or a whole item that is shorter), the window's words
are hit and its items are known. A word that no item has resets the automaton to its root, and two
neighbours that no item has next to each other leave at most one word of a match, so stretches between
such places that are shorter than the shortest window are passed over.

Words: A-Z lower-cased, then runs of ASCII letters, digits and characters beyond ASCII. Null and empty
texts have no word and are never contaminated; items without a word are not looked for; repeated items
count each by their own id, a null id as the empty string; repeated documents give repeated results; very
long texts are read whole. Further columns are kept by ``decontaminate`` whatever their names, and ignored
by ``contamination``.

A test set whose texts take more than SHARD_BYTES is dealt to several automata, one pass over the
documents each: a worker then builds one automaton for a whole pass, and only one shard is broadcast at a
time. What a pass finds is written by the digest of the text, so that it comes back to its documents
without moving their texts as long as it is small (FOUND rows), else by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.session import prepare, scratch

WINDOW = 13
#: A document is contaminated if one in so many of its words, or more, is hit.
COVERAGE = 20
#: Bytes of item texts in one automaton; more items are dealt out to several, each read in turn.
SHARD_BYTES = 4 << 20
#: Documents with hits that are broadcast back.
FOUND = 100_000

_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_KEPT).split() if text else []


class Automaton:
    """A generalised suffix automaton over words, with the items of every window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        texts = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normalised(t)]) for i, t in items]
        texts = [(i, ws) for i, ws in texts if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: for each state, the nearest state towards the root that holds a string of the window's length
        self.holder = list(range(len(self.next)))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in order:
            if self.length[self.link[v]] >= window:
                self.holder[v] = self.holder[self.link[v]]
        #: items by state: of windows, and of whole items that are shorter
        self.full: dict[int, set] = {}
        whole: dict[int, list[tuple[int, object]]] = {}
        pairs = [np.zeros(0, np.int64)]
        for i, words in texts:
            at = 0
            for k, w in enumerate(words):
                at = self.next[at][w]
                if k + 1 >= window:
                    self.full.setdefault(self.holder[at], set()).add(i)
            if len(words) < window:
                whole.setdefault(at, []).append((len(words), i))
            pairs.append(np.array(words[:-1], np.int64) * len(self.vocabulary) + np.array(words[1:], np.int64))
        #: for each state, the short items that end where it ends
        self.short: dict[int, list[tuple[int, object]]] = {}
        if whole:
            for v in order:
                found = whole.get(v, []) + self.short.get(self.link[v], [])
                if found:
                    self.short[v] = found
        self.least = min([window, *(n for found in whole.values() for n, _ in found)])
        self.next_to = np.zeros(1 << 20, bool)
        self.next_to[self._slot(np.concatenate(pairs))] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 7) & ((1 << 20) - 1)

    def _add(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w, split if it also holds longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit ranges (first word, end) in order, and the items with a window in the text."""
        n, least, window = len(words), self.least, self.window
        if n < least or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        breaks = ids < 0
        if least > 1:
            ok = self.next_to[self._slot(ids[:-1] * len(self.vocabulary) + ids[1:])]
            seams = np.flatnonzero(~ok | breaks[:-1] | breaks[1:]) + 1
            cuts = np.concatenate([[0], seams, [n]])
        else:
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(breaks), np.flatnonzero(breaks) + 1, [n]]))
        long = np.flatnonzero(np.diff(cuts) >= least)
        ranges: list[tuple[int, int]] = []
        items: set = set()
        moves, link, length, holder, full, short = self.next, self.link, self.length, self.holder, self.full, self.short
        for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
            if ids[a] < 0:
                continue
            state = size = 0
            for k, w in enumerate(ids[a:b].tolist(), a + 1):
                to = moves[state].get(w)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = moves[state].get(w)
                if to is None:
                    size = 0
                    continue
                state = to
                size += 1
                if size >= window:
                    ranges.append((k - window, k))
                    items |= full[holder[state]]
                if state in short:
                    for m, i in short[state]:
                        if m <= size:
                            ranges.append((k - m, k))
                            items.add(i)
        ranges.sort()
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def shards(items: DataFrame, most: int = SHARD_BYTES) -> Iterator[list[tuple]]:
    """The items (item_id, text) in lists of bounded size; the driver holds one list at a time."""
    held, size = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").filter(F.col("text").isNotNull())
    for i, text in rows.toLocalIterator():
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((i, text))
        size += len(text)
    yield held


def _is_contaminated(n_hit: Column, n_words: Column, coverage: int) -> Column:
    return (n_hit > 0) & (n_hit * coverage >= n_words)


def _joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


HITS = {"n_words": T.LongType(), "n_hit": T.LongType(), "ranges": T.ArrayType(T.ArrayType(T.IntegerType())), "items": T.ArrayType(T.StringType())}
#: The names of these columns while further columns of documents travel along.
OWN = {k: f"__hit_{k}" for k in HITS}
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "ranges": pa.list_(pa.list_(pa.int32())), "items": pa.list_(pa.string())}


def _columns(words: list[int], found: list[tuple[list, set]]) -> dict[str, pa.Array]:
    ranges = [_joined(r) for r, _ in found]
    return {
        "n_words": pa.array(words, _TYPES["n_words"]),
        "n_hit": pa.array([sum(b - a for a, b in r) for r in ranges], _TYPES["n_hit"]),
        "ranges": pa.array(ranges, _TYPES["ranges"]),
        "items": pa.array([sorted(ids) for _, ids in found], _TYPES["items"]),
    }


def _pass(spark: SparkSession, docs: DataFrame, items: list[tuple], window: int, keep: tuple[str, ...], hits_only: bool) -> DataFrame:
    """The columns keep and OWN of documents read through one automaton, all or only those with a hit."""
    sent = spark.sparkContext.broadcast(items)
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(OWN[k], t) for k, t in HITS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, window)
        for batch in batches:
            names = batch.schema.names
            words = [normalised(t) for t in batch.column(names.index("text")).to_pylist()]
            found = [automaton.match(ws) for ws in words]
            out = pa.RecordBatch.from_arrays([*(batch.column(names.index(k)) for k in keep), *_columns(list(map(len, words)), found).values()], schema.names)
            yield out.filter(pa.array([bool(r) for r, _ in found], pa.bool_())) if hits_only else out

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def _found(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int, keep: tuple[str, ...], shard_bytes: int) -> DataFrame:
    prepare(spark)
    passes, waiting = [], None
    for part in shards(items, shard_bytes):
        if waiting is not None:
            passes.append(_written(spark, docs, waiting, window))
        waiting = part
    if not passes:
        return _pass(spark, docs, waiting, window, keep, False)
    passes.append(_written(spark, docs, waiting, window))
    every = spark.read.parquet(*passes)
    hits = every.groupBy("__key").agg(F.flatten(F.collect_list(OWN["ranges"])).alias("__r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(OWN["items"])))).alias("__i"))
    rows = _pass(spark, docs, [], window, tuple(dict.fromkeys((*keep, "text"))), False).withColumn("__key", F.sha2("text", 256))
    rows = rows.join(F.broadcast(hits) if hits.count() <= FOUND else hits, "__key", "left")
    ordered = F.array_sort(F.coalesce("__r", F.array().cast("array<array<int>>")))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(ordered, begin, lambda s, r: F.struct((s["n"] + F.greatest(r[1] - F.greatest(r[0], s["end"]), F.lit(0))).alias("n"), F.greatest(r[1], s["end"]).alias("end")), lambda s: s["n"])
    own = {"n_words": F.col(OWN["n_words"]), "n_hit": n_hit.cast("long"), "ranges": ordered, "items": F.coalesce("__i", F.array().cast("array<string>"))}
    return rows.select(*keep, *[own[k].alias(OWN[k]) for k in HITS])


def _written(spark: SparkSession, docs: DataFrame, items: list[tuple], window: int) -> str:
    """The documents with hits of one shard's items, by digest of the text."""
    path = scratch(spark, "hits")
    _pass(spark, docs.select("text"), items, window, ("text",), True).withColumn("__key", F.sha2("text", 256)).drop("text").dropDuplicates(["__key"]).write.parquet(path)
    return path


def find_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns ``keep``, n_words, n_hit, ranges (of words, in order; those of several automata may overlap)
    and items (ids as strings, sorted); kept columns of these names are replaced. No item is left out, however large the test set."""
    kept = tuple(k for k in keep if k not in HITS)
    return _found(spark, docs, items, window, kept, shard_bytes).select(*kept, *[F.col(OWN[k]).alias(k) for k in HITS])


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return find_hits(spark, docs, items, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        _is_contaminated(F.col("n_hit"), F.col("n_words"), coverage).alias("contaminated"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, remove_spans: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without contaminated documents; other documents stay as they are.

    With ``remove_spans`` no document goes; instead contaminated documents lose the hit spans (from a
    span's first word to its last; n_chars follows the text)."""
    keep = tuple(docs.columns)
    found = _found(spark, docs, items, window, keep, shard_bytes)
    bad = _is_contaminated(F.col(OWN["n_hit"]), F.col(OWN["n_words"]), coverage)
    if not remove_spans:
        return found.filter(~bad).select(*keep)
    schema = docs.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            texts = []
            for text, ranges, hit in zip(cols["text"].to_pylist(), cols[OWN["ranges"]].to_pylist(), cols["__hit_bad"].to_pylist()):
                if hit:
                    raw = text.encode()
                    at = [m.span() for m in word.finditer(raw)]
                    for a, b in reversed(_joined(ranges)):
                        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
                    text = raw.decode()
                texts.append(text)
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], schema.names)

    out = found.withColumn("__hit_bad", bad).mapInArrow(strip, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in keep else out
