"""Near-duplicates by SimHash and a generalised pigeonhole search.

A fingerprint's bit is the majority of that bit over the XXH64 values of a text's word shingles.
Two fingerprints are linked if they differ in at most ``radius`` bits. The search deals the 64 bits
into parts so that correlated bits stay together, gives each part a threshold of its own (their sum
is radius - parts + 1, so two linked fingerprints agree on some part up to its threshold), chosen by
dynamic programming on estimated candidate counts, and probes an index of part values with all
values within the threshold. Candidates are verified on all 64 bits.

Only different fingerprints are searched; copies follow by membership. A part value shared by more
than ``bucket`` fingerprints would give pairs in the square of their number. Such fingerprints, and
those that probe them, take another exact way: each emits every fingerprint within half the radius
of itself, and those that meet in one such midpoint are linked to the smallest among them (any two
within the radius share a midpoint, any two that share one are within the radius). An odd radius has no
midpoints and compares all that share a part value, whatever their number.

Null texts and texts without a word have fingerprint zero and are linked like any other. Documents
with a null id take part but cannot name a component. Repeated rows give repeated results; very long
texts are read whole; an empty table gives an empty result; further columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates`` whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.llm.components import components
from scenespark.session import cut, prepare

SHINGLE, RADIUS = 4, 4
#: Fingerprints that may share a part's value before they are linked by midpoints.
BUCKET = 2048
#: Fingerprints sampled to group bits and to estimate candidate counts; results do not depend on it.
SAMPLE = 4000
#: The cost of a probe, a row that is shuffled and sorted, in candidates, which are only compared.
PROBE_COST = 20.0
PARTS = (2, 3, 4, 5)
#: Documents of one fingerprint beyond which its rows are joined by broadcast; there are few such fingerprints.
COPIES = 10_000
#: Parts that the rows of one component are dealt to when they are joined.
SALTS = 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return h(line, 42)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
    hashes = np.array([h(line[a:b], 42) for a, b in zip(at[: n - size + 1].tolist(), (at[size:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    prepare(spark)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in groups of nearly equal size, each grown from a bit by what correlates with it most."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, 64))
    x = bits - bits.mean(0)
    norm = np.sqrt((x * x).sum(0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = (64 * (k + 1)) // parts - (64 * k) // parts
        seed = min(free, key=lambda i: (-max((corr[i, j] for j in free if j != i), default=0), i))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = min(free, key=lambda j: (-corr[j, group].sum(), j))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost; costs[i][t + 1] is part i's cost at t >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(cost) - 1):
                if s + t not in nxt or c + cost[t + 1] < nxt[s + t][0]:
                    nxt[s + t] = (c + cost[t + 1], [*ts, t])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, n: int, radius: int = RADIUS, choices: tuple[int, ...] = PARTS) -> list[tuple[int, list[int]]]:
    """Parts as (mask, flips): a fingerprint probes its part's value xor each flip. Cheapest of the choices."""
    found = None
    a = sample[: min(len(sample), 250)]
    for parts in choices:
        groups = group_bits(sample, parts)
        total = radius - parts + 1
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            d = np.bitwise_count((a[:, None] ^ sample[None, :]) & mask) if len(a) else np.zeros((1, 1), int)
            pairs = max(1, len(a) * (len(sample) - 1))
            cost, probes = [0.0], 0
            for t in range(0, max(0, total + parts - 1) + 1):
                probes += len(list(itertools.combinations(range(len(g)), t))) if t <= 3 else 10**9
                near = max(0, int((d <= t).sum()) - len(a)) / pairs
                near = max(near, probes / 2.0 ** len(g))  # no less than if the bits were independent
                cost.append(probes * PROBE_COST + n * near)
            costs.append(cost)
        cost, thresholds = allot(costs, total)
        if found is None or cost < found[0]:
            found = (cost, groups, thresholds)
    out = []
    for g, t in zip(found[1], found[2]):
        if t >= 0:
            flips = [sum(1 << b for b in c) for r in range(t + 1) for c in itertools.combinations(g, r)]
            out.append((sum(1 << b for b in g), flips))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flipped(x: Column, bits: int, low: Column) -> Column:
    """array<long>: x with so many bits flipped, none of them below low."""
    if not bits:
        return F.array(x)
    one = F.lit(1).cast("long")
    return F.flatten(F.transform(F.sequence(low, F.lit(64 - bits)), lambda i: _flipped(x.bitwiseXOR(F.call_function("shiftleft", one, i)), bits - 1, i + 1)))


def links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b (fp values): links that connect all fingerprints within the radius, as their transitive closure.

    fps: one column fp of different values, computed already (it is read several times)."""
    n = fps.count()
    grain = 1 << 20
    taken = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(grain)) < max(1, min(grain, int(1.2 * SAMPLE * grain / max(1, n))))).limit(2 * SAMPLE).collect()
    sample = np.sort(np.array([r[0] for r in taken], np.int64)).view(np.uint64)[:SAMPLE]
    rng = np.random.default_rng(0)
    parts = plan(rng.permutation(sample), n, radius)
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for k, (mask, _) in enumerate(parts)])).alias("x")).select("x.part", "x.key", F.col("fp").alias("b"))
    crowded = cut(index.groupBy("part", "key").count().filter(F.col("count") > bucket).select("part", "key", F.lit(True).alias("crowded")))
    flips = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(_signed(mask)).alias("mask"), F.array(*[F.lit(_signed(f)) for f in flips]).alias("flips")) for k, (mask, flips) in enumerate(parts)])
    probes = fps.select("fp", F.explode(flips).alias("x")).select("fp", "x.part", (F.col("fp").bitwiseAND(F.col("x.mask"))).alias("value"), F.explode("x.flips").alias("flip")).select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    hot = crowded.count()
    if not hot or radius % 2:  # an odd radius has no midpoints; all pairs that share a value are compared
        pairs = probes.alias("p").join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & near)
        return pairs.select("a", "b")
    known = F.broadcast(crowded) if hot <= 100_000 else crowded
    calm = index.join(known, ["part", "key"], "left_anti")
    pairs = probes.alias("p").join(calm.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & near).select("a", "b")
    met = probes.join(known, ["part", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    around = [_flipped(F.col("fp"), r, F.lit(0)) for r in range(radius // 2 + 1)]
    points = met.select("fp", F.explode(F.concat(*around)).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    starred = hubs.join(points, "point").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionByName(starred)


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document."""
    prints = cut(fingerprints(spark, docs, size))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = cut(components(links(spark, classes.select("fp"), radius, bucket)).withColumnRenamed("node", "fp"))
    # components are named by fingerprints; what is asked for is the smallest doc_id. One component may hold a
    # third of all fingerprints, so its rows are salted
    linked = cut(classes.join(found, "fp").select("fp", "rep", "component", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")))
    named = linked.groupBy("component").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = linked.join(named, ["component", "salt"]).select("fp", "component_id")
    of = cut(classes.join(placed, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")))
    # copies of one text may be a third of all rows: the few such fingerprints are broadcast
    many = of.filter(F.col("n") > COPIES).select("fp", "component_id")
    few = of.filter(F.col("n") <= COPIES).select("fp", "component_id")
    if many.isEmpty():
        out = prints.join(few, "fp")
    else:
        hot = F.broadcast(many)
        out = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(few, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_named(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with the document that names each group; all columns of docs.

    groups: doc_id, component_id of every document with an id, computed already. Decided on ids: the texts stay
    where they are if the ids to drop are few enough to be broadcast (DROPPED), and move once otherwise. Of rows that
    repeat a doc_id the one stays whose columns have the smallest hash. Documents with a null id cannot be told apart
    and all stay."""
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    again = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone, again = cut(gone), cut(again)
    n_gone, n_again = gone.count(), again.count()
    known = lambda ids, n: F.broadcast(ids) if n <= DROPPED else ids
    kept = docs.join(known(gone, n_gone), "doc_id", "left_anti") if n_gone else docs
    if n_again:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        repeated = kept.join(known(again, n_again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
        kept = kept.join(known(again, n_again), "doc_id", "left_anti").select(*docs.columns).unionByName(repeated.select("__row.*").select(*docs.columns))
    return kept.select(*docs.columns)


#: Ids of documents that are broadcast to drop them.
DROPPED = 1_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """docs with the document of the smallest doc_id of each component, see ``keep_named``."""
    return keep_named(docs, cut(near_duplicates(spark, docs.filter("doc_id IS NOT NULL"), size, radius, bucket)))
