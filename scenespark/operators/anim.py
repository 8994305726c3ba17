"""Animation keys: forward as-of lookup, control points and tangents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_times(keys: DataFrame, by: tuple[str, ...] = ("target",), time: str = "t") -> DataFrame:
    """The different times of all curves of a target."""
    return keys.select(*by, time).distinct()


def forward_asof(keys: DataFrame, axes: tuple[str, ...], by: tuple[str, ...] = ("target",), time: str = "t", defaults: dict[str, float] | None = None) -> DataFrame:
    """by, time and a column per axis: its first key at or after the time, else its last key, else the default.

    keys: by, axis, time, value; of several keys of an axis at one time the largest value counts. One
    shuffle by target, one sort: read from the last time on, the value ahead is the last one seen."""
    wide = keys.groupBy(*by, time).agg(*[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a) for a in axes])
    back = Window.partitionBy(*by).orderBy(F.desc(time))
    ahead = back.rowsBetween(Window.unboundedPreceding, 0)
    whole = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda a: F.coalesce(F.last(a, ignorenulls=True).over(ahead), F.first(a, ignorenulls=True).over(whole), F.lit((defaults or {}).get(a, 0.0)))
    return wide.select(*by, time, *[pick(a).alias(a) for a in axes])


def shifted_control_points(keys: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Keys with control points (cp_in, cp_out) shifted: in takes a key's own out, out takes the next
    key's in; the last one wraps to the first key's in before the shift."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return keys.select(*by, order, F.col("cp_out").alias("new_in"), F.coalesce(F.lead("cp_in").over(w), F.first("cp_in").over(whole)).alias("new_out"))


def tangent_points(keys: DataFrame, by: tuple[str, ...], time: str = "t") -> DataFrame:
    """Keys with control points a third of the way to their neighbours along the slopes left and right."""
    w = Window.partitionBy(*by).orderBy(time)
    before, after = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    return keys.select("*", (F.col("value") - F.coalesce(before, F.lit(0.0)) * F.col("slope_left") / 3).alias("cp_in"), (F.col("value") + F.coalesce(after, F.lit(0.0)) * F.col("slope_right") / 3).alias("cp_out"))


def by_take(keys: DataFrame) -> DataFrame:
    """One animation per take: its channels and its length."""
    return keys.groupBy("take").agg(F.count_distinct("target", "axis").alias("channels"), F.max("t").alias("length"), F.count("*").alias("keys"))


def static_runs(elements: DataFrame) -> DataFrame:
    """Transform elements (node, seq, kind, animated): neighbouring static ones share a run, an animated one stands alone."""
    w = Window.partitionBy("node").orderBy("seq")
    starts = F.col("animated") | F.coalesce(F.lag("animated").over(w), F.lit(True))
    return elements.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]), ",").alias("kinds"), F.bool_or("animated").alias("animated"))


def seconds(ts: Column, origin: str = "2024-01-01") -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / 1e6
