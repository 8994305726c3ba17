"""Animation keys as a stream. Nothing of this is needed for batch results; the same operators serve both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark.session import prepare


def keys_per_window(keys: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, axis, keys, last value: tumbling windows over (ts, axis, value), closed by the watermark."""
    counts = keys.withWatermark("ts", late).groupBy(F.window("ts", width), "axis").agg(F.count("*").alias("keys"), F.max_by("value", "ts").alias("last_value"))
    return counts.select(F.col("window.start").alias("window_start"), "axis", "keys", "last_value")


LATEST = "target long, axis string, t double, value double"


def latest_keys(keys: DataFrame, hold: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """target, axis, t, value: each target's newest key per axis, emitted whenever it changes.

    keys: ts, target, axis, t, value. State is one row per target, with an entry per axis; a target
    whose newest key is ``hold`` behind the watermark is forgotten."""
    prepare(keys.sparkSession)
    limit = int(pd.Timedelta(hold).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = {a: (float(v[0]), float(v[1])) for a, v in zip(*state.get)} if state.exists else {}
        changed, newest = {}, state.getCurrentWatermarkMs() + 1
        for f in frames:
            newest = max(newest, int(f["ts"].max().timestamp() * 1000))
            for axis, t, value in zip(f["axis"], f["t"], f["value"]):
                if axis not in now or now[axis][0] < t:
                    now[axis] = changed[axis] = (float(t), float(value))
        state.update((list(now), [list(v) for v in now.values()]))
        state.setTimeoutTimestamp(newest + limit)
        if changed:
            yield pd.DataFrame([(key[0], a, *v) for a, v in changed.items()], columns=["target", "axis", "t", "value"])

    return keys.withWatermark("ts", late).groupBy("target").applyInPandasWithState(update, LATEST, "axes array<string>, at array<array<double>>", "append", "EventTimeTimeout")
