"""Queries on animation keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenespark.operators import anim as an
from scenespark.queries import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
AXES = ("X", "Y", "Z")


def _keys(k):
    return k.withColumn("t", an.seconds(F.col("ts"))).select("target", "axis", "t", "value", "event_id")


_K = ", k AS (SELECT target, axis, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value, event_id FROM sc_keyframes)"
R.add("u1_key_times", "sc_keyframes", lambda k: an.key_times(_keys(k)), _K + " SELECT DISTINCT target, t FROM k")
R.add(
    "j6_forward_asof",
    "sc_keyframes",
    lambda k: an.forward_asof(_keys(k), AXES, defaults={"Z": 5.0}),
    _K + ", u AS (SELECT DISTINCT target, t FROM k) SELECT target, t, " + ", ".join(f"coalesce((SELECT arg_min(value, k.t) FROM k WHERE k.target = u.target AND axis = '{a}' AND k.t >= u.t), (SELECT arg_max(value, k.t) FROM k WHERE k.target = u.target AND axis = '{a}'), {5 if a == 'Z' else 0}) AS \"{a}\"" for a in AXES) + " FROM u",
)


def _cubic(k):
    return _keys(k).select("target", "axis", "event_id", (F.col("value") - 1).alias("cp_in"), (F.col("value") + 1).alias("cp_out"))


R.add("w7_control_points", "sc_keyframes", lambda k: an.shifted_control_points(_cubic(k), ("target", "axis"), "event_id"), "SELECT target, axis, event_id, value + 1 AS new_in, coalesce(lead(value - 1) OVER (PARTITION BY target, axis ORDER BY event_id), first_value(value - 1) OVER (PARTITION BY target, axis ORDER BY event_id)) AS new_out FROM sc_keyframes")
R.add(
    "w8_tangent_gaps",
    "sc_keyframes",
    lambda k: an.tangent_points(_keys(k).withColumns({"slope_left": F.col("value") / 100, "slope_right": F.col("value") / 50}), ("target", "axis")).select("event_id", F.round("cp_in", 6).alias("cp_in"), F.round("cp_out", 6).alias("cp_out")),
    _K + " SELECT event_id, round(value - coalesce(t - lag(t) OVER w, 0) * (value / 100) / 3, 6) AS cp_in, round(value + coalesce(lead(t) OVER w - t, 0) * (value / 50) / 3, 6) AS cp_out FROM k WINDOW w AS (PARTITION BY target, axis ORDER BY t)",
)
R.add("j16_animation_upsert", "sc_keyframes", lambda k: an.by_take(_keys(k).withColumn("take", F.concat(F.lit("take"), (F.col("target") % 4).cast("string")))), _K + " SELECT 'take' || (target % 4) AS take, count(DISTINCT (target, axis)) AS channels, max(t) AS length, count(*) AS keys FROM k GROUP BY 1")
R.add("s9_animation_scan", "sc_keyframes", lambda k: k.groupBy((F.col("target") % 4).alias("stack"), (F.col("target") % 3).alias("layer"), "axis").agg(F.count("*").alias("keys")), "SELECT target % 4 AS stack, target % 3 AS layer, axis, count(*) AS keys FROM sc_keyframes GROUP BY 1, 2, 3")
R.add("p32_blend_weights", "sc_keyframes", lambda k: k.select("event_id", F.round(F.col("value") * 0.01, 6).alias("weight")), "SELECT event_id, round(value * 0.01, 6) AS weight FROM sc_keyframes")
_el = lambda k: k.select(F.col("target").alias("node"), F.col("event_id").alias("seq"), F.col("axis").alias("kind"), (F.col("axis") == "Z").alias("animated"))
R.add(
    "p31_transform_elements",
    "sc_keyframes",
    lambda k: an.static_runs(_el(k)).select("node", F.col("run").cast("long").alias("run"), "kinds", "animated"),
    ", e AS (SELECT target AS node, event_id AS seq, axis AS kind, axis = 'Z' AS a, coalesce(lag(axis = 'Z') OVER (PARTITION BY target ORDER BY event_id), true) AS before FROM sc_keyframes), r AS (SELECT *, sum(CASE WHEN a OR before THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY seq) AS run FROM e) SELECT node, run::BIGINT AS run, string_agg(kind, ',' ORDER BY seq) AS kinds, bool_or(a) AS animated FROM r GROUP BY node, run",
)
