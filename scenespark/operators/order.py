"""Places in a global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.session import cut


def numbered(rows: DataFrame, *order: Column | str, value: str | None = None) -> DataFrame:
    """rows with place (1, 2, ..) in the order and, given a value column, before: the sum of what precedes.

    The sort deals the rows to ranges; rows are numbered within a range, and a range's offset comes from
    the ranges' counts, a table of as many rows as there are partitions. The order must tell rows apart."""
    dealt = cut(rows.orderBy(*order)).withColumn("__range", F.spark_partition_id())
    amount = F.col(value) if value else F.lit(0)
    totals = dealt.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(amount).alias("__v"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}0") for c in "nv"])
    own = Window.partitionBy("__range").orderBy(*order)
    out = dealt.select("*", F.row_number().over(own).alias("__own"), F.coalesce(F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__run"))
    out = out.join(F.broadcast(offsets), "__range")
    before = [(F.col("__v0") + F.col("__run")).alias("before")] if value else []
    return out.select(*rows.columns, (F.col("__n0") + F.col("__own")).cast("long").alias("place"), *before)
