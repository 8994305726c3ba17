"""Attribute tables: objects grouped by their set of attribute names, values stored column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark.operators.order import numbered


def key_sets(objects: DataFrame) -> DataFrame:
    """Objects (id, attrs map) with key_set, their sorted attribute names."""
    return objects.withColumn("key_set", F.array_join(F.array_sort(F.map_keys("attrs")), ","))


def classes(objects: DataFrame) -> DataFrame:
    """class_id (by the order of key sets), key_set and instances."""
    sets = key_sets(objects).groupBy("key_set").agg(F.count("*").alias("instances"))
    return numbered(sets, "key_set").select((F.col("place") - 1).alias("class_id"), "key_set", "instances")


def members(objects: DataFrame) -> DataFrame:
    """id, class_id: a class may hold most objects, so they come as rows, not as one list."""
    numbers = classes(objects).select("key_set", "class_id")
    return key_sets(objects).join(F.broadcast(numbers), "key_set").select("id", "class_id")


def columns_of_classes(objects: DataFrame) -> DataFrame:
    """key_set, key and its values as a JSON array in the order of ids."""
    rows = key_sets(objects).select("id", "key_set", F.explode("attrs").alias("key", "value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"])
    return rows.groupBy("key_set", "key").agg(F.to_json(ordered).alias("values"))
