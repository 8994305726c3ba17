"""Scene graphs: traversal, world transforms, hierarchy checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.functions import linalg as la
from scenespark.operators.order import numbered
from scenespark.session import cut

#: Levels of a hierarchy that are walked at most; deeper ones are an error, not cut short.
DEEPEST = 256


def local_matrix(tx="tx", ty="ty", tz="tz", s="s", q="q") -> Column:
    """Scale, then quarter turns about Z, then translation."""
    turn = F.col(q) % 4
    cos = F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0)
    sin = F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0)
    sc = F.col(s)
    return la.matrix(sc * cos, sc * sin, 0, 0, -sc * sin, sc * cos, 0, 0, 0, 0, sc, 0, tx, ty, tz, 1)


def walk(nodes: DataFrame, carry: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All nodes with their depth below a root and carried values.

    carry: name -> (value at a root, value at a child as an expression over the child's columns and the
    parent's carried columns, which are named up_<name>). One join per level, computed once."""
    first = nodes.filter("parent_id IS NULL")
    names = list(carry)
    level = first.select(*nodes.columns, F.lit(0).alias("depth"), *[v[0].alias(n) for n, v in carry.items()])
    out = level
    for depth in range(1, DEEPEST + 1):
        up = level.select(F.col("node_id").alias("up_id"), *[F.col(n).alias(f"up_{n}") for n in names])
        level = nodes.join(up, F.col("parent_id") == F.col("up_id")).select(*nodes.columns, F.lit(depth).alias("depth"), *[v[1].alias(n) for n, v in carry.items()])
        level = cut(level)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the hierarchy is deeper than {DEEPEST} levels or has a cycle")


def world_matrices(nodes: DataFrame, local: Column) -> DataFrame:
    """node_id, depth, world (local * parent's world)."""
    nodes = nodes.withColumn("local", local)
    found = walk(nodes, {"world": (F.col("local"), la.multiply(F.col("local"), F.col("up_world")))})
    return found.select("node_id", "depth", "world")


def paths(nodes: DataFrame) -> DataFrame:
    """node_id, depth and the path of names, in which siblings sort by id: its order is a pre-order walk."""
    key = F.lpad(F.col("node_id").cast("string"), 12, "0")
    return walk(nodes, {"sort_key": (key, F.concat("up_sort_key", F.lit("/"), key)), "path": (F.col("name"), F.concat("up_path", F.lit("/"), "name"))}).select("node_id", "parent_id", "kind", "depth", "path", "sort_key")


def nearest_ancestor(nodes: DataFrame, wanted: Column) -> DataFrame:
    """node_id and the nearest proper ancestor for which wanted holds (null without one)."""
    flagged = nodes.withColumn("_w", wanted)
    pass_on = F.when(F.col("up__own"), F.col("up_id")).otherwise(F.col("up_found"))
    return walk(flagged, {"_own": (F.col("_w"), F.col("_w")), "found": (F.lit(None).cast("bigint"), pass_on)}).select("node_id", F.col("found").alias("ancestor_id"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, including the node itself."""
    own = F.col("node_id").cast("bigint")
    chain = walk(nodes, {"chain": (F.array(own), F.array_append("up_chain", own))})
    return chain.select("node_id", F.explode("chain").alias("ancestor_id"))


def subtree_max(nodes: DataFrame, value: str) -> DataFrame:
    return ancestors(nodes).join(nodes.select("node_id", value), "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.max(value).alias(f"max_{value}"))


def live_nodes(nodes: DataFrame, filled: DataFrame) -> DataFrame:
    """Nodes that hold something (node_id in filled) or have a descendant that does."""
    keep = ancestors(nodes).join(filled.select("node_id").distinct(), "node_id", "left_semi").select(F.col("ancestor_id").alias("node_id")).distinct()
    return nodes.join(keep, "node_id", "left_semi")


def valid_tree(tiles: DataFrame, ident: str = "tile_id", parent: str = "parent_id", error: str = "geometric_error") -> DataFrame:
    """Per tile whether its error is above every child's, or 0 if it has none."""
    kids = tiles.groupBy(F.col(parent).alias("_p")).agg(F.max(error).alias("_child"))
    ok = F.when(F.col("_child").isNull(), F.col(error) == 0).otherwise(F.col(error) > F.col("_child"))
    return tiles.join(kids, F.col(ident) == F.col("_p"), "left").select(ident, ok.alias("valid"))


def bake(vertices: DataFrame, world: DataFrame) -> DataFrame:
    """vertices (prim_id, node_id, vi, x, y, z) moved by their node's world matrix."""
    joined = vertices.join(world.select("node_id", "world"), "node_id")
    return joined.select("prim_id", "vi", *[p.alias(a) for p, a in zip(la.apply((F.col("x"), F.col("y"), F.col("z")), F.col("world")), "xyz")])


def batch_ids(geodes: DataFrame, order: DataFrame) -> DataFrame:
    """geode_id, batch_id, parent_batch_id: numbers in pre-order of the nodes, then of geode ids.

    Numbers run over the whole scene, so they come from counts per node and a running sum over nodes:
    no sort of all geodes in one place."""
    per = geodes.groupBy("node_id").agg(F.count("*").alias("n")).join(order.select("node_id", "sort_key"), "node_id")
    base = numbered(per, "sort_key", value="n").select("node_id", F.col("before").alias("base"))
    own = F.row_number().over(Window.partitionBy("node_id").orderBy("geode_id")) - 1
    return geodes.join(base, "node_id").select("geode_id", "node_id", (F.col("base") + own).cast("long").alias("batch_id"), F.greatest(F.col("base") - 1, F.lit(0)).cast("long").alias("parent_batch_id"))
