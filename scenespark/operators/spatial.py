"""Spatial partitioning: cells, greedy selection under budgets, quadtree, octree and KD-tree tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.session import cut

AXES = ("x", "y", "z")
BUCKETS, TRAVERSAL, INTERSECTION = 12, 1.0, 1.5


def centre_in(cell: str = "cell_", obj: str = "") -> Column:
    """Whether an object's centre lies in a closed cell; the containment test reduces to this for valid boxes."""
    return F.expr(" AND ".join(f"{obj}c{a} BETWEEN {cell}min_{a} AND {cell}max_{a}" for a in AXES))


def unsplit_axis(dx: Column, dy: Column, dz: Column) -> Column:
    """The axis of the smallest extent (x before y before z on ties): a quadtree keeps it whole."""
    return F.when((dx <= dy) & (dx <= dz), "x").when(dy <= dz, "y").otherwise("z")


def cell_of(value: Column, low: Column, high: Column, level: int) -> Column:
    """The number of the half-open cell of 2 ** level; a value on a shared face goes to the lower cell."""
    n = 1 << level
    t = (value - low) / (high - low) * n
    return F.when(high <= low, 0).otherwise(F.least(F.greatest(F.ceil(t) - 1, F.lit(0)), F.lit(n - 1))).cast("long")


def grid_key(value: Column, low: Column, high: Column, parts: int = 2) -> Column:
    return F.when(high <= low, 0).otherwise(F.least(F.greatest(F.floor((value - low) / (high - low) * parts), F.lit(0)), F.lit(parts - 1))).cast("long")


def draw_call_budget(level: int, most: int) -> int:
    return min((level + 1) * 5, most)


#: Objects of a cell that one fold reads.
CHUNK = 4096


def greedy_select(objects: DataFrame, cell: tuple[str, ...], max_triangles: int, max_draw_calls: int, chunk: int = CHUNK) -> DataFrame:
    """objects with accepted: those of each cell (id, radius, triangles, key) in order of falling radius, each
    accepted if both budgets still hold; if nothing fits, the largest one is taken.

    A fold reads at most ``chunk`` objects of a cell at a time, the largest ones that could still be accepted (the
    others need not be sorted: the limit is taken before the shuffle). What could not be accepted once never can be,
    as budgets only shrink, so after a chunk only what still fits its remaining budgets goes on to the next round."""
    row = F.struct((-F.col("radius")).alias("r"), F.col("id"), F.col("triangles"), F.col("key"))
    order = Window.partitionBy(*cell).orderBy(F.desc("radius"), "id")

    def step(s: Column, x: Column) -> Column:
        keys = F.array_union(s["keys"], F.array(x["key"]))
        fits = (s["tri"] + x["triangles"] <= max_triangles) & (F.size(keys) <= max_draw_calls)
        return F.when(fits, F.struct((s["tri"] + x["triangles"]).alias("tri"), keys.alias("keys"), F.array_append(s["taken"], x["id"]).alias("taken"))).otherwise(s)

    rest = objects.select(*cell, "id", "radius", "triangles", "key").withColumns({"tri": F.lit(0).cast("long"), "keys": F.array().cast("array<string>")})
    taken, first = None, None
    while True:
        top = rest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= chunk)
        begin = F.struct(F.first("tri").alias("tri"), F.first("keys").alias("keys"), F.array().cast("array<bigint>").alias("taken"))
        rows = top.groupBy(*cell).agg(F.array_sort(F.collect_list(row)).alias("rows"), begin.alias("begin"))
        done = cut(rows.select(*cell, F.aggregate("rows", F.col("begin"), step).alias("s"), F.col("rows")[0]["id"].alias("largest"), F.element_at("rows", -1).alias("end"), (F.size("rows") >= chunk).alias("more")))
        first = done.select(*cell, "largest") if first is None else first
        own = done.select(*cell, F.explode("s.taken").alias("id"))
        taken = own if taken is None else taken.unionByName(own)
        again = done.filter("more").select(*cell, F.col("s.tri").alias("tri"), F.col("s.keys").alias("keys"), F.col("end.r").alias("end_r"), F.col("end.id").alias("end_id"))
        if again.isEmpty():
            break
        rest = rest.drop("tri", "keys").join(again, list(cell))
        behind = (-F.col("radius") > F.col("end_r")) | ((-F.col("radius") == F.col("end_r")) & (F.col("id") > F.col("end_id")))
        fits = (F.col("tri") + F.col("triangles") <= max_triangles) & ((F.size("keys") < max_draw_calls) | F.array_contains("keys", F.col("key")))
        rest = cut(rest.filter(behind & fits).drop("end_r", "end_id"))
    empty = first.join(taken.select(*cell).distinct(), list(cell), "left_anti").select(*cell, F.col("largest").alias("id"))
    chosen = taken.unionByName(empty).withColumn("accepted", F.lit(True))
    return objects.join(chosen, [*cell, "id"], "left").select(*objects.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def bounds_of(objects: DataFrame) -> dict[str, float]:
    row = objects.agg(*[f(f"c{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]).first()
    return row.asDict()


def tree(objects: DataFrame, kind: str, levels: int, max_triangles: int = 200_000, max_draw_calls: int = 20) -> DataFrame:
    """id, level, x, y, z: the tile of each object (id, cx, cy, cz, radius, triangles, key) in a quadtree or octree.

    One pass per level: the cells' leftovers go on to the next level, whose cells are computed from the
    centre, so no join with cells is needed. At the last level a cell takes all that is left of it."""
    box = bounds_of(objects)
    if box["min_x"] is None:
        return objects.select("id", *[F.lit(0).cast("long").alias(c) for c in ("level", "x", "y", "z")])
    span = {a: box[f"max_{a}"] - box[f"min_{a}"] for a in AXES}
    whole = min(AXES, key=lambda a: (span[a], a)) if kind == "quadtree" else None
    used = [a for a in AXES if a != whole]
    rest, out = objects, None
    for level in range(levels + 1):
        at = {a: cell_of(F.col(f"c{a}"), F.lit(box[f"min_{a}"]), F.lit(box[f"max_{a}"]), level) for a in used}
        names = ("x", "y", "z")
        cells = [at[a] for a in used] + ([F.lit(0).cast("long")] if kind == "quadtree" else [])
        placed = rest.select("*", *[c.alias(n) for c, n in zip(cells, names)])
        if level == levels:
            took = placed.select("id", F.lit(level).cast("long").alias("level"), *names)
            return took if out is None else out.unionByName(took)
        chosen = cut(greedy_select(placed, names, max_triangles, draw_call_budget(level, max_draw_calls)))
        took = chosen.filter("accepted").select("id", F.lit(level).cast("long").alias("level"), *names)
        out = took if out is None else out.unionByName(took)
        rest = chosen.filter("NOT accepted").select(*objects.columns)
        if rest.isEmpty():
            return out
    return out
    return out


def sah_histogram(objects: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, axis, bucket, count and box of the buckets: objects (cx.., min_x.. max_z) by where their centre lies."""
    whole = objects.groupBy(*keys).agg(*[f(f"{n}_{a}").alias(f"all_{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
    limits = objects.join(whole, list(keys)) if keys else objects.join(F.broadcast(whole))
    entry = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"c{a}").alias("c"), F.col(f"all_min_{a}").alias("lo"), F.col(f"all_max_{a}").alias("hi")) for k, a in enumerate(AXES)])
    rows = limits.select("*", F.explode(entry).alias("e")).filter("e.hi > e.lo")
    bucket = F.least(F.greatest(F.floor(BUCKETS * (F.col("e.c") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo"))), F.lit(0)), F.lit(BUCKETS - 1))
    return rows.select("*", F.col("e.axis").alias("axis"), bucket.cast("int").alias("bucket")).groupBy(*keys, "axis", "bucket").agg(F.count("*").alias("count"), *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def prefix_suffix(histogram: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, axis, split (after bucket), counts and boxes on both sides. At most 3 x 12 rows per key."""
    grid = histogram.select(*keys, "axis").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    full = grid.join(histogram, [*keys, "axis", "bucket"], "left")
    w = Window.partitionBy(*keys, "axis").orderBy("bucket")
    left, right = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    cols = [F.coalesce(F.sum("count").over(side), F.lit(0)).cast("long").alias(f"{name}_count") for name, side in (("left", left), ("right", right))]
    cols += [f(f"{n}_{a}").over(side).alias(f"{name}_{n}_{a}") for name, side in (("left", left), ("right", right)) for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return full.select(*keys, "axis", "bucket", *cols).filter(f"bucket < {BUCKETS - 1}")


def surface_area(prefix: str) -> Column:
    d = [F.col(f"{prefix}max_{a}") - F.col(f"{prefix}min_{a}") for a in AXES]
    return 2 * (d[0] * d[1] + d[1] * d[2] + d[2] * d[0])


def sah_cost(total: Column) -> Column:
    return TRAVERSAL + INTERSECTION * (surface_area("left_") / total * F.col("left_count") + surface_area("right_") / total * F.col("right_count"))


def best_split(sides: DataFrame, whole: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, axis, position, cost and whether the split pays: the cheapest split, the first on ties.

    whole: keys, n and the box (min_x .. max_z) of all objects; one row per key."""
    both = sides.filter("left_count > 0 AND right_count > 0").join(whole, list(keys)) if keys else sides.filter("left_count > 0 AND right_count > 0").join(F.broadcast(whole))
    low = F.element_at(F.array(*[F.col(f"min_{a}") for a in AXES]), F.col("axis") + 1)
    high = F.element_at(F.array(*[F.col(f"max_{a}") for a in AXES]), F.col("axis") + 1)
    cost = sah_cost(surface_area(""))
    best = F.min(F.struct(F.round(cost, 9).alias("cost"), F.col("axis"), F.col("bucket"), (low + (high - low) * (F.col("bucket") + 1) / BUCKETS).alias("position"), F.col("n"))).alias("b")
    picked = both.groupBy(*keys).agg(best) if keys else both.agg(best)
    return picked.select(*keys, "b.axis", "b.position", "b.cost", (F.col("b.cost") < INTERSECTION * F.col("b.n")).alias("pays"))


def kd_tree(objects: DataFrame, levels: int, max_triangles: int = 200_000, max_draw_calls: int = 20) -> DataFrame:
    """id, node, level, x, y, z: a KD-tree by the surface-area heuristic; node is a path of l and r below the root.

    Each level treats all nodes at once: a node keeps what the greedy selection accepts under its budgets, the rest is
    split. Where a split does not pay, and at the last level, the node keeps the whole rest. The right child's index is
    larger by 1 << (level % 3) on the split axis. Boxes and splits are one row a node and are joined to the objects."""
    zero = {a: F.lit(0).cast("long") for a in AXES}
    now, out = objects.withColumn("node", F.lit("")).withColumns({f"t{a}": zero[a] for a in AXES}), None
    kept = lambda rows, level: rows.select("id", "node", F.lit(level).cast("long").alias("level"), *[F.col(f"t{a}").alias(a) for a in AXES])
    for level in range(levels + 1):
        if level == levels:
            return out.unionByName(kept(now, level)) if out is not None else kept(now, level)
        chosen = cut(greedy_select(now, ("node",), max_triangles, draw_call_budget(level, max_draw_calls)))
        took = kept(chosen.filter("accepted"), level)
        out = took if out is None else out.unionByName(took)
        rest = chosen.filter("NOT accepted").drop("accepted")
        if rest.isEmpty():
            return out
        whole = rest.groupBy("node").agg(F.count("*").alias("n"), *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])
        split = cut(best_split(prefix_suffix(sah_histogram(rest, ("node",)), ("node",)), whole, ("node",)))
        marked = rest.join(split, "node", "left")
        value = F.element_at(F.array(*[F.col(f"c{a}") for a in AXES]), F.col("axis") + 1)
        out = out.unionByName(kept(marked.filter("pays IS NULL OR NOT pays"), level))
        right = value > F.col("position")
        moved = {f"t{a}": F.col(f"t{a}") + F.when(right & (F.col("axis") == k), 1 << (level % 3)).otherwise(0) for k, a in enumerate(AXES)}
        now = cut(marked.filter("pays").withColumns({**moved, "node": F.concat("node", F.when(right, "r").otherwise("l"))}).drop("axis", "position", "cost", "pays"))
        if now.isEmpty():
            return out


#: Tiles of the first round of ``first_tile_of``, and how many times more each later round takes.
FIRST_TILES, MORE_TILES = 1024, 8


def _first_hits(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """cx, cy, cz and the least (preorder, tile_id) as first of the tiles that hold the point, where there is one.

    A range join over grids of several levels: a tile's box enters the grid whose cells are as long as the box or up
    to twice that, so it meets at most eight cells, and a point is looked up once in every level that some tile has
    (a short list, from the exponents of their extents). The exact test follows."""
    longest = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES])
    leveled = tiles.withColumn("grid", F.when(longest > 0, F.ceil(F.log2(longest))).otherwise(0).cast("int"))
    levels = sorted(r[0] for r in leveled.select("grid").distinct().collect())
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("grid"))).cast("long")
    for a in AXES:
        leveled = leveled.select("*", F.explode(F.sequence(cell(F.col(f"min_{a}")), cell(F.col(f"max_{a}")))).alias(f"g{a}"))
    keyed = points.select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("grid"))
    keyed = keyed.select("*", *[cell(F.col(f"c{a}")).alias(f"g{a}") for a in AXES])
    hits = keyed.join(leveled, ["grid", *[f"g{a}" for a in AXES]]).filter(centre_in(""))
    return hits.groupBy(*[f"c{a}" for a in AXES]).agg(F.min(F.struct("preorder", "tile_id")).alias("first"))


def first_tile_of(instances: DataFrame, tiles: DataFrame) -> DataFrame:
    """instance_id and the first tile (by preorder, then tile_id) whose box holds the instance's centre; null if none.

    Equal centres are looked up once, and of tiles with equal boxes only the first can be the answer. The tiles come
    in rounds by preorder, each MORE_TILES times as many as all before, and centres that found a tile leave after
    their round, since later tiles come after it: where many tiles overlap, few of them meet a centre. The rounds are
    cut at quantiles; where these fall decides about time only."""
    boxes = [f"{n}_{a}" for a in AXES for n in ("min", "max")]
    centre = [f"c{a}" for a in AXES]
    first = cut(tiles.filter("preorder IS NOT NULL").groupBy(*boxes).agg(F.min(F.struct("preorder", "tile_id")).alias("t")).select(*boxes, "t.*"))
    n = first.count()
    shares = []
    while n > FIRST_TILES * MORE_TILES ** len(shares):
        shares.append(FIRST_TILES * MORE_TILES ** len(shares) / n)
    ends = sorted(set(first.agg(F.percentile_approx("preorder", shares, 100_000)).first()[0])) if shares else []
    points, found = cut(instances.select(*centre).distinct()), None
    for low, high in zip([None, *ends], [*ends, None]) if n else ():
        some = first if low is None else first.filter(F.col("preorder") > low)
        some = some if high is None else some.filter(F.col("preorder") <= high)
        hits = cut(_first_hits(points, some))
        found = hits if found is None else found.unionByName(hits)
        if high is None:
            break
        points = cut(points.join(hits, centre, "left_anti"))
        if points.isEmpty():
            break
    if found is None:
        return instances.select("instance_id", F.lit(None).cast("long").alias("tile_id"))
    return instances.join(found, centre, "left").select("instance_id", F.col("first.tile_id").alias("tile_id"))


def instances(objects: DataFrame, content: tuple[str, ...], least: int = 2) -> DataFrame:
    """content, the number of placements and the smallest id, of contents placed at least twice."""
    return objects.groupBy(*content).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= least)


#: Contents that are broadcast to their placements.
FEW_CONTENTS = 200_000


def placements(objects: DataFrame, groups: DataFrame, content: tuple[str, ...], how: str = "inner") -> DataFrame:
    """objects with first_id of their content's group (inner), or those without a group (left_anti). A content may be
    placed very often: the groups go to the objects."""
    g = groups.select(*[F.col(c).alias(f"__{c}") for c in content], "first_id")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in content]
    joined = objects.join(F.broadcast(g) if g.count() <= FEW_CONTENTS else g, same, how)
    return joined.select(*objects.columns, *(["first_id"] if how == "inner" else []))
