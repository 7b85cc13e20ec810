"""Exact nearest-neighbour distances by a tree of bounding boxes, level by level.

Distinct points of a group are cut along their widest dimension at quantiles until every leaf holds
few points.  A point first meets its own leaf; then it walks down the tree and keeps the children
whose box is no farther than its bound, which sinks with the farthest corner of each box seen.  All
steps are joins on (group, node), so no group is ever held in one task and no pair of far leaves meets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.lineage import cut_lineage
from ebbtide.operators.ordering import exact_quantiles

LEAF_POINTS = 64
SLICES = 16  # one hexadecimal digit of the path


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _squared(dims: int) -> Column:
    """Squared distance of ``x`` and ``y``; boxes add up in the same order, so rounding keeps their order."""
    gaps = [F.col("x")[i] - F.col("y")[i] for i in range(dims)]
    return _total([g * g for g in gaps])


def _to_box(dims: int, far: bool) -> Column:
    """Squared distance of ``x`` to the nearest or the farthest place of the box ``lo``, ``hi``."""
    parts = []
    for i in range(dims):
        below, above = F.col("lo")[i] - F.col("x")[i], F.col("x")[i] - F.col("hi")[i]
        gap = F.greatest(F.abs(below), F.abs(above)) if far else F.greatest(below, above, F.lit(0.0))
        parts.append(gap * gap)
    return _total(parts)


def _boxes(points: DataFrame, dims: int) -> DataFrame:
    each = lambda f: F.array(*[f(F.col("x")[i]) for i in range(dims)])
    return points.groupBy("grp", "path").agg(F.count(F.lit(1)).alias("size"), each(F.min).alias("lo"),
                                             each(F.max).alias("hi"), each(F.stddev_pop).alias("spread"))


def _axis(dims: int) -> Column:
    """Dimension of the widest spread among those that hold two values."""
    width = F.array(*[F.when(F.col("hi")[i] > F.col("lo")[i], F.col("spread")[i]).otherwise(-1.0) for i in range(dims)])
    return (F.array_position(width, F.array_max(width)) - 1).cast("int")


def box_tree(points: DataFrame, dims: int, leaf_points: int = LEAF_POINTS) -> tuple[DataFrame, list[DataFrame]]:
    """Cut distinct points (grp, rep, x) into leaves; returns them with ``path`` and one box table per level.

    A cut lies at or above the least and below the greatest value, so every level makes each large
    node smaller.  The cuts may differ between runs; boxes are taken from the points that fell in.
    """
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    active, leaves, levels = points.withColumn("path", F.lit("")), [], []
    while True:
        boxes = cut_lineage(_boxes(active, dims))
        levels.append(boxes.select("grp", "path", "size", "lo", "hi", (F.col("size") <= leaf_points).alias("is_leaf")))
        large = boxes.filter(F.col("size") > leaf_points).select("grp", "path", _axis(dims).alias("axis"))
        if large.isEmpty():
            leaves.append(active)
            return reduce(lambda a, b: a.unionByName(b), leaves), levels
        placed = active.join(large, ["grp", "path"], "left")
        leaves.append(placed.filter("axis IS NULL").drop("axis"))
        inner = placed.filter("axis IS NOT NULL").withColumn("at", F.col("x")[F.col("axis")]).drop("axis")
        cuts = inner.groupBy("grp", "path").agg(
            F.percentile_approx("at", shares, 1000).alias("cuts"), F.min("at").alias("least"),
            F.max("at").alias("most"), F.avg("at").alias("mean"))
        kept = F.array_distinct(F.filter("cuts", lambda c: c < F.col("most")))
        middle = F.array(F.when((F.col("mean") < F.col("most")) & (F.col("mean") >= F.col("least")), F.col("mean"))
                         .otherwise(F.col("least")))
        cuts = cuts.select("grp", "path", F.when(F.size(kept) > 0, kept).otherwise(middle).alias("cuts"))
        digit = F.lower(F.hex(F.size(F.filter("cuts", lambda c: F.col("at") > c))))
        active = cut_lineage(inner.join(cuts, ["grp", "path"]).select(
            "grp", "rep", "x", F.concat("path", digit).alias("path")))


def nearest_of_distinct(points: DataFrame, dims: int, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(rep, nearest) of every distinct point (grp, rep, x) that has another one in its group."""
    leaves, levels = box_tree(points, dims, leaf_points)
    leaves = cut_lineage(leaves.select("grp", "rep", "x", "path"))
    others = leaves.select("grp", "path", F.col("rep").alias("other"), F.col("x").alias("y"))
    own = (leaves.join(others, ["grp", "path"]).filter(F.col("rep") != F.col("other"))
                 .groupBy("rep").agg(F.min(_squared(dims)).alias("bound")))
    start = leaves.withColumnRenamed("path", "home").join(own, "rep", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf"))))
    found = [own.select("rep", F.col("bound").alias("d2"))]
    roots = levels[0].filter("NOT is_leaf").select("grp", F.col("path").alias("node"))
    frontier = start.join(roots, "grp")
    for level in levels[1:]:
        children = level.withColumn("node", F.expr("left(path, length(path) - 1)"))
        inside = F.col("home").startswith(F.col("path"))
        # The farthest corner bounds the distance to any point of the box but the point itself.
        met = frontier.join(children, ["grp", "node"]).filter(F.col("size") > inside.cast("int"))
        met = met.withColumn("bound", F.least("bound", F.min(_to_box(dims, True)).over(Window.partitionBy("rep"))))
        met = cut_lineage(met.filter((_to_box(dims, False) <= F.col("bound")) & ~(F.col("is_leaf") & inside)).select(
            "grp", "rep", "x", "home", "bound", F.col("path").alias("node"), "is_leaf"))
        visits = met.filter("is_leaf").select("grp", "rep", "x", F.col("node").alias("path"))
        found.append(visits.join(others, ["grp", "path"]).groupBy("rep").agg(F.min(_squared(dims)).alias("d2")))
        frontier = met.filter("NOT is_leaf").drop("is_leaf")
    nearest = reduce(lambda a, b: a.unionByName(b), found).groupBy("rep").agg(F.min("d2").alias("d2"))
    return nearest.select("rep", F.sqrt("d2").alias("nearest"))


def nearest_distances(points: DataFrame, key: str, dims: Sequence[str], group: str,
                      leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Exact distance of each point to the nearest other point of its group, one row per point.

    Copies lie at distance 0 and are folded before the search; a NULL coordinate (a dimension
    without spread) counts as 0; a point alone in its group has no row.
    """
    place = F.array(*[F.coalesce(F.col(d).cast("double"), F.lit(0.0)) + 0.0 for d in dims])
    rows = points.select(F.col(key), F.col(group).alias("grp"), place.alias("x"))
    folded = cut_lineage(rows.groupBy("grp", "x").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies")))
    single = nearest_of_distinct(folded.select("grp", "rep", "x"), len(dims), leaf_points)
    known = folded.join(single, "rep", "left").select(
        "grp", "x", F.when(F.col("copies") > 1, 0.0).otherwise(F.col("nearest")).alias("nearest"))
    return rows.join(known.filter("nearest IS NOT NULL"), ["grp", "x"]).select(key, "nearest")


def distance_quantiles(found: DataFrame, radius: float) -> DataFrame:
    """One row: exact p1 and median of the nearest distances, the least, and pairs under ``radius``."""
    found = cut_lineage(found)
    near = F.count_if(F.col("nearest") < radius)
    counts = found.agg(F.count(F.lit(1)).alias("neighboured"), F.min("nearest").alias("min_distance"),
                       F.floor(near / 2).alias("near_pairs"))
    return counts.crossJoin(F.broadcast(exact_quantiles(found, "nearest", {"p01": 0.01, "median": 0.5})))  # one row each
