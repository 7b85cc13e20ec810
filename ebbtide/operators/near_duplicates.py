"""Near duplicates: epsilon join inside identical flag combinations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(dims: Sequence[str], eps: float, neighbours: bool) -> Column:
    """Grid cell of a point, or the cells a neighbour within ``eps`` can be in."""
    def steps(d: str) -> Column:
        here = F.floor(F.col(d) / eps)
        return F.array(here - 1, here, here + 1) if neighbours else F.array(here)

    cells = F.transform(steps(dims[0]), lambda a: a.cast("string"))
    for d in dims[1:]:
        more = steps(d)
        cells = F.flatten(F.transform(cells, lambda c: F.transform(
            more, lambda b: F.concat_ws(":", c, b.cast("string")))))
    return cells


def selective_dims(points: DataFrame, dims: Sequence[str], eps: float, count: int) -> list[str]:
    """The dimensions that spread the points over most grid steps: one row of sketches."""
    row = points.agg(*[F.approx_count_distinct(F.floor(F.col(d) / eps)).alias(d)
                       for d in dims]).first()
    return sorted(dims, key=lambda d: -row[d])[:count]


def near_neighbours(points: DataFrame, key: str, dims: Sequence[str], flags: str,
                    eps: float, grid_dims: int = 4) -> DataFrame:
    """Each point's nearest distance below ``eps`` within its flag combination.

    Identical points are folded first, so a group of copies costs one row instead of all its
    pairs; distinct points meet only in the same or an adjacent cell of a grid over the most
    selective dimensions.
    """
    dims = list(dims)
    folded = points.groupBy(flags, *dims).agg(F.min(key).alias("_rep"),
                                             F.count(F.lit(1)).alias("_copies"))
    grid = selective_dims(folded, dims, eps, grid_dims)
    left = folded.withColumn("_cell", F.element_at(_cells(grid, eps, False), 1))
    right = folded.select(flags, F.col("_rep").alias("_other"),
                          *[F.col(d).alias(f"o_{d}") for d in dims],
                          F.explode(_cells(grid, eps, True)).alias("_cell"))
    squared = reduce(lambda a, b: a + b, [(F.col(d) - F.col(f"o_{d}"))
                                          * (F.col(d) - F.col(f"o_{d}")) for d in dims])
    close = (left.join(right, [flags, "_cell"]).filter(F.col("_rep") != F.col("_other"))
                 .withColumn("_d", F.sqrt(squared)).filter(F.col("_d") < eps)
                 .groupBy("_rep").agg(F.min("_d").alias("_near")))
    nearest = folded.join(close, "_rep", "left").select(
        flags, *dims, F.when(F.col("_copies") > 1, 0.0).otherwise(F.col("_near")).alias("nearest"))
    return (points.join(nearest.filter("nearest IS NOT NULL"), [flags, *dims])
                  .select(key, "nearest"))


def near_duplicate_summary(neighbours: DataFrame) -> DataFrame:
    return neighbours.agg(F.count(F.lit(1)).alias("near_rows"),
                          F.floor(F.count(F.lit(1)) / 2).alias("near_pairs"),
                          F.min("nearest").alias("min_distance"))
