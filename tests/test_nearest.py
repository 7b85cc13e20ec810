"""Nearest distances against brute force: outliers, copies, ties, dense cells, lonely points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import nearest

DIMS = ["a", "b", "c"]


def brute(rows):
    out = {}
    for key, group, *x in rows:
        others = [np.array(r[2:]) for r in rows if r[1] == group and r[0] != key]
        if others:
            out[key] = float(np.sqrt(((np.stack(others) - np.array(x)) ** 2).sum(axis=1)).min())
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, a double, b double, c double")


@pytest.mark.parametrize("leaf", [2, 8])
def test_distances_equal_brute_force(spark, leaf):
    rng = np.random.default_rng(5)
    clouds = [("u", rng.normal(size=(150, 3))), ("line", np.c_[rng.normal(size=60), np.zeros((60, 2))]),
              ("ties", rng.integers(0, 3, size=(80, 3)).astype(float)),
              ("far", np.vstack([rng.normal(size=(40, 3)), [[1e6, 0, 0], [0, -1e6, 3]]])),
              ("spike", np.c_[np.r_[np.zeros(90), 1e-9, 5.0], rng.random((92, 2))]), ("one", np.zeros((1, 3)))]
    rows = []
    for name, points in clouds:
        rows += [(len(rows) + i, name, *map(float, p)) for i, p in enumerate(points)]
    found = nearest.nearest_distances(frame(spark, rows), "k", DIMS, "g", leaf).collect()
    want = brute(rows)
    assert {r.k for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert r.nearest == pytest.approx(want[r.k], abs=1e-12)


def test_null_dimension_copies_and_empty_table(spark):
    rows = [(1, "x", 0.0, None, 1.0), (2, "x", -0.0, 0.0, 1.0), (3, "x", 3.0, None, 1.0), (4, None, 1.0, 1.0, 1.0)]
    found = {r.k: r.nearest for r in nearest.nearest_distances(frame(spark, rows), "k", DIMS, "g").collect()}
    assert found == {1: 0.0, 2: 0.0, 3: 3.0}
    assert nearest.nearest_distances(frame(spark, rows).filter("k > 9"), "k", DIMS, "g").count() == 0


def test_dense_cell_is_cut_into_small_leaves(spark):
    # All of 100,000 points lie in one grid cell of width 0.01 beside a far outlier.
    x = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) * 1e-8
    points = spark.range(100_000).select(F.lit("g").alias("grp"), F.col("id").alias("rep"), F.array(
        *[F.when(F.col("id") == 7, 50.0).otherwise(x(i)) for i in range(3)]).alias("x"))
    leaves, levels = nearest.box_tree(points, 3)
    sizes = [r["count"] for r in leaves.groupBy("path").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= nearest.LEAF_POINTS
    assert len(levels) <= 7
