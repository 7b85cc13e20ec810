import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import ordering as o


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    value = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(0, 50, n), 1))
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": rng.integers(0, 3, n), "value": value,
                        "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_running_totals_match_brute_force(frame):
    pdf, df = frame
    got = o.running_totals(df, "value", {"n": F.lit(1), "y": F.col("y")}, ["g"]).toPandas()
    for _, r in got.sample(60, random_state=1).iterrows():
        grp = pdf[pdf.g == r.g]
        assert r.n == (grp.value == r.value).sum()
        assert r.lt_n == (grp.value < r.value).sum()
        assert r.lt_y == grp.loc[grp.value < r.value, "y"].sum()
        assert r.tot_y == grp.y.sum()


def test_row_ranks_break_ties_by_key(frame):
    pdf, df = frame
    got = o.row_ranks(df, "value", "id", ["g"]).toPandas().sort_values(["g", "row_rank"])
    want = pdf.sort_values(["g", "value", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert (got.groupby("g").row_rank.max() == pdf.groupby("g").size()).all()


def test_quantiles_and_medians_equal_numpy(frame):
    pdf, df = frame
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.975, "e": 1.0}
    got = o.exact_quantiles(df, "value", probs, ["g"]).toPandas().set_index("g")
    middle = o.exact_medians(df, "value", "m", ["g"]).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, list(probs)].to_numpy(float),
                                   np.quantile(grp.value, list(probs.values())), atol=1e-9)
        assert middle.loc[g, "m"] == np.median(grp.value)


def test_average_ranks_equal_pandas(frame):
    pdf, df = frame
    got = o.average_ranks(df, "value").toPandas().set_index("value").avg_rank
    want = pdf.assign(r=pdf.value.rank()).groupby("value").r.first()
    np.testing.assert_allclose(got.sort_index(), want.sort_index())


def test_buckets_are_nearly_equal_and_ordered(frame):
    _, df = frame
    got = o.equal_freq_buckets(df, "value", "id", 10).groupBy("bucket").agg(
        F.count("id").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")) \
        .toPandas().sort_values("bucket")
    assert got.bucket.tolist() == list(range(10))
    assert got.n.between(299, 301).all() and (got.hi.values[:-1] <= got.lo.values[1:]).all()


def rows_per_task(df):
    """Rows in each task that has some."""
    return sorted(n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)


@pytest.mark.parametrize("kind", ["large ids", "scores near one", "one value", "lognormal", "two groups"])
def test_any_values_are_dealt_to_all_tasks(spark, kind):
    n, tasks = 40_000, 8
    base = spark.range(n).withColumn("g", F.lit(1))
    value = {"large ids": F.lit(10 ** 15) + F.col("id"), "scores near one": 0.999 + F.col("id") / (n * 1000.0),
             "one value": F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id")),
             "lognormal": F.exp(F.col("id") % 1000 / 50.0) + F.col("id") / 1e6, "two groups": F.col("id").cast("double")}[kind]
    df = base.withColumn("v", value)
    if kind == "two groups":
        df = df.withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(F.when(F.col("id") % 1000 == 1, None).otherwise(2)))
    keys = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        ranked = o.row_ranks(df, "v", "id", ["g"])
        load = rows_per_task(ranked)
        assert len(load) == tasks and load[-1] < 3 * n / tasks and sum(load) == n
        if kind != "one value":
            load = rows_per_task(o.running_totals(df, "v", {"n": F.lit(1)}, ["g"]))
            assert len(load) == tasks and load[-1] < 3 * n / tasks
        got = ranked.toPandas().sort_values(["g", "row_rank"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = got.sort_values(["g", "v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert (got.groupby("g", dropna=False).row_rank.max() == got.groupby("g", dropna=False).size()).all()


def test_blocks_grow_with_the_value_and_split_no_tie(spark):
    df = spark.range(30_000).select((F.col("id") % 15_000 - 2_500).cast("double").alias("v"))
    got = o.with_blocks(df, ["v"]).groupBy("v").agg(F.min("_block").alias("a"), F.max("_block").alias("b")).orderBy("v").toPandas()
    assert (got.a == got.b).all() and got.a.is_monotonic_increasing and got.a.nunique() > 3


def test_odd_values_have_an_order(spark):
    rows = [(float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (None,), (1.5,)] * 2
    got = o.running_totals(spark.createDataFrame(rows, "v double"), "v", {"n": F.lit(1)}).orderBy("v").collect()
    assert [(r.n, r.lt_n, r.tot_n) for r in got] == [(2, 2 * k, 10) for k in range(5)]
    assert o.row_ranks(spark.createDataFrame([], "v double, id long"), "v", "id").count() == 0
    whole = spark.createDataFrame([(2 ** 53 + k,) for k in range(5)], "v long")
    assert [r.lt_n for r in o.running_totals(whole, "v", {"n": F.lit(1)}).orderBy("v").collect()] == [0, 1, 2, 3, 4]
