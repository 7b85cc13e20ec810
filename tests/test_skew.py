"""Hot keys: one household, one institution and one value hold a third or more of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import ordering, transfers
from ebbtide.params import Params


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    third = rng.random(n) < 0.4
    pdf = pd.DataFrame({
        "household_id": np.where(third, 1, rng.integers(2, 200, n)),
        "day": -rng.integers(0, 548, n), "amount": np.round(rng.gamma(2, 4000, n), 2),
        "category": rng.choice(["background", "one_off", "incoming", "move_acats", "biller"], n),
        "inst_id": np.where(rng.random(n) < 0.5, 3, rng.integers(0, 40, n)),
        "dest_id": rng.integers(0, 300, n)})
    return pdf, spark.createDataFrame(pdf).repartition(9)


def test_household_flows_match_pandas(spark, hot):
    pdf, df = hot
    inst = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)],
                                 "inst_id long, competitor_bank boolean")
    p = Params(new_destination_min_cumulative=5_000.0)
    got = transfers.household_flows(transfers.destination_flows(df, inst, p), p).toPandas() \
        .set_index("household_id")
    ext = pdf[pdf.category.isin(["background", "one_off", "move_acats"])]
    for h in (1, 2, 57, 199):
        e = ext[ext.household_id == h]
        w = e[e.day > -90]
        assert got.out_90[h] == pytest.approx(w.amount.sum())
        assert got.competitor_90[h] == pytest.approx(w[w.inst_id % 3 == 0].amount.sum())
        shares = w.groupby("inst_id").amount.sum()
        assert got.square_90[h] == pytest.approx((shares ** 2).sum())
        new = 0
        for _, d in e.groupby("dest_id"):
            inside = d[d.day > -90]
            prior = d[(d.day > -90 - 365) & (d.day <= -90)]
            new += (len(inside) > 0 and d.day.min() > -90 and len(prior) == 0
                    and inside.amount.sum() >= 5_000)
        assert got.new_90[h] == new


def test_concentration_of_a_hot_household(hot):
    pdf, df = hot
    got = transfers.concentration(df, "household_id", "inst_id", "amount").toPandas() \
        .set_index("household_id").hhi
    s = pdf[pdf.household_id == 1].groupby("inst_id").amount.sum()
    assert got[1] == pytest.approx(((s / s.sum()) ** 2).sum())


def test_ranks_of_one_value_are_complete_and_ordered(spark):
    df = spark.range(30_000).withColumn("v", F.when(F.col("id") % 3 == 0, 7.0).otherwise(1.0))
    got = ordering.row_ranks(df, "v", "id").orderBy("row_rank").toPandas()
    assert got.row_rank.tolist() == list(range(1, 30_001))
    assert got[got.v == 7.0].id.is_monotonic_increasing
    assert got.v.is_monotonic_increasing
