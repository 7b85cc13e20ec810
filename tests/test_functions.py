import math

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import pvalues as pv
from ebbtide.functions.columns import (in_window, is_whole_cents, month_of, routing_is_valid,
                                       safe_pct, text_rule)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_month_and_window_edges(spark):
    days = spark.createDataFrame([(0,), (-30,), (-31,), (-90,), (-89,)], "day int")
    rows = {r.day: (r.m, r.w) for r in days.select(
        "day", month_of("day").alias("m"), in_window("day", -90).alias("w")).collect()}
    assert rows == {0: (0, True), -30: (0, True), -31: (-1, True), -90: (-2, False),
                    -89: (-2, True)}


def test_safe_pct_floor_is_inclusive(spark):
    row = one(spark, below=safe_pct(F.lit(1.0), F.lit(9999.99), 10_000),
              at=safe_pct(F.lit(1.0), F.lit(10_000.0), 10_000))
    assert row.below is None and row.at == pytest.approx(1e-4)


def test_null_never_alerts(spark):
    row = one(spark, a=text_rule("> 0.1", F.lit(None).cast("double")),
              b=text_rule("<= -0.25", F.lit(-0.25)), c=text_rule("= 1", F.lit(1)))
    assert (row.a, row.b, row.c) == (False, True, True)


def test_routing_number(spark):
    numbers = [("011000015", True), ("121000358", True), ("011000014", False)]
    df = spark.createDataFrame(numbers, "aba string, want boolean")
    assert df.filter(routing_is_valid("aba") != F.col("want")).count() == 0


def test_whole_cents(spark):
    row = one(spark, a=is_whole_cents(F.lit(10.25)), b=is_whole_cents(F.lit(10.255)))
    assert row.a and not row.b


@pytest.mark.parametrize("value,expected", [
    (pv.normal_two_sided(1.959963985), 0.05), (pv.chi2_sf(3.841459, 1), 0.05),
    (pv.chi2_sf(18.307038, 10), 0.05), (pv.t_two_sided(2.228139, 10), 0.05),
    (pv.beta_cdf(0.5, 2, 2), 0.5), (pv.beta_cdf(0.2, 2, 5), 0.34464),
    (pv.gamma_p(2, 2), 1 - 3 * math.exp(-2)), (pv.binomial_two_sided(3, 10, 0.5), 0.34375),
    (pv.binomial_two_sided(8, 10, 0.3), 0.0015904), (pv.normal_ppf(0.99), 2.326348)])
def test_distribution_functions(value, expected):
    assert value == pytest.approx(expected, abs=1e-5)


def test_poisson_quantile():
    def cdf(k, rate):
        return sum(math.exp(-rate) * rate ** i / math.factorial(i) for i in range(k + 1))
    k = pv.poisson_upper_quantile(3.0, 0.999)
    assert cdf(k, 3.0) >= 0.999 > cdf(k - 1, 3.0)
