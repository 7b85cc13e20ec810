"""Calibration of variables against the label: alert rate, IV, lift, trend and their gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import ALERT_GROUPS
from ebbtide.functions.columns import is_true, text_rule
from ebbtide.operators import woe
from ebbtide.params import Params

# Fixed value: 99% quantile of the standard normal.
TREND_LIMIT = 2.3263478740408408


def alert_condition(variable: str, rule: str) -> Column:
    """Simple text rules, or the two compound rules by name."""
    if rule == "accel":
        return is_true(F.expr(ALERT_GROUPS["transfers"][3]))
    if rule == "hhi":
        return is_true(F.expr(ALERT_GROUPS["transfers"][5]))
    return text_rule(rule, variable)


def variable_calibration(rows: DataFrame, targets: Mapping[str, tuple], label: str,
                         params: Params) -> DataFrame:
    """One row per variable from one long table: no job per variable."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"),
                               alert_condition(v, t[0]).alias("alert"),
                               F.lit(t[5] == "all").alias("keeps_null"),
                               F.lit(-1 if t[0].startswith("<") else 1).alias("direction"))
                      for v, t in targets.items()])
    long = rows.select("household_id", F.col(label).alias("y"), F.explode(pairs).alias("p")).select(
        "household_id", "y", "p.*")
    known, y = F.col("value").isNotNull(), F.col("y").cast("double")
    rates = long.groupBy("variable").agg(
        F.max("direction").alias("direction"),
        F.avg(F.when(known, F.col("alert").cast("int"))).alias("alert_rate"),
        F.avg(F.when(known & F.col("alert"), y)).alias("_in"),
        F.avg(F.when(known & ~F.col("alert"), y)).alias("_out"),
        (F.avg(F.col("value").isNull().cast("int")) * 100).alias("null_pct"))
    base = long.filter(known | F.col("keeps_null")).select("household_id", "variable", "value", "y")
    table = woe.woe_table(woe.quantile_bins(base, params.woe_bins, params.woe_mass_point))
    return (rates.join(woe.information_value(table), "variable")
                 .join(woe.cochran_armitage(table), "variable", "left")
                 .select("variable", "alert_rate", "iv",
                         F.try_divide("_in", "_out").alias("lift"),
                         (F.col("trend_z") * F.col("direction")).alias("trend_z"), "null_pct"))


def calibration_gate(calibration: DataFrame, targets: Mapping[str, tuple],
                     params: Params) -> DataFrame:
    """Pass or fail of each variable's alert rate, IV band, lift and trend."""
    spark = calibration.sparkSession
    bands = spark.createDataFrame([(v, *map(float, t[1:5])) for v, t in targets.items()],
                                  "variable string, rate_low double, rate_high double, "
                                  "iv_low double, iv_high double")
    tol = params.iv_tolerance
    checks = F.array(*[F.struct(F.lit(name).alias("check_name"), value.alias("value"),
                                is_true(ok).alias("ok")) for name, value, ok in (
        ("alert_rate", F.col("alert_rate"),
         (F.col("alert_rate") >= F.col("rate_low")) & (F.col("alert_rate") <= F.col("rate_high"))),
        ("iv", F.col("iv"), (F.col("iv") >= F.col("iv_low") - tol)
         & (F.col("iv") <= F.col("iv_high") + tol)),
        ("lift", F.col("lift"), F.col("lift") >= params.min_lift),
        ("trend", F.col("trend_z"), F.col("trend_z") > TREND_LIMIT))])
    return calibration.join(F.broadcast(bands), "variable").select(
        "variable", F.explode(checks).alias("c")).select("variable", "c.*")


def run_gate(runs: DataFrame, targets: Mapping[str, tuple], params: Params) -> DataFrame:
    """Median IV over runs in its band and alert rate in range in every run."""
    folded = runs.groupBy("variable").agg(
        F.percentile(F.col("iv"), F.lit(0.5)).alias("median_iv"),
        F.min("alert_rate").alias("low"), F.max("alert_rate").alias("high"))
    spark = runs.sparkSession
    bands = spark.createDataFrame([(v, *map(float, t[1:5])) for v, t in targets.items()],
                                  "variable string, rate_low double, rate_high double, "
                                  "iv_low double, iv_high double")
    tol = params.iv_tolerance
    return folded.join(F.broadcast(bands), "variable").select(
        "variable", "median_iv",
        ((F.col("median_iv") >= F.col("iv_low") - tol)
         & (F.col("median_iv") <= F.col("iv_high") + tol)).alias("iv_ok"),
        ((F.col("low") >= F.col("rate_low")) & (F.col("high") <= F.col("rate_high")))
        .alias("rate_ok"))
