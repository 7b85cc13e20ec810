"""Ledger reconciliation: monthly identity, netting, coherence and rule what-ifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.contract import AUM_EXTERNAL, DEPOSIT_STREAMS, FROM_DEPOSITS
from ebbtide.functions.columns import is_true, month_of
from ebbtide.operators.accounts import open_day
from ebbtide.operators.investments import monthly_category_sums
from ebbtide.params import AVG_MONTH_DAYS, Params


def monthly_income(payments: DataFrame) -> DataFrame:
    return (payments.filter(F.col("stream").isin(*DEPOSIT_STREAMS))
                    .groupBy("household_id", month_of("day").alias("month"))
                    .agg(F.sum("amount").alias("income")))


def ledger_identity(panel: DataFrame, ledger: DataFrame, payments: DataFrame, household: DataFrame,
                    params: Params, card_share: Column) -> DataFrame:
    """Per household-month: balance change explained by the ledgers; the residual closes it.

    The ledgers are folded to (household, month) before any join; the windows run over the months
    of one household, a fixed number of rows.
    """
    first = -17
    sums = monthly_category_sums(ledger, {"deposits_out": FROM_DEPOSITS, "aum_out": AUM_EXTERNAL})
    per_household = Window.partitionBy("household_id")
    months = panel.select("household_id", "month", "deposit_avg_balance", "aum_contributions",
                          "aum_withdrawals", "available")
    prior = per_household.orderBy("month")
    rows = (months.withColumn("change", F.col("deposit_avg_balance")
                              - F.lag("deposit_avg_balance").over(prior))
                  .withColumn("both", F.col("available") & F.lag("available").over(prior))
                  .filter(F.col("month") >= first))
    keys = ["household_id", "month"]
    opening = household.select("household_id", card_share.alias("card_share"), open_day(
        "history_months", params.history_months_cap, params.history_days).alias("open_day"))
    joined = (rows.join(sums, keys, "left").join(monthly_income(payments), keys, "left")
                  .join(opening, "household_id"))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("deposits_out", "aum_out", "income")}
    internal_in = F.greatest(F.col("aum_withdrawals") - zero["aum_out"], F.lit(0.0))
    card = F.col("card_share") * F.avg(zero["income"]).over(per_household)
    residual = (F.col("change") - zero["income"] - F.col("internal_in")
                + F.col("aum_contributions") + zero["deposits_out"] + F.col("card"))
    valid = is_true(F.col("both")) & ((F.col("month") - 1) * AVG_MONTH_DAYS >= F.col("open_day"))
    return (joined.withColumn("internal_in", internal_in).withColumn("card", card)
                  .withColumn("residual", residual)
                  .select(*keys, "change", zero["income"].alias("income"), "internal_in",
                          F.col("aum_contributions").alias("internal_out"),
                          zero["deposits_out"].alias("deposits_out"), "card",
                          F.greatest("residual", F.lit(0.0)).alias("incoming"),
                          F.greatest(-F.col("residual"), F.lit(0.0)).alias("other_debits"),
                          valid.alias("valid")))


def unexplained_share(identity: DataFrame) -> DataFrame:
    return identity.filter("valid").agg(
        F.count(F.lit(1)).alias("months"),
        F.avg((F.col("other_debits") > 0).cast("int")).alias("unexplained_share"),
        F.max(F.abs(F.col("change") - F.col("income") - F.col("internal_in")
                    + F.col("internal_out") - F.col("incoming") + F.col("deposits_out")
                    + F.col("card") + F.col("other_debits"))).alias("max_gap"))


def rule_effect(variant: DataFrame, household: DataFrame, rule: str, name: str,
                alert: Column) -> DataFrame:
    """Alert rate and lift of one variant of a rule among eligible households."""
    eligible = household.filter(~F.col("churn_excluded")).select("household_id", "hard_churn_6m")
    rows = eligible.join(variant.select("household_id", is_true(alert).alias("alert")),
                         "household_id")
    y = F.col("hard_churn_6m").cast("double")
    return rows.agg(
        F.avg(F.col("alert").cast("int")).alias("alert_rate"),
        F.try_divide(F.avg(F.when(F.col("alert"), y)), F.avg(F.when(~F.col("alert"), y)))
         .alias("lift")).select(F.lit(rule).alias("rule"), F.lit(name).alias("variant"),
                                "alert_rate", "lift")


def relabel_excluded(ledger: DataFrame, excluded: list[str]) -> DataFrame:
    """The what-if ledger in which excluded payments count as ordinary external transfers."""
    return ledger.withColumn("category", F.when(F.col("category").isin(*excluded), "background")
                             .otherwise(F.col("category")))


def reconciles(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    joined = left.select(*keys, a).join(right.select(*keys, b), keys)
    return joined.agg(F.count(F.lit(1)).alias("rows"),
                      F.max(F.abs(F.col(a) - F.col(b))).alias("max_gap"))
