"""Investment variables (#9, #26, #27, #28, #34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import ACATS
from ebbtide.functions.columns import cents, in_window, month_of, ratio_when_positive, sum_when
from ebbtide.operators.balances import complete, mean_over, value_at, window_sum
from ebbtide.params import Params


def monthly_category_sums(ledger: DataFrame, sums: dict[str, list[str]]) -> DataFrame:
    """Per household-month sums, one output column per set of categories, in one pass."""
    wanted = sorted({c for group in sums.values() for c in group})
    return (ledger.filter(F.col("category").isin(*wanted))
                  .groupBy("household_id", month_of("day").alias("month"))
                  .agg(*[sum_when(F.col("category").isin(*group), "amount").alias(name)
                         for name, group in sums.items()]))


def non_acats_withdrawals(panel: DataFrame, ledger: DataFrame) -> DataFrame:
    """Withdrawals financed by selling: the part of the month that did not leave by ACATS."""
    return panel_with_sales(panel, ledger).select("household_id", "month", "sold_for_withdrawal")


def compound_return(rate: Column | str) -> Column:
    rate = F.col(rate) if isinstance(rate, str) else rate
    return F.product(rate + 1) - 1


def panel_with_sales(panel: DataFrame, ledger: DataFrame) -> DataFrame:
    """Panel rows with the month's withdrawals financed by selling."""
    acats = monthly_category_sums(ledger, {"acats": [c for c in ACATS if c != "shock_aum"]})
    sold = F.greatest(F.col("aum_withdrawals") - F.coalesce("acats", F.lit(0.0)), F.lit(0.0))
    return panel.join(acats, ["household_id", "month"], "left").withColumn(
        "sold_for_withdrawal", sold).drop("acats")


def investment_facts() -> list[Column]:
    return [complete(-2, 0).alias("ok_3"), complete(-3, 0).alias("ok_4"),
            complete(-6, 0).alias("ok_7"), mean_over("aum_month_end", -2, 0).alias("aum_90"),
            value_at("aum_month_end", -3).alias("aum_start"),
            window_sum("sold_for_withdrawal", -2).alias("sold_90"),
            window_sum("aum_contributions", -2).alias("contrib_90")]


def event_facts(events: DataFrame) -> DataFrame:
    kind, recent = F.col("kind"), in_window("day", -90)
    return events.filter(recent).groupBy("household_id").agg(
        sum_when(kind.isin("liq", "prop", "fsale", "mat"), "amount").alias("sales"),
        sum_when(kind == "rmd", "amount").alias("rmd"),
        sum_when(kind == "reinv", "amount").alias("reinvested"),
        sum_when(kind == "mat", "amount").alias("matured"),
        (sum_when(kind == "liq", F.col("amount") * F.col("full_share"))
         + sum_when(kind.isin("prop", "fsale"), "amount")).alias("full_sales"))


def cash_facts(cash: DataFrame) -> DataFrame:
    recent = cash.filter((F.col("month") >= -6) & (F.col("month") <= 0))
    return recent.groupBy("household_id").agg(value_at("cash_pct", 0).alias("cash_now"),
                                              mean_over("cash_pct", -6, -1).alias("cash_base"))


def return_facts(returns: DataFrame, params: Params) -> DataFrame:
    """Twelve-month compounded return over the profile benchmark."""
    beta = F.greatest(F.lit(params.benchmark_beta_low),
                      F.least(F.lit(params.benchmark_beta_high), F.col("equity_share")))
    benchmark = beta * F.col("market_return") + (1 - beta) * params.non_equity_return_monthly
    return returns.filter((F.col("month") > -12) & (F.col("month") <= 0)).groupBy(
        "household_id").agg((compound_return("portfolio_return")
                             - compound_return(benchmark)).alias("excess"))


def investment_columns(count_rmd: bool = False) -> list[Column]:
    """Variables from a household row joined with its facts; ``count_rmd`` is the rule's what-if."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0))
            for c in ("sales", "rmd", "reinvested", "matured", "full_sales")}
    invests, matured = F.col("has_investments"), zero["matured"]
    sold = F.col("sold_90") + zero["sales"] - (F.lit(0.0) if count_rmd else zero["rmd"])
    net = F.greatest(sold - F.col("contrib_90") - zero["reinvested"], F.lit(0.0))
    return [
        F.when(invests & F.col("ok_3"), ratio_when_positive(net, F.col("aum_90")))
         .alias("investment_redemption_pct"),
        F.when(invests & (matured > 0), 1 - zero["reinvested"] / matured)
         .alias("fixed_income_maturity_not_reinvested"),
        F.when(invests & (matured > 0), cents(matured - zero["reinvested"]))
         .alias("fixed_income_not_reinvested_amount"),
        F.when(invests & F.col("ok_7"), F.col("cash_now") - F.col("cash_base"))
         .alias("cash_pct_of_portfolio_chg"),
        F.when(F.col("has_advisory") & (F.col("history_months") >= 12), F.col("excess"))
         .alias("return_vs_benchmark"),
        F.when(invests & F.col("ok_4"), ratio_when_positive(zero["full_sales"], F.col("aum_start")))
         .alias("positions_liquidated_pct")]


def investment_variables(panel: DataFrame, ledger: DataFrame, events: DataFrame, cash: DataFrame,
                         returns: DataFrame, household: DataFrame, params: Params,
                         count_rmd: bool = False) -> DataFrame:
    facts = panel_with_sales(panel, ledger).groupBy("household_id").agg(*investment_facts())
    wide = household.select("household_id", "has_investments", "has_advisory", "history_months")
    for part in (facts, event_facts(events), cash_facts(cash), return_facts(returns, params)):
        wide = wide.join(part, "household_id", "left")
    return wide.select("household_id", *investment_columns(count_rmd))
