"""Balance variables on the monthly panel (#1, #2, #6, #17, #18).

The panel is read once: every window of every variable is a conditional aggregate of a single
``groupBy(household_id)``, so no month is ever joined to another month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import cents, ratio_when_positive, safe_pct
from ebbtide.params import Params


def months(low: int, high: int) -> Column:
    return (F.col("month") >= low) & (F.col("month") <= high)


def complete(low: int, high: int) -> Column:
    """True when every month of the window exists and is available."""
    return F.count_if(months(low, high) & F.col("available")) == high - low + 1


def mean_over(value: Column | str, low: int, high: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(months(low, high), value))


def complete_mean(value: Column | str, low: int, high: int) -> Column:
    """Window mean that is NULL unless all its months are available."""
    return F.when(complete(low, high), mean_over(value, low, high))


def value_at(value: Column | str, month: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col("month") == month, value))


def window_sum(value: str, low: int, high: int = 0) -> Column:
    return F.coalesce(F.sum(F.when(months(low, high), F.col(value))), F.lit(0.0))


def window_available(panel: DataFrame, low: int, high: int = 0) -> DataFrame:
    return panel.groupBy("household_id").agg(complete(low, high).alias("window_available"))


def trailing_means(panel: DataFrame, k: int) -> DataFrame:
    return panel.groupBy("household_id").agg(
        complete_mean("deposit_avg_balance", 1 - k, 0).alias("last_mean"),
        complete_mean("deposit_avg_balance", 1 - 2 * k, -k).alias("previous_mean"),
        complete_mean("deposit_avg_balance", -6, -1).alias("baseline_mean"))


def balance_facts() -> list[Column]:
    """Panel aggregates behind the balance variables."""
    deposit, ex_market = "deposit_avg_balance", F.col("aum_month_end") / F.col("twr_index")
    aggs: list[Column] = []
    for k, tag in ((1, "30d"), (3, "90d")):
        aggs += [complete(1 - k, 0).alias(f"ok_{tag}"),
                 (window_sum("aum_withdrawals", 1 - k) - window_sum("aum_contributions", 1 - k))
                 .alias(f"net_out_{tag}"),
                 mean_over("aum_month_end", 1 - k, 0).alias(f"aum_{tag}"),
                 complete(-k, 0).alias(f"flow_ok_{tag}"),
                 (value_at(deposit, 0) - value_at(deposit, -k)).alias(f"flow_{tag}"),
                 mean_over(deposit, 1 - k, 0).alias(f"flow_mean_{tag}")]
    for k, tag in ((1, "30d"), (3, "90d"), (6, "180d")):
        aggs += [complete_mean(deposit, 1 - k, 0).alias(f"last_{tag}"),
                 complete_mean(deposit, 1 - 2 * k, -k).alias(f"previous_{tag}")]
    aggs += [value_at(ex_market, 0).alias("ex_market_now"),
             complete_mean(ex_market, -6, -1).alias("ex_market_base"),
             value_at(deposit, 0).alias("deposit_now"),
             complete_mean(deposit, -6, -1).alias("deposit_base")]
    return aggs


def balance_columns(params: Params) -> list[Column]:
    """Variables from a household row joined with its balance facts."""
    out: list[Column] = []
    floor = params.min_balance_for_pct
    for tag in ("30d", "90d"):
        ok = F.col("has_investments") & F.col(f"ok_{tag}")
        amount = F.greatest(F.col(f"net_out_{tag}"), F.lit(0.0))
        out += [F.when(ok, cents(amount)).alias(f"aum_outflow_{tag}"),
                F.when(ok, ratio_when_positive(amount, F.col(f"aum_{tag}")))
                 .alias(f"aum_outflow_pct_{tag}")]
    for tag in ("30d", "90d", "180d"):
        out.append((safe_pct(F.col(f"last_{tag}"), F.col(f"previous_{tag}"), floor) - 1)
                   .alias(f"deposit_balance_change_pct_{tag}"))
    for tag in ("30d", "90d"):
        flow, mean = F.col(f"flow_{tag}"), F.col(f"flow_mean_{tag}")
        out += [F.when(F.col(f"flow_ok_{tag}"), cents(flow)).alias(f"net_deposit_flow_{tag}"),
                F.when(F.col(f"flow_ok_{tag}"), safe_pct(flow, mean, floor))
                 .alias(f"net_deposit_flow_pct_{tag}")]
    out += [F.when(F.col("has_investments"),
                   ratio_when_positive(F.col("ex_market_now"), F.col("ex_market_base")) - 1)
             .alias("aum_vs_baseline_pct"),
            (safe_pct(F.col("deposit_now"), F.col("deposit_base"), floor) - 1)
             .alias("deposit_balance_vs_6m_avg_pct")]
    return out


def balance_variables(panel: DataFrame, household: DataFrame, params: Params) -> DataFrame:
    facts = panel.groupBy("household_id").agg(*balance_facts())
    wide = household.select("household_id", "has_investments").join(facts, "household_id", "left")
    return wide.select("household_id", *balance_columns(params))
