"""External-transfer variables (#7, #8, #21-#25).

The ledger is scanned once and folded to (household, institution, destination) with every window
as a conditional sum.  Grouping sets then give the per-institution and per-destination views of
that much smaller table, and a last ``groupBy(household_id)`` finishes all variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import ACATS, EXTERNAL_OUT, INCOMING
from ebbtide.functions.columns import cents, in_window, safe_pct, sum_when
from ebbtide.operators.balances import complete, mean_over
from ebbtide.params import Params


def semi_join_category(ledger: DataFrame, categories: list[str]) -> DataFrame:
    return ledger.filter(F.col("category").isin(*categories))


def windowed_sums(ledger: DataFrame, windows: dict[str, tuple[int, int]],
                  value: str = "amount") -> DataFrame:
    """Sum per household of each ``(low, high]`` window, all windows in one pass."""
    return ledger.groupBy("household_id").agg(
        *[sum_when(in_window("day", low, high), value).alias(name)
          for name, (low, high) in windows.items()])


BALANCE_WINDOWS = {"balance_30d": 0, "balance_60d": -1, "balance_90d": -2}


def average_balance_facts() -> list[Column]:
    aggs: list[Column] = []
    for name, low in BALANCE_WINDOWS.items():
        aggs += [complete(low, 0).alias(f"{name}_ok"),
                 mean_over("deposit_avg_balance", low, 0).alias(f"{name}_dep"),
                 mean_over("aum_month_end", low, 0).alias(f"{name}_aum")]
    return aggs


def average_balance_column(name: str) -> Column:
    """Deposits plus the cash part of investments; NULL unless the window is complete."""
    cash = F.when(F.col("has_investments"), F.col("cash_share") * F.col(f"{name}_aum")) \
            .otherwise(0.0)
    return F.when(F.col(f"{name}_ok"), F.col(f"{name}_dep") + cash)


def average_balance(panel: DataFrame, household: DataFrame, cash_share: Column) -> DataFrame:
    facts = panel.groupBy("household_id").agg(*average_balance_facts())
    wide = household.select("household_id", "has_investments", cash_share.alias("cash_share")).join(
        facts, "household_id", "left")
    return wide.select("household_id", *[average_balance_column(n).alias(n)
                                         for n in BALANCE_WINDOWS])


def destination_flows(ledger: DataFrame, institutions: DataFrame, params: Params) -> DataFrame:
    """One row per (household, institution, destination) with all window sums.

    The ledger is folded before the institution join, so only the folded rows meet the dimension
    and a popular institution does not pull ledger rows together.
    """
    rows = semi_join_category(ledger, [*EXTERNAL_OUT, INCOMING])
    out, wire = F.col("category") != INCOMING, ~F.col("category").isin(*ACATS, INCOMING)
    lookback = params.lookback_new_destination_days

    def window(low: int, high: int = 0) -> Column:
        return in_window("day", low, high)

    folded = rows.groupBy("household_id", "inst_id", "dest_id").agg(
        *[sum_when(out & window(-w), "amount").alias(f"out_{w}") for w in (30, 60, 90)],
        sum_when(out & window(-60, -30), "amount").alias("out_30_60"),
        sum_when(out & window(-90, -60), "amount").alias("out_60_90"),
        sum_when(out & window(-210, -30), "amount").alias("out_30_210"),
        *[(sum_when(~out & window(-w), "amount") - sum_when(wire & window(-w), "amount"))
          .alias(f"net_{w}") for w in (30, 90)],
        F.count_if(out & window(-90)).alias("sends_90"),
        F.count_if(out & window(-30)).alias("sends_30"),
        F.min(F.when(out, F.col("day"))).alias("first_day"),
        *[F.count_if(out & window(-w - lookback, -w)).alias(f"prior_{w}") for w in (30, 90)])
    known = institutions.select("inst_id", "competitor_bank")
    return folded.join(known, "inst_id", "left").withColumn(
        "competitor_90", F.when(F.col("competitor_bank"), F.col("out_90")).otherwise(0.0))


FLOW_SUMS = ["out_30", "out_60", "out_90", "out_30_60", "out_60_90", "out_30_210",
             "competitor_90", "net_30", "net_90"]


def household_flows(flows: DataFrame, params: Params) -> DataFrame:
    """Fold destination flows to households: totals, new destinations and institution HHI."""
    by_destination = F.grouping("inst_id") == 1
    views = flows.groupingSets([["household_id", "inst_id"], ["household_id", "dest_id"]],
                               "household_id", "inst_id", "dest_id").agg(
        by_destination.alias("is_dest"),
        *[F.sum(c).alias(c) for c in [*FLOW_SUMS, "sends_30", "sends_90", "prior_30", "prior_90"]],
        F.min("first_day").alias("first_day"))
    inst = ~F.col("is_dest")

    def is_new(w: int) -> Column:
        return (F.col("is_dest") & (F.col(f"sends_{w}") > 0) & (F.col("first_day") > -w)
                & (F.col(f"prior_{w}") == 0)
                & (F.col(f"out_{w}") >= params.new_destination_min_cumulative))

    return views.groupBy("household_id").agg(
        *[sum_when(inst, c).alias(c) for c in FLOW_SUMS],
        *[F.count_if(is_new(w)).alias(f"new_{w}") for w in (30, 90)],
        F.sum(F.when(inst & (F.col("sends_90") > 0), F.col("out_90") * F.col("out_90")))
         .alias("square_90"))


def first_seen_prior_absent(ledger: DataFrame, institutions: DataFrame, window: int,
                            params: Params) -> DataFrame:
    """Destinations whose first send is in the window, absent from the look-back, over the floor."""
    flows = destination_flows(ledger, institutions, params)
    counts = household_flows(flows, params)
    return counts.select("household_id",
                         F.col(f"new_{window}").cast("int").alias("new_destinations"))


def concentration(amounts: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """Herfindahl index of ``value`` over ``part`` inside each ``group``: two map-side folds."""
    parts = amounts.groupBy(group, part).agg(F.sum(value).alias("_v"))
    totals = parts.groupBy(group).agg(F.sum(F.col("_v") * F.col("_v")).alias("_sq"),
                                      F.sum("_v").alias("_tot"))
    return totals.select(group, F.try_divide(F.col("_sq"), F.col("_tot") * F.col("_tot"))
                         .alias("hhi"))


def transfer_columns(params: Params) -> list[Column]:
    """Variables from a household row joined with its balance facts and folded flows."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in FLOW_SUMS}
    b30, b60, b90 = (average_balance_column(n) for n in BALANCE_WINDOWS)
    history, floor = F.col("history_months"), params.min_balance_for_pct
    last, previous, oldest = zero["out_30"], zero["out_30_60"], zero["out_60_90"]
    moved = (last + previous + oldest) > 0
    baseline = F.greatest(zero["out_30_210"] / 6, F.lit(params.outflow_baseline_floor_monthly))
    return [
        F.when(history >= 2, cents(zero["out_60"])).alias("external_transfer_amount_60d"),
        safe_pct(zero["out_60"], b60, floor).alias("external_transfer_pct_of_balance_60d"),
        safe_pct(last, b30, floor).alias("external_transfer_pct_of_balance_30d"),
        *[F.when(history >= 13 + w // 30, F.coalesce(F.col(f"new_{w}"), F.lit(0)).cast("int"))
           .alias(f"new_external_destinations_{w}d") for w in (30, 90)],
        F.when(history >= 3, cents(zero["competitor_90"]))
         .alias("transfer_to_competitor_bank_amount_90d"),
        safe_pct(zero["competitor_90"], b90, floor).alias("transfer_to_competitor_pct_90d"),
        F.when(moved & (history >= 3), safe_pct((last - previous) - (previous - oldest), b90, floor))
         .alias("external_transfer_acceleration"),
        safe_pct(last, b90, floor).alias("external_outflow_pct_30d"),
        *[F.when(history >= w // 30, cents(zero[f"net_{w}"])).alias(f"net_external_flow_{w}d")
          for w in (30, 90)],
        safe_pct(zero["net_90"], b90, floor).alias("net_external_flow_pct_90d"),
        F.when(history >= 3, F.try_divide(F.col("square_90"), F.col("out_90") * F.col("out_90")))
         .alias("external_destination_concentration"),
        safe_pct(last + previous + oldest, b90, floor).alias("external_outflow_pct_90d"),
        F.when(history >= 7, last / baseline - 1).alias("outflow_vs_baseline_pct")]


def transfer_variables(ledger: DataFrame, institutions: DataFrame, panel: DataFrame,
                       household: DataFrame, params: Params, cash_share: Column) -> DataFrame:
    folded = household_flows(destination_flows(ledger, institutions, params), params)
    facts = panel.groupBy("household_id").agg(*average_balance_facts())
    wide = (household.select("household_id", "history_months", "has_investments",
                             cash_share.alias("cash_share"))
            .join(facts, "household_id", "left").join(folded, "household_id", "left"))
    return wide.select("household_id", *transfer_columns(params))
