"""End-to-end feature plans over the canonical tables of one data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import composite, investments, recurring, relationship, transfers
from ebbtide.operators.balances import balance_columns, balance_facts, balance_variables
from ebbtide.params import Params
from ebbtide.plans.memo import plan_memo
from ebbtide.sources import adapters as src

DEFAULT = Params()
EVENT_PARAMS = Params(**src.EVENT_DETECTOR)


def cash_share() -> Column:
    return F.col("household_id") % 20 / 100


@plan_memo
def balances(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    return balance_variables(src.monthly(spark, sf), src.household(spark, sf), params)


def recurring_flows(spark: SparkSession, sf: str, params: Params = EVENT_PARAMS,
                    events: DataFrame | None = None) -> DataFrame:
    events = src.recurring_event(spark, sf) if events is None else events
    return recurring.recurring_variables(src.recurring_tx(spark, sf), events,
                                         src.household(spark, sf), params)


@plan_memo
def transfer_flows(spark: SparkSession, sf: str, params: Params = DEFAULT,
                   ledger: DataFrame | None = None) -> DataFrame:
    ledger = src.transfer(spark, sf) if ledger is None else ledger
    return transfers.transfer_variables(ledger, src.institution(spark, sf), src.monthly(spark, sf),
                                        src.household(spark, sf), params, cash_share())


@plan_memo
def portfolio(spark: SparkSession, sf: str, params: Params = DEFAULT,
              count_rmd: bool = False) -> DataFrame:
    return investments.investment_variables(
        src.monthly(spark, sf), src.transfer(spark, sf), src.portfolio_event(spark, sf),
        src.monthly_cash(spark, sf), _returns(spark, sf), src.household(spark, sf), params,
        count_rmd)


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly returns with the benchmark share tilted per household."""
    tilt = (F.col("household_id") % 11 - 5) / 50
    return src.monthly_return(spark, sf).withColumn("equity_share", F.col("equity_share") + tilt)


@plan_memo
def panel_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Balance, transfer and investment variables together: the panel is folded once for all."""
    panel = investments.panel_with_sales(src.monthly(spark, sf), src.transfer(spark, sf))
    facts = panel.groupBy("household_id").agg(
        *balance_facts(), *transfers.average_balance_facts(), *investments.investment_facts())
    flows = transfers.household_flows(transfers.destination_flows(
        src.transfer(spark, sf), src.institution(spark, sf), DEFAULT), DEFAULT)
    wide = src.household(spark, sf).select("household_id", "has_investments", "has_advisory",
                                           "history_months", cash_share().alias("cash_share"))
    for part in (facts, flows, investments.event_facts(src.portfolio_event(spark, sf)),
                 investments.cash_facts(src.monthly_cash(spark, sf)),
                 investments.return_facts(_returns(spark, sf), DEFAULT)):
        wide = wide.join(part, "household_id", "left")
    return wide.select("household_id", *balance_columns(DEFAULT),
                       *transfers.transfer_columns(DEFAULT), *investments.investment_columns())


@plan_memo
def relations(spark: SparkSession, sf: str) -> DataFrame:
    return relationship.relationship_variables(
        src.account(spark, sf), src.wealth_estimate(spark, sf), src.trust_event(spark, sf),
        src.household(spark, sf))


@plan_memo
def banker(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    return relationship.banker_variables(
        src.household(spark, sf), src.banker(spark, sf), src.household_banker_event(spark, sf),
        src.interaction(spark, sf), params)


@plan_memo
def complaints(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    return relationship.complaint_variables(src.complaint(spark, sf), src.assistant(spark, sf),
                                            src.household(spark, sf), params)


@plan_memo
def bureau(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    return relationship.bureau_variable(src.tradeline(spark, sf), src.bureau(spark, sf),
                                        src.household(spark, sf), params)


def seven_groups(spark: SparkSession, sf: str) -> DataFrame:
    household = src.household(spark, sf).select("household_id")
    return composite.join_features(household, [
        panel_groups(spark, sf), recurring_flows(spark, sf), relations(spark, sf),
        banker(spark, sf), complaints(spark, sf)])


def composite_features(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    return composite.composite_variables(seven_groups(spark, sf), params)


def full_base(spark: SparkSession, sf: str, params: Params = DEFAULT,
              groups: DataFrame | None = None) -> DataFrame:
    """Household attributes, all feature tables, the composite and the bureau variable."""
    groups = seven_groups(spark, sf) if groups is None else groups
    household = src.household(spark, sf)
    wide = composite.join_features(household, [groups, bureau(spark, sf, params)])
    signals = wide.select("household_id", *[
        composite.group_condition(rules, params).cast("int").alias(f"group_alert_{name}")
        for name, rules in composite.ALERT_GROUPS.items()], *[
        c for c in wide.columns if c != "household_id"])
    count = sum((F.col(f"group_alert_{n}") for n in composite.ALERT_GROUPS), F.lit(0))
    return signals.withColumn("multi_signal_count", count).withColumn(
        "multi_signal_flag", (count >= params.multi_signal_min_groups).cast("int"))


def core_base(spark: SparkSession, sf: str, params: Params = DEFAULT) -> DataFrame:
    full = full_base(spark, sf, params)
    extras = tuple(c for c in full.columns if c.startswith("group_alert_"))
    return composite.core_columns(full, src.household(spark, sf).columns,
                                  ("multi_signal_count", *extras))
