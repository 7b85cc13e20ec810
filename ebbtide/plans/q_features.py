"""Queries of the 37 variables, their alerts and the assembled base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.contract import ALERT_GROUPS
from ebbtide.functions.columns import text_rule
from ebbtide.operators import balances, investments, recurring, relationship, transfers
from ebbtide.plans import features as plan
from ebbtide.plans.registry import query
from ebbtide.sources import adapters as src

VARIABLES = {
    "aum_outflow": (plan.balances, ["aum_outflow_30d", "aum_outflow_90d", "aum_outflow_pct_30d",
                                    "aum_outflow_pct_90d"]),
    "deposit_balance_change_pct": (plan.balances, [
        "deposit_balance_change_pct_30d", "deposit_balance_change_pct_90d",
        "deposit_balance_change_pct_180d"]),
    "aum_vs_baseline_pct": (plan.balances, ["aum_vs_baseline_pct"]),
    "deposit_balance_vs_6m_avg_pct": (plan.balances, ["deposit_balance_vs_6m_avg_pct"]),
    "net_deposit_flow": (plan.balances, ["net_deposit_flow_30d", "net_deposit_flow_90d",
                                         "net_deposit_flow_pct_30d", "net_deposit_flow_pct_90d"]),
    "salary_deposit_stopped_flag": (plan.recurring_flows, ["salary_deposit_stopped_flag"]),
    "recurring_deposit_stopped_flag": (plan.recurring_flows, [
        "recurring_deposit_stopped_flag", "recurring_deposit_stopped_type"]),
    "recurring_deposit_change_pct": (plan.recurring_flows, ["recurring_deposit_change_pct"]),
    "pension_deposit_stopped_flag": (plan.recurring_flows, ["pension_deposit_stopped_flag"]),
    "business_payroll_stopped_flag": (plan.recurring_flows, ["business_payroll_stopped_flag"]),
    "external_transfer_amount_60d": (plan.transfer_flows, [
        "external_transfer_amount_60d", "external_transfer_pct_of_balance_60d",
        "external_transfer_pct_of_balance_30d"]),
    "new_external_destinations": (plan.transfer_flows, ["new_external_destinations_30d",
                                                        "new_external_destinations_90d"]),
    "transfer_to_competitor": (plan.transfer_flows, ["transfer_to_competitor_bank_amount_90d",
                                                     "transfer_to_competitor_pct_90d"]),
    "external_transfer_acceleration": (plan.transfer_flows, ["external_transfer_acceleration",
                                                             "external_outflow_pct_30d"]),
    "net_external_flow": (plan.transfer_flows, [
        "net_external_flow_30d", "net_external_flow_90d", "net_external_flow_pct_90d"]),
    "external_destination_concentration": (plan.transfer_flows, [
        "external_destination_concentration", "external_outflow_pct_90d"]),
    "outflow_vs_baseline_pct": (plan.transfer_flows, ["outflow_vs_baseline_pct"]),
    "investment_redemption_pct": (plan.portfolio, ["investment_redemption_pct"]),
    "fixed_income_maturity_not_reinvested": (plan.portfolio, [
        "fixed_income_maturity_not_reinvested", "fixed_income_not_reinvested_amount"]),
    "cash_pct_of_portfolio_chg": (plan.portfolio, ["cash_pct_of_portfolio_chg"]),
    "return_vs_benchmark": (plan.portfolio, ["return_vs_benchmark"]),
    "positions_liquidated_pct": (plan.portfolio, ["positions_liquidated_pct"]),
    "products_closed": (plan.relations, ["products_closed_90d", "products_closed_180d"]),
    "accounts_closed": (plan.relations, ["accounts_closed_90d", "accounts_closed_180d"]),
    "share_of_wallet": (plan.relations, ["share_of_wallet", "wealth_estimate_source"]),
    "share_of_wallet_change": (plan.relations, ["share_of_wallet_change"]),
    "trustee_change_flag": (plan.relations, ["trustee_change_flag"]),
    "banker_change_6m_flag": (plan.banker, ["banker_change_6m_flag", "banker_change_reason"]),
    "contact_gap_ratio": (plan.banker, ["days_since_meaningful_contact", "contact_gap_ratio"]),
    "client_reply_rate": (plan.banker, ["client_reply_rate"]),
    "meetings_cancelled": (plan.banker, ["meetings_cancelled_by_client",
                                         "meetings_cancelled_pct"]),
    "complaint_escalated_flag": (plan.complaints, ["complaint_escalated_flag"]),
    "open_complaint": (plan.complaints, ["open_complaint_flag", "complaint_age_days",
                                         "complaint_out_of_sla_flag"]),
    "repeat_complaint_flag": (plan.complaints, ["repeat_complaint_flag"]),
    "complaints_12m": (plan.complaints, ["complaints_12m"]),
    "relationship_dissatisfaction_flag": (plan.complaints, ["relationship_dissatisfaction_flag"]),
    "bureau_new_mortgage_elsewhere": (plan.bureau, ["bureau_new_mortgage_elsewhere"]),
}
# Only the columns asked for are computed: Catalyst prunes the other aggregates of the group.
for _name, (_plan, _columns) in VARIABLES.items():
    query(_name)(lambda spark, sf, p=_plan, c=_columns: p(spark, sf).select("household_id", *c))


@query("multi_signal")
def multi_signal(spark, sf):
    return plan.composite_features(spark, sf)


@query("external_transfer_alerts")
def external_transfer_alerts(spark, sf):
    """Flagship: #7 over 60 days with its alert."""
    pct = "external_transfer_pct_of_balance_60d"
    return plan.transfer_flows(spark, sf).select(
        "household_id", "external_transfer_amount_60d", pct,
        text_rule("> 0.15", pct).cast("int").alias("alert"))


@query("assemble_core_full")
def assemble_core_full(spark, sf):
    from ebbtide.contract import PRIMARY_COLUMNS
    return plan.core_base(spark, sf).select(
        "household_id", "snapshot_date", "segment", *sorted(set(PRIMARY_COLUMNS.values())),
        "multi_signal_count", *[f"group_alert_{g}" for g in ALERT_GROUPS], "hard_churn_6m")


@query("window_available")
def window_available(spark, sf):
    return balances.window_available(src.monthly(spark, sf), -2)


@query("trailing_mean")
def trailing_mean(spark, sf):
    return balances.trailing_means(src.monthly(spark, sf), 3)


@query("average_balance")
def average_balance(spark, sf):
    return transfers.average_balance(src.monthly(spark, sf), src.household(spark, sf),
                                     plan.cash_share())


@query("windowed_sum", w60=2, w90_30=2)
def windowed_sum(spark, sf):
    return transfers.windowed_sums(src.transfer(spark, sf), {"w60": (-60, 0), "w90_30": (-90, -30)})


@query("hhi")
def hhi(spark, sf):
    ledger = transfers.semi_join_category(src.transfer(spark, sf), transfers.EXTERNAL_OUT)
    return transfers.concentration(ledger.filter("day > -90"), "household_id", "inst_id", "amount")


@query("first_seen_prior_absent")
def first_seen(spark, sf):
    return transfers.first_seen_prior_absent(src.transfer(spark, sf), src.institution(spark, sf),
                                             90, plan.DEFAULT)


@query("non_acats_withdrawals", sold_for_withdrawal=2)
def non_acats(spark, sf):
    return investments.non_acats_withdrawals(src.monthly(spark, sf), src.transfer(spark, sf))


@query("conditional_sum_by_month", acats=2, deposits_out=2)
def month_sums(spark, sf):
    from ebbtide.contract import ACATS, FROM_DEPOSITS
    return investments.monthly_category_sums(
        src.transfer(spark, sf), {"acats": ACATS, "deposits_out": FROM_DEPOSITS})


@query("product_compound_return")
def product_return(spark, sf):
    year = src.monthly_return(spark, sf).filter("month > -12")
    return year.groupBy("household_id").agg(
        investments.compound_return("portfolio_return").alias("return_12m"))


def _stops(spark, sf):
    return recurring.stream_stops(src.recurring_tx(spark, sf), plan.EVENT_PARAMS)


@query("detect_recurring")
def detect(spark, sf):
    """Second-pass pattern of every stream with a payment in its look-back."""
    stops = _stops(spark, sf).filter("median_amount IS NOT NULL")
    return stops.select("household_id", F.col("case").alias("evaluation"), "stream",
                        F.col("exists").alias("pattern_exists"),
                        "interval", "median_amount").withColumnRenamed("interval", "interval_days")


@query("evaluate_stop")
def evaluate_stop(spark, sf):
    stops = _stops(spark, sf).filter("exists AND case <> 'change'")
    return stops.select("household_id", F.col("case").alias("evaluation"), "stream",
                        F.col("last_day").cast("int").alias("last_day"), "stopped")


@query("last_credit")
def last_credit(spark, sf):
    return recurring.last_credit(src.recurring_tx(spark, sf), ["household_id", "stream"],
                                 F.lit(100.0))


@query("stop_threshold")
def stop_threshold(spark, sf):
    gaps = recurring.gap_statistics(src.recurring_tx(spark, sf), ["household_id", "stream"])
    return gaps.select("household_id", "stream",
                       recurring.stop_threshold(F.col("interval"), plan.DEFAULT).alias("threshold"))


@query("lag_diff")
def lag_diff(spark, sf):
    return recurring.gap_statistics(src.recurring_tx(spark, sf), ["household_id", "stream"]).select(
        "household_id", "stream", "payments", "gap_count", "gap_mean", "gap_std",
        F.col("interval").alias("gap_median"))


@query("stream_weight")
def stream_weight(spark, sf):
    weights = recurring.stream_weights(_stops(spark, sf))
    return weights.filter("exists").select("household_id", "stream", "monthly_equivalent", "weight")


def _decisions(spark, sf):
    return recurring.recurring_decisions(src.recurring_tx(spark, sf),
                                         src.recurring_event(spark, sf), plan.EVENT_PARAMS)


@query("payroll_replacement")
def payroll_replacement(spark, sf):
    return _decisions(spark, sf).filter("replaced").select("household_id")


@query("stopped_type")
def stopped_type(spark, sf):
    return _decisions(spark, sf).filter("any_stop").select("household_id", "stopped_type")


@query("reported_exclusions")
def reported_exclusions(spark, sf):
    """Stopped payrolls whose flag is 0 only because the event was reported."""
    d = _decisions(spark, sf).filter(
        (F.col("old_pay_stopped") & ~F.col("replaced")) | F.col("new_pay_stopped"))
    return d.filter("retire_reported OR leave_reported OR death_reported").select(
        "household_id", "retire_reported", "leave_reported", "death_reported")


@query("banker_changes")
def banker_changes(spark, sf):
    return relationship.banker_changes(
        src.household(spark, sf), src.banker(spark, sf), src.household_banker_event(spark, sf),
        plan.DEFAULT).select("household_id", "change_day", "change_reason")


@query("first_reason_wins")
def first_reason_wins(spark, sf):
    changes = relationship.banker_changes(
        src.household(spark, sf), src.banker(spark, sf), src.household_banker_event(spark, sf),
        plan.DEFAULT)
    return changes.filter("change_reason IS NOT NULL").groupBy("change_reason").agg(
        F.count(F.lit(1)).alias("households"), F.min("change_day").alias("first_day"))


@query("propagate_parent_event")
def propagate(spark, sf):
    gone = src.banker(spark, sf).filter("departure_day IS NOT NULL")
    return (src.household(spark, sf).join(gone, "banker_id")
            .select("household_id", "banker_id", F.col("departure_day").cast("int")
                    .alias("departure_day")))


@query("reply_within_7d")
def reply_within(spark, sf):
    log = src.interaction(spark, sf)
    reply = F.col("day") + (F.col("minutes").cast("int") % 12)
    return log.withColumn("ok", relationship.reply_within(F.col("day"), reply, plan.DEFAULT)) \
              .groupBy("household_id").agg(F.count(F.lit(1)).alias("contacts"),
                                           F.count_if("ok").alias("replied"))


@query("ratio_of_counts")
def ratio_of_counts(spark, sf):
    counts = relationship.interaction_counts(src.interaction(spark, sf), plan.DEFAULT)
    return counts.select("household_id", "contacts", "replies", "meetings", "cancelled",
                         F.try_divide("replies", "contacts").alias("reply_rate"))


@query("complaint_lifecycle")
def complaint_lifecycle(spark, sf):
    return src.complaint(spark, sf)


@query("two_level_max_count")
def two_level(spark, sf):
    pairs = src.complaint(spark, sf).groupBy("household_id", "category").count()
    return pairs.groupBy("household_id").agg(F.max("count").alias("same_category"))
