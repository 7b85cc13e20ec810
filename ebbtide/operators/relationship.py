"""Relationship, banker and complaint variables (#10-#15, #29-#33, #35, #36) and bureau (#37)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import (CADENCE_DAYS, EXCLUDED_ACCOUNT_REASONS, EXCLUDED_PRODUCT_REASONS)
from ebbtide.functions.columns import count_when, flag_or_null, in_window, is_true
from ebbtide.operators.accounts import first_reason_wins, lookup
from ebbtide.params import Params


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("int")


def closures(accounts: DataFrame, exclude: bool = True) -> DataFrame:
    """Closed products and accounts per household, folded to products first."""
    reason = F.coalesce(F.col("close_reason"), F.lit(""))
    product_ok = ~reason.isin(*EXCLUDED_PRODUCT_REASONS) if exclude else F.lit(True)
    account_ok = ~reason.isin(*EXCLUDED_ACCOUNT_REASONS) if exclude else F.lit(True)
    closed = accounts.filter(in_window("close_day", -180))
    products = closed.groupBy("household_id", "product").agg(
        *[F.count_if(product_ok & in_window("close_day", -w)).alias(f"product_{w}")
          for w in (90, 180)],
        *[F.count_if(account_ok & in_window("close_day", -w)).alias(f"account_{w}")
          for w in (90, 180)])
    return products.groupBy("household_id").agg(
        *[F.count_if(F.col(f"product_{w}") > 0).alias(f"products_{w}") for w in (90, 180)],
        *[F.sum(f"account_{w}").alias(f"accounts_{w}") for w in (90, 180)])


def closure_variables(accounts: DataFrame, household: DataFrame, exclude: bool = True) -> DataFrame:
    wide = household.select("household_id", "history_months").join(
        closures(accounts, exclude), "household_id", "left")
    return wide.select("household_id", *[
        F.when(F.col("history_months") >= w // 30, _zero(f"{what}_{w}"))
         .alias(f"{what}_closed_{w}d")
        for w in (90, 180) for what in ("products", "accounts")])


def wallet_variables(wealth: DataFrame, household: DataFrame) -> DataFrame:
    """Share of wallet on the best wealth source: declared, then vendor, then model."""
    total = F.coalesce("declared", "vendor", "model")
    source = (F.when(F.col("declared").isNotNull(), "declared")
               .when(F.col("vendor").isNotNull(), "vendor").when(F.col("model").isNotNull(), "model"))
    now = F.least(F.lit(1.0), F.try_divide(F.col("value_t"), total))
    before = F.least(F.lit(1.0), F.try_divide(F.col("value_6m"), F.col("wealth_old")))
    wide = household.select("household_id", "history_months").join(wealth, "household_id", "left")
    return wide.select("household_id", F.when(total.isNotNull(), now).alias("share_of_wallet"),
                       source.alias("wealth_estimate_source"),
                       F.when(F.col("history_months") >= 7, now - before)
                        .alias("share_of_wallet_change"))


def trustee_variables(events: DataFrame, household: DataFrame) -> DataFrame:
    changed = events.groupBy("household_id").agg(
        F.bool_or(F.col("kind") != "death_succession").alias("changed"))
    wide = household.select("household_id", "has_trust").join(changed, "household_id", "left")
    return wide.select("household_id", flag_or_null(F.col("has_trust"), F.col("changed"))
                       .alias("trustee_change_flag"))


def relationship_variables(accounts: DataFrame, wealth: DataFrame, trust: DataFrame,
                           household: DataFrame) -> DataFrame:
    return (closure_variables(accounts, household)
            .join(wallet_variables(wealth, household), "household_id")
            .join(trustee_variables(trust, household), "household_id"))


def banker_changes(household: DataFrame, bankers: DataFrame, events: DataFrame,
                   params: Params) -> DataFrame:
    """Change day and reason per household; a departure reaches every household of the book."""
    wide = (household.select("household_id", "history_months", "banker_id", "segment")
            .join(bankers, "banker_id", "left").join(events, "household_id", "left"))
    lasting = F.col("temporary_length") >= params.temporary_cover_days
    day, reason = first_reason_wins([
        ("banker_departure", F.col("departure_day")),
        ("client_request", F.col("client_request_day")),
        ("book_rebalancing", F.col("rebalance_day")),
        ("reassignment", F.when(lasting, F.col("temporary_day")))])
    in_six_months = in_window(day, -180)
    return wide.select("household_id", "history_months", "segment", "cancelled_by_captured",
                       F.when(in_six_months, day).cast("int").alias("change_day"),
                       F.when(in_six_months, reason).alias("change_reason"))


def is_meaningful(params: Params) -> Column:
    kind = F.col("kind")
    return is_true((kind == "meeting")
                   | ((kind == "call") & (F.col("minutes") >= params.meaningful_call_minutes))
                   | (kind.isin("email", "message") & F.col("replied_7d")))


def reply_within(contact_day: Column, reply_day: Column, params: Params) -> Column:
    """A reply counts when it came within the limit and had happened by the snapshot."""
    return is_true((reply_day - contact_day <= params.reply_max_days) & (reply_day <= 0))


def interaction_counts(log: DataFrame, params: Params) -> DataFrame:
    kind = F.col("kind")
    contact = kind.isin("call", "email", "message") & in_window("day", -90)
    meeting = kind.isin("meeting", "meeting_cancelled_by_client") & in_window("day", -180)
    return log.filter(in_window("day", -params.contact_censor_days)).groupBy("household_id").agg(
        F.max(F.when(is_meaningful(params), F.col("day"))).alias("last_contact"),
        F.count_if(contact).alias("contacts"),
        count_when(contact & F.col("replied_7d")).alias("replies"),
        F.count_if(meeting).alias("meetings"),
        F.count_if(meeting & (kind == "meeting_cancelled_by_client")).alias("cancelled"))


def banker_variables(household: DataFrame, bankers: DataFrame, events: DataFrame, log: DataFrame,
                     params: Params, cadence: Mapping[str, int] = CADENCE_DAYS) -> DataFrame:
    wide = banker_changes(household, bankers, events, params).join(
        interaction_counts(log, params), "household_id", "left")
    since = F.coalesce(-F.col("last_contact"), F.lit(params.contact_censor_days))
    contacts, meetings = _zero("contacts"), _zero("meetings")
    captured = is_true(F.col("cancelled_by_captured"))
    return wide.select(
        "household_id",
        flag_or_null(F.col("history_months") >= 6, F.col("change_day").isNotNull())
         .alias("banker_change_6m_flag"),
        F.col("change_reason").alias("banker_change_reason"),
        since.cast("int").alias("days_since_meaningful_contact"),
        (since / lookup(cadence, "segment")).alias("contact_gap_ratio"),
        F.when(contacts >= params.min_contacts_for_reply_rate, _zero("replies") / contacts)
         .alias("client_reply_rate"),
        F.when(captured, _zero("cancelled")).alias("meetings_cancelled_by_client"),
        F.when(captured & (meetings > 0), _zero("cancelled") / meetings)
         .alias("meetings_cancelled_pct"))


def complaint_variables(complaints: DataFrame, assistant: DataFrame, household: DataFrame,
                        params: Params) -> DataFrame:
    """Complaint flags from one fold to (household, category) and one to household."""
    opened = F.col("status") == "open"
    by_category = (complaints.filter(in_window("open_day", -params.complaint_history_days))
                   .groupBy("household_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("escalation_level") != "none").alias("escalated"),
        F.min(F.when(opened, F.col("open_day"))).alias("oldest"),
        F.bool_or(opened & F.col("out_of_sla")).alias("late"),
        F.bool_or("reopened").alias("reopened")))
    folded = by_category.groupBy("household_id").agg(
        F.sum("n").alias("complaints"), F.max("n").alias("same_category"),
        F.bool_or("escalated").alias("escalated"), F.min("oldest").alias("oldest"),
        F.bool_or("late").alias("late"), F.bool_or("reopened").alias("reopened"))
    wide = (household.select("household_id").join(folded, "household_id", "left")
            .join(assistant.select("household_id", "assistant_pilot", "human_confirmed"),
                  "household_id", "left"))
    always = F.lit(True)
    return wide.select(
        "household_id",
        flag_or_null(always, F.col("escalated")).alias("complaint_escalated_flag"),
        flag_or_null(always, F.col("oldest").isNotNull()).alias("open_complaint_flag"),
        F.coalesce(-F.col("oldest"), F.lit(0)).cast("int").alias("complaint_age_days"),
        flag_or_null(always, F.col("late")).alias("complaint_out_of_sla_flag"),
        flag_or_null(always, is_true(F.col("same_category") >= 2) | is_true(F.col("reopened")))
         .alias("repeat_complaint_flag"),
        _zero("complaints").alias("complaints_12m"),
        flag_or_null(is_true(F.col("assistant_pilot")), F.col("human_confirmed"))
         .alias("relationship_dissatisfaction_flag"))


def bureau_variable(tradelines: DataFrame, bureau: DataFrame, household: DataFrame,
                    params: Params) -> DataFrame:
    """New mortgage with another lender in six months; NULL without purpose or legal clearance."""
    elsewhere = tradelines.groupBy("household_id").agg(
        F.bool_or(in_window("open_day", -180) & ~F.col("own_lender")).alias("elsewhere"))
    wide = (household.select("household_id").join(bureau, "household_id", "left")
            .join(elsewhere, "household_id", "left"))
    allowed = is_true(F.col("permissible_purpose")) & F.lit(params.legal_cleared)
    return wide.select("household_id", flag_or_null(allowed, F.col("elsewhere"))
                       .alias("bureau_new_mortgage_elsewhere"))
