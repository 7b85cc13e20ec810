"""Quality gates: rules as violation counts of one aggregate per table, then one row per check."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import (ALERT_GROUPS, CADENCE_DAYS, ESCALATION_LEVELS, HOUSEHOLD_UNITS,
                              LATENT_PREFIXES, MAX_PLAUSIBLE_USD, PRIMARY_COLUMNS, WEALTH_SOURCES)
from ebbtide.functions.columns import in_window, is_true, is_whole_cents, routing_is_valid
from ebbtide.operators.statistics import bh_adjust
from ebbtide.params import Params


def gate(rows: DataFrame, section: str, rules: Mapping[str, Column]) -> DataFrame:
    """Count the rows that break each rule; a NULL rule result is a pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"r{i}")
                         for i, rule in enumerate(rules.values())])
    checks = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(name).alias("check_name"),
                                F.col(f"r{i}").alias("violations"))
                       for i, name in enumerate(rules)])
    return counted.select(F.explode(checks).alias("c")).select(
        "c.*", (F.col("c.violations") == 0).alias("ok"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def unique_key(rows: DataFrame, key: str, section: str) -> DataFrame:
    """Rows beyond the first of their key."""
    extra = rows.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(
        F.lit(section).alias("section"), F.lit(f"{key} unique").alias("check_name"), "violations",
        (F.col("violations") == 0).alias("ok"))


def dq_household(h: DataFrame, params: Params) -> DataFrame:
    c = F.col
    value = c("deposit_balance") + F.coalesce(c("aum"), F.lit(0.0))
    rules = {
        "deposits plus assets equal value": F.abs(value - c("relationship_value")) < 0.05,
        "assets null iff no investments": same(c("aum").isNull(), ~c("has_investments")),
        "advisory needs investments": ~c("has_advisory") | c("has_investments"),
        "dividends need investments": ~c("has_dividend_stream") | c("has_investments"),
        "salary null iff no payroll": same(c("salary_base_annual").isNull(),
                                           ~c("has_payroll_stream")),
        "pension null iff no pension": same(c("pension_monthly").isNull(),
                                            ~c("has_pension_stream")),
        "dividend null iff no dividends": same(c("dividend_annual").isNull(),
                                               ~c("has_dividend_stream")),
        "distribution null iff no business": same(c("business_distribution_annual").isNull(),
                                                  ~c("has_linked_business")),
        "tenure below adult age": c("tenure_years") <= F.greatest(c("age_primary") - 18.0,
                                                                  F.lit(0.5)),
        "tenure within cap": c("tenure_years") <= params.tenure_cap_years,
        "history within cap": c("history_months") <= params.history_months_cap,
        "bonus zero or above floor": (c("bonus_annual") == 0)
        | (c("bonus_annual") / c("salary_base_annual") >= 0.0999),
        "hard and soft exclusive": c("hard_churn_6m") + c("soft_churn_3m") <= 1,
        "target null iff excluded": same(c("hard_churn_6m").isNull(), c("churn_excluded")),
        "value above floor": c("relationship_value") >= 1000}
    return union([gate(h, "household", rules), unique_key(h, "household_id", "household")])


def dq_money(rows: DataFrame) -> DataFrame:
    """Negative, non-finite, fractional-cent and implausible amounts of every money column."""
    rules = {}
    for name, top in MAX_PLAUSIBLE_USD.items():
        if name in rows.columns:
            x = F.col(name)
            rules[f"{name} not negative"] = x >= 0
            rules[f"{name} finite"] = ~F.isnan(x) & (F.abs(x) < float("inf"))
            rules[f"{name} whole cents"] = is_whole_cents(x)
            rules[f"{name} plausible"] = x <= top
    return gate(rows, "money", rules)


def dq_balances(panel: DataFrame, features: DataFrame, household: DataFrame) -> DataFrame:
    c = F.col
    series = {"deposits positive": c("deposit_avg_balance") > 0,
              "assets positive": c("aum_month_end") > 0,
              "flows not negative": (c("aum_contributions") >= 0) & (c("aum_withdrawals") >= 0),
              "return index positive": c("twr_index") > 0}
    wide = features.join(household.select("household_id", "has_investments", "history_months"),
                         "household_id")
    rules = {"outflow null iff no investments or short history": same(
        c("aum_outflow_90d").isNull(), ~c("has_investments") | (c("history_months") < 3)),
        "baseline null iff no investments or short history": same(
            c("aum_vs_baseline_pct").isNull(), ~c("has_investments") | (c("history_months") < 7)),
        "deposit change needs six months": c("deposit_balance_change_pct_90d").isNull()
        | (c("history_months") >= 6),
        "changes above minus one": (c("deposit_balance_change_pct_90d") > -1)
        & (c("deposit_balance_vs_6m_avg_pct") > -1),
        "outflow shares not negative": c("aum_outflow_pct_90d") >= 0,
        "outflow in cents": is_whole_cents("aum_outflow_90d", 1e-3)}
    return union([gate(panel, "balances", series), gate(wide, "balances", rules)])


def dq_recurring(payments: DataFrame, features: DataFrame, events: DataFrame) -> DataFrame:
    c = F.col
    rows = {"amount positive": c("amount") > 0, "date not after snapshot": c("day") <= 0,
            "date inside history": c("day") > -548,
            "debit iff business payroll": same(c("direction") == "debit",
                                               c("stream") == "business_payroll")}
    wide = features.join(events, "household_id")
    reported = c("retire_reported") | c("leave_reported") | c("death_reported")
    rules = {"reported events give flag 0": ~(reported & is_true(
        c("salary_deposit_stopped_flag") == 1)),
        "business sale gives flag 0": ~(c("business_sale") & is_true(
            c("business_payroll_stopped_flag") == 1)),
        "type iff flag": same(c("recurring_deposit_stopped_type").isNotNull(),
                              is_true(c("recurring_deposit_stopped_flag") == 1)),
        "change not below minus one": c("recurring_deposit_change_pct") >= -1}
    return union([gate(payments, "recurring", rows), gate(wide, "recurring", rules)])


def dq_transfers(ledger: DataFrame, features: DataFrame, household: DataFrame,
                 hhi_routing: DataFrame) -> DataFrame:
    c = F.col
    external = ~c("category").isin("incoming", "biller", "irs_tax", "donation", "loan_citizens",
                                   "irs_shock", "irs_shock_aum")
    rows = {"day inside history": in_window("day", -548), "amount positive": c("amount") > 0,
            "amount whole cents": is_whole_cents("amount", 1e-3),
            "routing number valid": routing_is_valid("aba"),
            "external has institution": ~external | (c("inst_id") >= 0),
            "external has routing number": ~external | c("aba").isNotNull()}
    wide = (features.join(household.select("household_id", "history_months"), "household_id")
            .join(hhi_routing.withColumnRenamed("hhi", "hhi_routing"), "household_id", "left"))
    hhi = c("external_destination_concentration")
    rules = {"concentration in (0, 1]": (hhi > 0) & (hhi <= 1 + 1e-12),
             "institution concentration at least routing": hhi >= c("hhi_routing") - 1e-9,
             "new destinations null iff short history": same(
                 c("new_external_destinations_90d").isNull(), c("history_months") < 16),
             "new destinations not negative": c("new_external_destinations_90d") >= 0,
             "competitor amount within transfers": c("transfer_to_competitor_bank_amount_90d") >= 0}
    return union([gate(ledger, "transfers", rows), gate(wide, "transfers", rules)])


def dq_investments(cash: DataFrame, features: DataFrame, household: DataFrame) -> DataFrame:
    c = F.col
    wide = features.join(household.select("household_id", "has_investments", "has_advisory",
                                          "history_months"), "household_id")
    none = ~c("has_investments")
    rules = {"redemption null without investments": ~none | c("investment_redemption_pct").isNull(),
             "cash change null without investments": ~none | c("cash_pct_of_portfolio_chg").isNull(),
             "liquidation null without investments": ~none | c("positions_liquidated_pct").isNull(),
             "excess return null iff no advisory or short history": same(
                 c("return_vs_benchmark").isNull(),
                 ~(c("has_advisory") & (c("history_months") >= 12))),
             "redemption not negative": c("investment_redemption_pct") >= 0,
             "liquidation not negative": c("positions_liquidated_pct") >= 0,
             "not reinvested at most one": c("fixed_income_maturity_not_reinvested") <= 1 + 1e-12}
    return union([gate(cash, "investments", {"cash share in range": (c("cash_pct") >= 0)
                                             & (c("cash_pct") <= 0.95)}),
                  gate(wide, "investments", rules)])


def dq_relationship(accounts: DataFrame, features: DataFrame, household: DataFrame,
                    unfiltered: DataFrame) -> DataFrame:
    c = F.col
    rows = {"close not after snapshot": c("close_day") <= 0,
            "reason iff closed": same(c("close_reason").isNotNull(), c("close_day").isNotNull())}
    every = unfiltered.select("household_id", c("products_closed_180d").alias("all_products"))
    wide = (features.join(household.select("household_id", "has_trust"), "household_id")
            .join(every, "household_id"))
    rules = {"products at most accounts": c("products_closed_90d") <= c("accounts_closed_90d"),
             "exclusions never add products": c("products_closed_180d") <= c("all_products"),
             "share of wallet in (0, 1]": (c("share_of_wallet") > 0) & (c("share_of_wallet") <= 1),
             "change within one": F.abs("share_of_wallet_change") <= 1,
             "wealth source known": c("wealth_estimate_source").isin(*WEALTH_SOURCES),
             "trustee null iff no trust": same(c("trustee_change_flag").isNull(), ~c("has_trust"))}
    return union([gate(accounts, "relationship", rows), gate(wide, "relationship", rules)])


def dq_banker(books: DataFrame, changes: DataFrame, features: DataFrame) -> DataFrame:
    c = F.col
    one_segment = books.groupBy("book", "segment").agg(F.count(F.lit(1)).alias("n"))
    sizes = {"book size within 15 and 90": (c("n") >= 15) & (c("n") <= 90)}
    rules = {"reply rate in [0, 1]": (c("client_reply_rate") >= 0) & (c("client_reply_rate") <= 1),
             "gap not negative": c("contact_gap_ratio") >= 0,
             "days since contact censored": c("days_since_meaningful_contact") <= 365,
             "cancelled share in [0, 1]": (c("meetings_cancelled_pct") >= 0)
             & (c("meetings_cancelled_pct") <= 1)}
    moved = {"reason iff change day": same(c("change_day").isNotNull(),
                                           c("change_reason").isNotNull()),
             "segment has a cadence": c("segment").isin(*CADENCE_DAYS)}
    return union([gate(one_segment, "banker", sizes), gate(changes, "banker", moved),
                  gate(features, "banker", rules)])


def dq_complaints(complaints: DataFrame, features: DataFrame, assistant: DataFrame) -> DataFrame:
    c = F.col
    rows = {"close between open and snapshot": (c("close_day") >= c("open_day"))
            & (c("close_day") <= 0),
            "open iff no close day": same(c("status") == "open", c("close_day").isNull()),
            "level known": c("escalation_level").isin("none", *ESCALATION_LEVELS),
            "reopened only when closed": ~c("reopened") | (c("status") == "closed")}
    wide = features.join(assistant, "household_id")
    rules = {"age 0 when nothing is open": (c("open_complaint_flag") == 1)
             | (c("complaint_age_days") == 0),
             "late needs an open complaint": (c("complaint_out_of_sla_flag") == 0)
             | (c("open_complaint_flag") == 1),
             "dissatisfaction null iff outside pilot": same(
                 c("relationship_dissatisfaction_flag").isNull(), ~c("assistant_pilot"))}
    return union([gate(complaints, "complaints", rows), gate(wide, "complaints", rules)])


def dq_composite(signals: DataFrame, bureau: DataFrame, purpose: DataFrame) -> DataFrame:
    c = F.col
    total = sum((c(f"group_alert_{g}") for g in ALERT_GROUPS), F.lit(0))
    rules = {"count is the sum of groups": c("multi_signal_count") == total,
             "flag iff three groups": same(c("multi_signal_flag") == 1, c("multi_signal_count") >= 3)}
    gated = {"bureau null iff no purpose": same(c("bureau_new_mortgage_elsewhere").isNull(),
                                                ~c("permissible_purpose"))}
    return union([gate(signals, "composite", rules),
                  gate(bureau.join(purpose, "household_id"), "composite", gated)])


def schema_checks(frame: DataFrame, required: list[str], section: str) -> DataFrame:
    """Declared columns, required columns and no latent columns; reads only the schema."""
    undeclared = [x for x in frame.columns if x not in HOUSEHOLD_UNITS]
    missing = [x for x in required if x not in frame.columns]
    latent = [x for x in frame.columns if x.startswith(LATENT_PREFIXES)]
    rows = [(section, "columns declared", len(undeclared), not undeclared),
            (section, "required columns present", len(missing), not missing),
            (section, "no latent columns", len(latent), not latent)]
    return frame.sparkSession.createDataFrame(
        rows, "section string, check_name string, violations bigint, ok boolean")


def undeclared_columns(frame: DataFrame) -> list[str]:
    return sorted(set(frame.columns) - set(HOUSEHOLD_UNITS))


def leak_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith(LATENT_PREFIXES)]


def dq_final_base(core: DataFrame) -> DataFrame:
    primaries = list(PRIMARY_COLUMNS.values())
    nulls = {"target null iff excluded": same(F.col("hard_churn_6m").isNull(),
                                              F.col("churn_excluded"))}
    checks = schema_checks(core, primaries, "final base").filter("check_name <> 'columns declared'")
    return union([gate(core, "final base", nulls),
                  unique_key(core, "household_id", "final base"), checks])


def check_frame(checks: DataFrame, tests: DataFrame, params: Params) -> DataFrame:
    """All checks in one frame; p-valued tests pass when their adjusted p exceeds alpha."""
    keyed = tests.withColumn("test_key", F.to_json(F.struct("section", "check_name")))
    adjusted = keyed.join(bh_adjust(keyed, "p_value", "test_key").drop("p_value"), "test_key")
    tested = adjusted.select("section", "check_name", F.lit(None).cast("bigint").alias("violations"),
                             (F.col("p_bh") > params.alpha).alias("ok"), "p_value", "p_bh")
    plain = checks.select("section", "check_name", "violations", "ok",
                          F.lit(None).cast("double").alias("p_value"),
                          F.lit(None).cast("double").alias("p_bh"))
    return plain.unionByName(tested)
