"""Reference SQL of the feature queries."""

from __future__ import annotations

from oracles.ctes import build, r, rounded

SQL: dict[str, str] = {}

_SOURCES = {
    "f_balances": {
        "aum_outflow": ("aum_outflow_30d aum_outflow_90d aum_outflow_pct_30d aum_outflow_pct_90d", ""),
        "deposit_balance_change_pct": ("deposit_balance_change_pct_30d deposit_balance_change_pct_90d deposit_balance_change_pct_180d", ""),
        "aum_vs_baseline_pct": ("aum_vs_baseline_pct", ""),
        "deposit_balance_vs_6m_avg_pct": ("deposit_balance_vs_6m_avg_pct", ""),
        "net_deposit_flow": ("net_deposit_flow_30d net_deposit_flow_90d net_deposit_flow_pct_30d net_deposit_flow_pct_90d", "")},
    "f_recurring": {
        "salary_deposit_stopped_flag": ("", "salary_deposit_stopped_flag"),
        "recurring_deposit_stopped_flag": ("", "recurring_deposit_stopped_flag recurring_deposit_stopped_type"),
        "recurring_deposit_change_pct": ("recurring_deposit_change_pct", ""),
        "pension_deposit_stopped_flag": ("", "pension_deposit_stopped_flag"),
        "business_payroll_stopped_flag": ("", "business_payroll_stopped_flag")},
    "f_transfers": {
        "external_transfer_amount_60d": ("external_transfer_amount_60d external_transfer_pct_of_balance_60d external_transfer_pct_of_balance_30d", ""),
        "new_external_destinations": ("", "new_external_destinations_30d new_external_destinations_90d"),
        "transfer_to_competitor": ("transfer_to_competitor_bank_amount_90d transfer_to_competitor_pct_90d", ""),
        "external_transfer_acceleration": ("external_transfer_acceleration external_outflow_pct_30d", ""),
        "net_external_flow": ("net_external_flow_30d net_external_flow_90d net_external_flow_pct_90d", ""),
        "external_destination_concentration": ("external_destination_concentration external_outflow_pct_90d", ""),
        "outflow_vs_baseline_pct": ("outflow_vs_baseline_pct", "")},
    "f_investments": {
        "investment_redemption_pct": ("investment_redemption_pct", ""),
        "fixed_income_maturity_not_reinvested": ("fixed_income_maturity_not_reinvested fixed_income_not_reinvested_amount", ""),
        "cash_pct_of_portfolio_chg": ("cash_pct_of_portfolio_chg", ""),
        "return_vs_benchmark": ("return_vs_benchmark", ""),
        "positions_liquidated_pct": ("positions_liquidated_pct", "")},
    "f_relationship": {
        "products_closed": ("", "products_closed_90d products_closed_180d"),
        "accounts_closed": ("", "accounts_closed_90d accounts_closed_180d"),
        "share_of_wallet": ("share_of_wallet", "wealth_estimate_source"),
        "share_of_wallet_change": ("share_of_wallet_change", ""),
        "trustee_change_flag": ("", "trustee_change_flag")},
    "f_banker": {
        "banker_change_6m_flag": ("", "banker_change_6m_flag banker_change_reason"),
        "contact_gap_ratio": ("contact_gap_ratio", "days_since_meaningful_contact"),
        "client_reply_rate": ("client_reply_rate", ""),
        "meetings_cancelled": ("meetings_cancelled_pct", "meetings_cancelled_by_client")},
    "f_complaints": {
        "complaint_escalated_flag": ("", "complaint_escalated_flag"),
        "open_complaint": ("", "open_complaint_flag complaint_age_days complaint_out_of_sla_flag"),
        "repeat_complaint_flag": ("", "repeat_complaint_flag"),
        "complaints_12m": ("", "complaints_12m"),
        "relationship_dissatisfaction_flag": ("", "relationship_dissatisfaction_flag")},
    "f_bureau": {"bureau_new_mortgage_elsewhere": ("", "bureau_new_mortgage_elsewhere")},
}
for _source, _queries in _SOURCES.items():
    for _name, (_doubles, _exact) in _queries.items():
        SQL[_name] = build(rounded(_source, ["household_id", *_exact.split()], _doubles.split()))

SQL["multi_signal"] = build("SELECT * FROM f_composite")
SQL["external_transfer_alerts"] = build(rounded(
    "f_transfers", ["household_id", "CAST(coalesce(external_transfer_pct_of_balance_60d > 0.15::DOUBLE, false) AS INTEGER) AS alert"],
    ["external_transfer_amount_60d", "external_transfer_pct_of_balance_60d"]))

_INT_PRIMARY = """salary_deposit_stopped_flag recurring_deposit_stopped_flag new_external_destinations_90d products_closed_180d
banker_change_6m_flag complaint_escalated_flag complaint_age_days multi_signal_flag pension_deposit_stopped_flag
business_payroll_stopped_flag accounts_closed_90d trustee_change_flag repeat_complaint_flag meetings_cancelled_by_client
relationship_dissatisfaction_flag bureau_new_mortgage_elsewhere""".split()
_DOUBLE_PRIMARY = """aum_outflow_pct_90d deposit_balance_change_pct_90d recurring_deposit_change_pct net_deposit_flow_pct_90d
external_transfer_pct_of_balance_60d investment_redemption_pct contact_gap_ratio client_reply_rate aum_vs_baseline_pct
deposit_balance_vs_6m_avg_pct transfer_to_competitor_pct_90d external_transfer_acceleration net_external_flow_pct_90d
external_destination_concentration outflow_vs_baseline_pct fixed_income_maturity_not_reinvested cash_pct_of_portfolio_chg
return_vs_benchmark share_of_wallet share_of_wallet_change positions_liquidated_pct""".split()
_GROUPS = [f"group_alert_{g}" for g in ("balances", "recurring", "transfers", "investments", "relationship", "banker", "complaints")]
SQL["assemble_core_full"] = build(
    rounded("base", ["household_id", "snapshot_date", "segment", *_INT_PRIMARY, "multi_signal_count", *_GROUPS, "hard_churn_6m"], _DOUBLE_PRIMARY),
    base="""SELECT * FROM household JOIN features USING (household_id) JOIN f_composite USING (household_id)
JOIN f_bureau USING (household_id)""")

SQL["window_available"] = build("SELECT household_id, ok3 AS window_available FROM panel_agg")
SQL["trailing_mean"] = build(rounded("m", ["household_id"], ["last_mean", "previous_mean", "baseline_mean"]),
    m="""SELECT household_id, CASE WHEN ok3 THEN d3 END AS last_mean, CASE WHEN p3 THEN q3 END AS previous_mean,
  CASE WHEN b6 THEN db END AS baseline_mean FROM panel_agg""")
SQL["average_balance"] = build(rounded("b", ["household_id"], ["balance_30d", "balance_60d", "balance_90d"]),
    b="SELECT household_id, b30 AS balance_30d, b60 AS balance_60d, b90 AS balance_90d FROM balance")
SQL["windowed_sum"] = build(rounded("w", ["household_id"], {"w60": 2, "w90_30": 2}),
    w="""SELECT household_id, coalesce(sum(amount) FILTER (WHERE day > -60 AND day <= 0), 0) AS w60,
  coalesce(sum(amount) FILTER (WHERE day > -90 AND day <= -30), 0) AS w90_30 FROM transfer GROUP BY 1""")
SQL["hhi"] = build(rounded("hhi_inst", ["household_id"], ["hhi"]))
SQL["first_seen_prior_absent"] = build("""SELECT a.household_id, CAST(coalesce(new90, 0) AS INTEGER) AS new_destinations
FROM (SELECT DISTINCT household_id FROM transfer WHERE category NOT IN ('biller', 'irs_tax')) a LEFT JOIN new_dest n ON a.household_id = n.household_id""")
SQL["non_acats_withdrawals"] = build(rounded("sold", ["household_id", "month"], {"sold_for_withdrawal": 2}))
SQL["conditional_sum_by_month"] = build(rounded("s", ["household_id", "month"], {"acats": 2, "deposits_out": 2}),
    s="""SELECT household_id, CAST(ceil(day / 30.44::DOUBLE) AS INTEGER) AS month,
  coalesce(sum(amount) FILTER (WHERE category = 'move_acats'), 0) AS acats,
  coalesce(sum(amount) FILTER (WHERE category <> 'move_acats'), 0) AS deposits_out FROM transfer WHERE category <> 'incoming' GROUP BY 1, 2""")
SQL["product_compound_return"] = build(rounded("p", ["household_id"], ["return_12m"]),
    p="SELECT household_id, product(1 + portfolio_return) - 1 AS return_12m FROM monthly_return WHERE month > -12 GROUP BY 1")
SQL["detect_recurring"] = build(rounded("found_patterns", ["household_id", "evaluation", "stream", "pattern_exists"], ["interval_days", "median_amount"]),
    found_patterns="SELECT household_id, cs AS evaluation, stream, ex AS pattern_exists, itv AS interval_days, med AS median_amount FROM stops WHERE med IS NOT NULL")
SQL["evaluate_stop"] = build("SELECT household_id, cs AS evaluation, stream, CAST(ld AS INTEGER) AS last_day, stopped FROM stops WHERE ex AND cs <> 'change'")
SQL["last_credit"] = build("SELECT household_id, stream, max(day) FILTER (WHERE amount <= 100) AS last_day FROM recurring_tx GROUP BY 1, 2")
_GAPS = """SELECT household_id, stream, count(*) AS payments, count(gap) AS gap_count, avg(gap) AS gap_mean,
  stddev_pop(gap) AS gap_std, median(gap) AS gap_median FROM (SELECT household_id, stream,
  day - lag(day) OVER (PARTITION BY household_id, stream ORDER BY day) AS gap FROM recurring_tx) q GROUP BY 1, 2"""
SQL["lag_diff"] = build(rounded("g", ["household_id", "stream", "payments", "gap_count"], ["gap_mean", "gap_std", "gap_median"]), g=_GAPS)
SQL["stop_threshold"] = build(rounded("t", ["household_id", "stream"], ["threshold"]), g=_GAPS,
    t="SELECT household_id, stream, greatest(45.0::DOUBLE, 1.5::DOUBLE * coalesce(gap_median, 30)) AS threshold FROM g")
SQL["stream_weight"] = build(rounded("w", ["household_id", "stream"], ["monthly_equivalent", "weight"]),
    w="SELECT household_id, stream, meq AS monthly_equivalent, coalesce(weight, 0) AS weight FROM weights WHERE ex")
SQL["payroll_replacement"] = build("SELECT household_id FROM replaced WHERE rep")
SQL["stopped_type"] = build("SELECT household_id, stopped_type FROM hits WHERE any_stop")
SQL["reported_exclusions"] = build("""SELECT e.household_id, retire_reported, leave_reported, death_reported FROM recurring_event e
JOIN (SELECT household_id, bool_or(stopped) FILTER (WHERE stream = 'payroll') AS o, bool_or(stopped) FILTER (WHERE stream = 'payroll_new') AS n
  FROM stops WHERE cs = 'salary' GROUP BY 1) s ON e.household_id = s.household_id LEFT JOIN replaced r ON e.household_id = r.household_id
WHERE (retire_reported OR leave_reported OR death_reported) AND (coalesce(n, false) OR (coalesce(o, false) AND NOT coalesce(rep, false)))""")
SQL["banker_changes"] = build("SELECT household_id, CAST(change_day AS INTEGER) AS change_day, change_reason FROM banker_change")
SQL["first_reason_wins"] = build("""SELECT change_reason, count(*) AS households, CAST(min(change_day) AS INTEGER) AS first_day FROM banker_change
WHERE change_reason IS NOT NULL GROUP BY 1""")
SQL["propagate_parent_event"] = build("""SELECT household_id, h.banker_id, CAST(departure_day AS INTEGER) AS departure_day
FROM household h JOIN banker b ON h.banker_id = b.banker_id WHERE departure_day IS NOT NULL""")
SQL["reply_within_7d"] = build("""SELECT household_id, count(*) AS contacts,
  count(*) FILTER (WHERE CAST(trunc(minutes) AS INTEGER) % 12 <= 7 AND day + CAST(trunc(minutes) AS INTEGER) % 12 <= 0) AS replied FROM interaction GROUP BY 1""")
SQL["ratio_of_counts"] = build(f"""SELECT household_id, n AS contacts, rep AS replies, sched AS meetings, canc AS cancelled,
  {r('rep / nullif(n, 0)')} AS reply_rate FROM contact""")
SQL["complaint_lifecycle"] = build("SELECT * FROM complaint")
SQL["two_level_max_count"] = build("""SELECT household_id, max(c) AS same_category
FROM (SELECT household_id, category, count(*) AS c FROM complaint GROUP BY 1, 2) q GROUP BY 1""")
