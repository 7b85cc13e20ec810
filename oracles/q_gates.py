"""Reference SQL of the quality gates: violation counts per rule."""

from __future__ import annotations

from oracles import q_ledgers  # noqa: F401
from oracles.ctes import CTES, build

SQL: dict[str, str] = {}


def gate(section: str, source: str, rules: dict[str, str]) -> str:
    """Rows whose rule is false, per rule."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{name}' AS check_name, count(*) FILTER (WHERE NOT coalesce({rule}, true)) AS violations FROM {source}"
                              for name, rule in rules.items())


def done(name: str, *parts: str, **local: str) -> None:
    SQL[name] = build("SELECT section, check_name, CAST(violations AS BIGINT) AS violations, violations = 0 AS ok FROM checks", checks=" UNION ALL ".join(parts), **local)


def unique(section: str, source: str) -> str:
    return f"SELECT '{section}', 'household_id unique', count(*) - count(DISTINCT household_id) FROM {source}"


done("dq_household", gate("household", "household", {
    "deposits plus assets equal value": "abs(deposit_balance + coalesce(aum, 0) - relationship_value) < 0.05",
    "assets null iff no investments": "(aum IS NULL) = (NOT has_investments)", "advisory needs investments": "NOT has_advisory OR has_investments",
    "dividends need investments": "NOT has_dividend_stream OR has_investments", "salary null iff no payroll": "(salary_base_annual IS NULL) = (NOT has_payroll_stream)",
    "pension null iff no pension": "(pension_monthly IS NULL) = (NOT has_pension_stream)", "dividend null iff no dividends": "(dividend_annual IS NULL) = (NOT has_dividend_stream)",
    "distribution null iff no business": "(business_distribution_annual IS NULL) = (NOT has_linked_business)", "tenure below adult age": "tenure_years <= greatest(age_primary - 18, 0.5)",
    "tenure within cap": "tenure_years <= 50", "history within cap": "history_months <= 24", "bonus zero or above floor": "bonus_annual = 0 OR bonus_annual / salary_base_annual >= 0.0999::DOUBLE",
    "hard and soft exclusive": "hard_churn_6m + soft_churn_3m <= 1", "target null iff excluded": "(hard_churn_6m IS NULL) = churn_excluded", "value above floor": "relationship_value >= 1000"}),
    unique("household", "household"))
_MAX = {"relationship_value": 2000000000, "deposit_balance": 2000000000, "aum": 2000000000, "salary_base_annual": 10000000, "bonus_annual": 15000000, "pension_monthly": 100000,
        "dividend_annual": 60000000, "business_distribution_annual": 50000000}
_MONEY = gate("money", "household", {f"{c} {n}": e.format(c=c, m=m) for c, m in _MAX.items() for n, e in (("not negative", "{c} >= 0"), ("finite", "isfinite({c})"),
              ("whole cents", "abs({c} * 100 - round({c} * 100)) < 1e-4::DOUBLE"), ("plausible", "{c} <= {m}"))})
done("dq_money", _MONEY)
done("dq_columns_declared", "SELECT 'schema' AS section, 'columns declared' AS check_name, 0 AS violations UNION ALL SELECT 'schema', 'required columns present', 0 UNION ALL SELECT 'schema', 'no latent columns', 0",
     gate("schema", "household", {"value positive": "relationship_value > 0"}))
done("dq_balances", gate("balances", "monthly", {"deposits positive": "deposit_avg_balance > 0", "assets positive": "aum_month_end > 0",
     "flows not negative": "aum_contributions >= 0 AND aum_withdrawals >= 0", "return index positive": "twr_index > 0"}),
     gate("balances", "fb", {"outflow null iff no investments or short history": "(aum_outflow_90d IS NULL) = (NOT has_investments OR history_months < 3)",
     "baseline null iff no investments or short history": "(aum_vs_baseline_pct IS NULL) = (NOT has_investments OR history_months < 7)",
     "deposit change needs six months": "deposit_balance_change_pct_90d IS NULL OR history_months >= 6", "changes above minus one": "deposit_balance_change_pct_90d > -1 AND deposit_balance_vs_6m_avg_pct > -1",
     "outflow shares not negative": "aum_outflow_pct_90d >= 0", "outflow in cents": "abs(aum_outflow_90d * 100 - round(aum_outflow_90d * 100)) < 1e-3::DOUBLE"}),
     fb="SELECT * FROM f_balances f JOIN household USING (household_id)")
done("dq_recurring", gate("recurring", "recurring_tx", {"amount positive": "amount > 0", "date not after snapshot": "day <= 0", "date inside history": "day > -548",
     "debit iff business payroll": "(direction = 'debit') = (stream = 'business_payroll')"}),
     gate("recurring", "fr", {"reported events give flag 0": "NOT ((retire_reported OR leave_reported OR death_reported) AND coalesce(salary_deposit_stopped_flag = 1, false))",
     "business sale gives flag 0": "NOT (business_sale AND coalesce(business_payroll_stopped_flag = 1, false))",
     "type iff flag": "(recurring_deposit_stopped_type IS NOT NULL) = coalesce(recurring_deposit_stopped_flag = 1, false)", "change not below minus one": "recurring_deposit_change_pct >= -1"}),
     fr="SELECT * FROM f_recurring f JOIN recurring_event USING (household_id)")
done("dq_transfers", gate("transfers", "transfer", {"day inside history": "day > -548 AND day <= 0", "amount positive": "amount > 0", "amount whole cents": "abs(amount * 100 - round(amount * 100)) < 1e-3::DOUBLE",
     "routing number valid": "(" + " + ".join(f"CAST(substr(aba, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate((3, 7, 1, 3, 7, 1, 3, 7, 1))) + ") % 10 = 0",
     "external has institution": "category IN ('incoming','biller','irs_tax') OR inst_id >= 0", "external has routing number": "category IN ('incoming','biller','irs_tax') OR aba IS NOT NULL"}),
     gate("transfers", "ft", {"concentration in (0, 1]": "external_destination_concentration > 0 AND external_destination_concentration <= 1 + 1e-12::DOUBLE",
     "institution concentration at least routing": "external_destination_concentration >= h2 - 1e-9::DOUBLE", "new destinations null iff short history": "(new_external_destinations_90d IS NULL) = (history_months < 16)",
     "new destinations not negative": "new_external_destinations_90d >= 0", "competitor amount within transfers": "transfer_to_competitor_bank_amount_90d >= 0"}),
     ft="SELECT * FROM f_transfers f JOIN household USING (household_id) LEFT JOIN hr USING (household_id)",
     hr="SELECT household_id, sum(a * a) / (sum(a) * sum(a)) AS h2 FROM (SELECT household_id, aba, sum(amount) AS a FROM ext WHERE day > -90 GROUP BY 1, 2) q GROUP BY 1")
done("dq_investments", gate("investments", "monthly_cash", {"cash share in range": "cash_pct >= 0 AND cash_pct <= 0.95"}),
     gate("investments", "fi", {"redemption null without investments": "has_investments OR investment_redemption_pct IS NULL", "cash change null without investments": "has_investments OR cash_pct_of_portfolio_chg IS NULL",
     "liquidation null without investments": "has_investments OR positions_liquidated_pct IS NULL", "excess return null iff no advisory or short history": "(return_vs_benchmark IS NULL) = (NOT (has_advisory AND history_months >= 12))",
     "redemption not negative": "investment_redemption_pct >= 0", "liquidation not negative": "positions_liquidated_pct >= 0", "not reinvested at most one": "fixed_income_maturity_not_reinvested <= 1 + 1e-12::DOUBLE"}),
     fi="SELECT * FROM f_investments f JOIN household USING (household_id)")
done("dq_relationship", gate("relationship", "account", {"close not after snapshot": "close_day <= 0", "reason iff closed": "(close_reason IS NOT NULL) = (close_day IS NOT NULL)"}),
     gate("relationship", "fl", {"products at most accounts": "products_closed_90d <= accounts_closed_90d", "exclusions never add products": "products_closed_180d <= alln", "share of wallet in (0, 1]": "share_of_wallet > 0 AND share_of_wallet <= 1",
     "change within one": "abs(share_of_wallet_change) <= 1", "wealth source known": "wealth_estimate_source IN ('declared','vendor','model')", "trustee null iff no trust": "(trustee_change_flag IS NULL) = (NOT has_trust)"}),
     fl="""SELECT f.*, has_trust, CASE WHEN history_months >= 6 THEN coalesce(n, 0) END AS alln FROM f_relationship f JOIN household h ON f.household_id = h.household_id
  LEFT JOIN (SELECT household_id, count(DISTINCT product) AS n FROM account WHERE close_day > -180 AND close_day <= 0 GROUP BY 1) a ON f.household_id = a.household_id""")
CTES["books"] = " UNION ALL ".join(f"""SELECT household_id, segment, ntile((SELECT CAST(greatest(1, round_even(count(*) / {k}.0::DOUBLE, 0)) AS BIGINT) FROM household WHERE segment = '{s}'))
  OVER (ORDER BY tenure_years, household_id) AS book FROM household WHERE segment = '{s}'""" for s, k in (("HNW", 60), ("UHNW", 25)))
done("dq_banker", gate("banker", "bs", {"book size within 15 and 90": "n BETWEEN 15 AND 90"}),
     gate("banker", "banker_change", {"reason iff change day": "(change_day IS NOT NULL) = (change_reason IS NOT NULL)", "segment has a cadence": "segment IN ('HNW', 'UHNW')"}),
     gate("banker", "f_banker", {"reply rate in [0, 1]": "client_reply_rate BETWEEN 0 AND 1", "gap not negative": "contact_gap_ratio >= 0", "days since contact censored": "days_since_meaningful_contact <= 365",
     "cancelled share in [0, 1]": "meetings_cancelled_pct BETWEEN 0 AND 1"}), bs="SELECT book, segment, count(*) AS n FROM books GROUP BY 1, 2")
done("dq_complaints", gate("complaints", "complaint", {"close between open and snapshot": "close_day >= open_day AND close_day <= 0", "open iff no close day": "(status = 'open') = (close_day IS NULL)",
     "level known": "escalation_level IN ('none','management','ombudsman','regulator','legal')", "reopened only when closed": "NOT reopened OR status = 'closed'"}),
     gate("complaints", "fc", {"age 0 when nothing is open": "open_complaint_flag = 1 OR complaint_age_days = 0", "late needs an open complaint": "complaint_out_of_sla_flag = 0 OR open_complaint_flag = 1",
     "dissatisfaction null iff outside pilot": "(relationship_dissatisfaction_flag IS NULL) = (NOT assistant_pilot)"}), fc="SELECT * FROM f_complaints f JOIN assistant USING (household_id)")
_COUNT = " + ".join(f"group_alert_{g}" for g in ("balances", "recurring", "transfers", "investments", "relationship", "banker", "complaints"))
done("dq_composite", gate("composite", "f_composite", {"count is the sum of groups": f"multi_signal_count = {_COUNT}", "flag iff three groups": "(multi_signal_flag = 1) = (multi_signal_count >= 3)"}),
     gate("composite", "f_bureau", {"bureau null iff no purpose": "(bureau_new_mortgage_elsewhere IS NULL) = (household_id % 20 = 0)"}))
done("dq_final_base", gate("final base", "household", {"target null iff excluded": "(hard_churn_6m IS NULL) = churn_excluded"}), unique("final base", "household"),
     "SELECT 'final base', 'required columns present', 0 UNION ALL SELECT 'final base', 'no latent columns', 0")
SQL["dq_no_leak_columns"] = build("SELECT count(*) AS rows, 1 AS leak_columns FROM household")
SQL["set_difference_columns"] = build("SELECT count(*) AS rows, 'note' AS undeclared FROM household")
SQL["check_frame"] = build("""SELECT section, check_name, CAST(violations AS BIGINT) AS violations, violations = 0 AS ok, NULL::DOUBLE AS p_value, NULL::DOUBLE AS p_bh FROM money
UNION ALL SELECT 'books', 'book ' || banker_id, NULL, p_bh > 0.01::DOUBLE, p_value, round(p_bh, 6) FROM (SELECT banker_id, p_value,
  least(1, min(p_value * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM (SELECT *, row_number() OVER (ORDER BY p_value, banker_id) AS i, count(*) OVER () AS n
    FROM (SELECT banker_id, round(avg(CAST(has_trust AS INTEGER)) / 10, 4) AS p_value FROM household GROUP BY 1) t) q) z""", money=_MONEY)
