"""Fixed value tables and schemas of the domain (lists, thresholds and units stated as text)."""

from __future__ import annotations

# Categories of the transfer ledger.
EXTERNAL_OUT = ["background", "one_off", "real_estate", "episode_deposit", "episode_acats",
                "move_deposit", "move_acats", "shock_aum"]
EXCLUDED_PAYMENTS = ["biller", "irs_tax", "donation", "loan_citizens", "irs_shock", "irs_shock_aum"]
ACATS = ["episode_acats", "move_acats", "shock_aum"]
AUM_EXTERNAL = ["episode_acats", "move_acats", "shock_aum", "irs_shock_aum"]
FROM_DEPOSITS = ["background", "one_off", "real_estate", "episode_deposit", "move_deposit",
                 "biller", "irs_tax", "donation", "loan_citizens", "irs_shock"]
INCOMING = "incoming"

# Recurring streams in the order in which a stop is attributed.
STREAM_PRIORITY = ["payroll", "payroll_new", "pension", "pension_new", "dividend",
                   "business_distribution"]
DEPOSIT_STREAMS = ["payroll", "bonus", "payroll_new", "pension", "pension_new",
                   "business_distribution"]
BUSINESS_PAYROLL = "business_payroll"

# Close reasons that do not count as a closed product / a closed account.
EXCLUDED_PRODUCT_REASONS = ["cd_renewed", "loan_paid_at_term", "conversion", "consolidation"]
EXCLUDED_ACCOUNT_REASONS = ["cd_renewed", "consolidation"]

# Contact cadence by segment, complaint SLA by category (days).
CADENCE_DAYS = {"HNW": 90, "UHNW": 30}
SLA_DAYS = {"fees_pricing": 20, "process_delay": 30, "banker_attention": 15, "digital": 10,
            "transfers_wires": 10, "statement_error": 15, "investment_performance": 30,
            "fraud_dispute": 45}
ESCALATION_LEVELS = ["management", "ombudsman", "regulator", "legal"]
PAYS_PER_YEAR = {"biweekly": 26, "semimonthly": 24, "monthly": 12}
WEALTH_SOURCES = ["declared", "vendor", "model"]

# Alert rules of the composite, one OR-list per group.
ALERT_GROUPS = {
    "balances": ["aum_outflow_pct_90d > 0.10", "deposit_balance_change_pct_90d <= -0.25",
                 "aum_vs_baseline_pct <= -0.20", "deposit_balance_vs_6m_avg_pct <= -0.30"],
    "recurring": ["salary_deposit_stopped_flag = 1", "recurring_deposit_stopped_flag = 1",
                  "recurring_deposit_change_pct <= -0.40", "net_deposit_flow_pct_90d <= -0.15",
                  "pension_deposit_stopped_flag = 1", "business_payroll_stopped_flag = 1"],
    "transfers": ["external_transfer_pct_of_balance_60d > 0.15",
                  "new_external_destinations_30d >= 1", "transfer_to_competitor_pct_90d > 0.10",
                  "external_transfer_acceleration > 0 AND external_outflow_pct_30d > 0.05",
                  "net_external_flow_pct_90d <= -0.15",
                  "external_destination_concentration > 0.7 AND external_outflow_pct_90d > 0.10",
                  "outflow_vs_baseline_pct > 1.0"],
    "investments": ["investment_redemption_pct > 0.20",
                    "fixed_income_maturity_not_reinvested > 0.50 AND "
                    "fixed_income_not_reinvested_amount >= {material}",
                    "cash_pct_of_portfolio_chg > 0.10", "return_vs_benchmark <= -0.03",
                    "positions_liquidated_pct > 0.15"],
    "relationship": ["products_closed_90d >= 1", "accounts_closed_90d >= 1",
                     "share_of_wallet < 0.30", "share_of_wallet_change <= -0.10",
                     "trustee_change_flag = 1"],
    "banker": ["banker_change_6m_flag = 1", "contact_gap_ratio > 2.0", "client_reply_rate < 0.5",
               "meetings_cancelled_by_client >= 2", "meetings_cancelled_pct >= 0.5"],
    "complaints": ["complaint_escalated_flag = 1", "complaint_age_days > 30",
                   "complaint_out_of_sla_flag = 1", "repeat_complaint_flag = 1",
                   "relationship_dissatisfaction_flag = 1"],
}

# Catalogue id -> primary column.
PRIMARY_COLUMNS = {
    1: "aum_outflow_pct_90d", 2: "deposit_balance_change_pct_90d",
    3: "salary_deposit_stopped_flag", 4: "recurring_deposit_stopped_flag",
    5: "recurring_deposit_change_pct", 6: "net_deposit_flow_pct_90d",
    7: "external_transfer_pct_of_balance_60d", 8: "new_external_destinations_90d",
    9: "investment_redemption_pct", 10: "products_closed_180d", 11: "banker_change_6m_flag",
    12: "contact_gap_ratio", 13: "client_reply_rate", 14: "complaint_escalated_flag",
    15: "complaint_age_days", 16: "multi_signal_flag", 17: "aum_vs_baseline_pct",
    18: "deposit_balance_vs_6m_avg_pct", 19: "pension_deposit_stopped_flag",
    20: "business_payroll_stopped_flag", 21: "transfer_to_competitor_pct_90d",
    22: "external_transfer_acceleration", 23: "net_external_flow_pct_90d",
    24: "external_destination_concentration", 25: "outflow_vs_baseline_pct",
    26: "fixed_income_maturity_not_reinvested", 27: "cash_pct_of_portfolio_chg",
    28: "return_vs_benchmark", 29: "accounts_closed_90d", 30: "share_of_wallet",
    31: "share_of_wallet_change", 32: "trustee_change_flag", 33: "repeat_complaint_flag",
    34: "positions_liquidated_pct", 35: "meetings_cancelled_by_client",
    36: "relationship_dissatisfaction_flag", 37: "bureau_new_mortgage_elsewhere",
}

# Calibration target of each primary column
# (alert rule, low and high alert rate, low and high information value, base of the value).
CALIBRATION_TARGETS = {
    "aum_outflow_pct_90d": ("> 0.10", 0.04, 0.16, 0.10, 0.30, "all"),
    "deposit_balance_change_pct_90d": ("<= -0.25", 0.04, 0.16, 0.10, 0.30, "all"),
    "aum_vs_baseline_pct": ("<= -0.20", 0.04, 0.16, 0.10, 0.30, "all"),
    "deposit_balance_vs_6m_avg_pct": ("<= -0.30", 0.04, 0.16, 0.10, 0.30, "all"),
    "salary_deposit_stopped_flag": ("= 1", 0.02, 0.08, 0.30, 0.50, "applicable"),
    "recurring_deposit_stopped_flag": ("= 1", 0.03, 0.10, 0.10, 0.30, "applicable"),
    "recurring_deposit_change_pct": ("<= -0.40", 0.03, 0.12, 0.10, 0.30, "all"),
    "net_deposit_flow_pct_90d": ("<= -0.15", 0.06, 0.32, 0.10, 0.30, "all"),
    "pension_deposit_stopped_flag": ("= 1", 0.01, 0.06, 0.10, 0.30, "applicable"),
    "business_payroll_stopped_flag": ("= 1", 0.02, 0.08, 0.10, 0.30, "applicable"),
    "external_transfer_pct_of_balance_60d": ("> 0.15", 0.04, 0.16, 0.30, 0.50, "all"),
    "new_external_destinations_90d": (">= 1", 0.02, 0.15, 0.10, 0.30, "all"),
    "transfer_to_competitor_pct_90d": ("> 0.10", 0.03, 0.14, 0.10, 0.30, "all"),
    "external_transfer_acceleration": ("accel", 0.02, 0.12, 0.10, 0.30, "applicable"),
    "net_external_flow_pct_90d": ("<= -0.15", 0.04, 0.20, 0.10, 0.30, "all"),
    "external_destination_concentration": ("hhi", 0.02, 0.15, 0.10, 0.30, "applicable"),
    "outflow_vs_baseline_pct": ("> 1.0", 0.03, 0.15, 0.10, 0.30, "all"),
    "investment_redemption_pct": ("> 0.20", 0.02, 0.12, 0.10, 0.30, "applicable"),
    "fixed_income_maturity_not_reinvested": ("> 0.50", 0.10, 0.45, 0.10, 0.30, "applicable"),
    "cash_pct_of_portfolio_chg": ("> 0.10", 0.03, 0.15, 0.10, 0.30, "applicable"),
    "return_vs_benchmark": ("<= -0.03", 0.10, 0.40, 0.10, 0.30, "applicable"),
    "positions_liquidated_pct": ("> 0.15", 0.01, 0.10, 0.10, 0.30, "applicable"),
    "products_closed_180d": (">= 1", 0.03, 0.15, 0.30, 0.50, "all"),
    "accounts_closed_90d": (">= 1", 0.04, 0.20, 0.10, 0.30, "all"),
    "share_of_wallet": ("<= 0.30", 0.10, 0.40, 0.10, 0.30, "all"),
    "share_of_wallet_change": ("<= -0.10", 0.03, 0.20, 0.10, 0.30, "all"),
    "trustee_change_flag": ("= 1", 0.01, 0.08, 0.10, 0.30, "applicable"),
    "banker_change_6m_flag": ("= 1", 0.05, 0.20, 0.30, 0.50, "all"),
    "contact_gap_ratio": ("> 2.0", 0.02, 0.25, 0.10, 0.30, "all"),
    "client_reply_rate": ("< 0.5", 0.05, 0.35, 0.10, 0.30, "applicable"),
    "meetings_cancelled_by_client": (">= 2", 0.03, 0.20, 0.10, 0.30, "applicable"),
    "complaint_escalated_flag": ("= 1", 0.01, 0.08, 0.10, 0.30, "all"),
    "complaint_age_days": ("> 30", 0.005, 0.06, 0.10, 0.30, "all"),
    "repeat_complaint_flag": ("= 1", 0.01, 0.08, 0.10, 0.30, "all"),
    "relationship_dissatisfaction_flag": ("= 1", 0.005, 0.06, 0.10, 0.30, "applicable"),
    "multi_signal_count": (">= 3", 0.03, 0.30, 0.30, 0.80, "all"),
    "bureau_new_mortgage_elsewhere": ("= 1", 0.005, 0.06, 0.10, 0.30, "applicable"),
}

# Points of the expert scorecard.
EXPERT_POINTS = [
    (30, "relationship_dissatisfaction_flag = 1"),
    (25, "external_transfer_pct_of_balance_60d > 0.15"),
    (15, "recurring_deposit_stopped_flag = 1 OR recurring_deposit_change_pct <= -0.40"),
    (10, "investment_redemption_pct > 0.20 OR aum_outflow_pct_90d > 0.10"),
    (10, "complaint_age_days > 30"),
    (10, "contact_gap_ratio > 2.0"),
    (10, "banker_change_6m_flag = 1"),
]
RISK_BANDS = [("Low 0-39", -0.01, 39.999), ("Watch 40-69", 39.999, 69.999),
              ("High 70-100", 69.999, 100.01)]

# Plausible maxima and business bands of the household table.
MAX_PLAUSIBLE_USD = {
    "relationship_value": 2_000_000_000, "deposit_balance": 2_000_000_000, "aum": 2_000_000_000,
    "salary_base_annual": 10_000_000, "bonus_annual": 15_000_000, "pension_monthly": 100_000,
    "dividend_annual": 60_000_000, "business_distribution_annual": 50_000_000,
    "recurring_income_monthly": 5_000_000,
}
BUSINESS_BANDS = {
    "relationship_value_mean": (5_000_000, 15_000_000),
    "relationship_value_median": (3_000_000, 8_000_000),
    "deposit_share_mean": (0.20, 0.45), "salary_base_annual_median": (250_000, 600_000),
    "bonus_to_salary_mean": (0.30, 0.80), "pension_monthly_median": (5_000, 15_000),
    "dividend_yield_mean": (0.015, 0.025), "recurring_income_monthly_median": (15_000, 60_000),
    "age_primary_mean": (55, 65), "tenure_years_mean": (6, 12),
    "hard_churn_6m_rate": (0.03, 0.10), "soft_churn_3m_rate": (0.05, 0.15),
}
MONEY_COLUMNS = list(MAX_PLAUSIBLE_USD)
LATENT_PREFIXES = ("z_", "eps", "risk_index", "p_hard", "p_soft", "s1_", "p_move")

# Unit of every household column.
HOUSEHOLD_UNITS = {
    "household_id": "id", "snapshot_date": "date", "segment": "category",
    "relationship_value": "USD", "deposit_balance": "USD", "aum": "USD",
    "has_investments": "bool", "has_advisory": "bool", "has_linked_business": "bool",
    "has_trust": "bool", "has_credit_anchor": "bool", "has_payroll_stream": "bool",
    "has_pension_stream": "bool", "has_dividend_stream": "bool", "age_primary": "years",
    "tenure_years": "years", "history_months": "months", "salary_base_annual": "USD",
    "bonus_annual": "USD", "pension_monthly": "USD", "dividend_annual": "USD",
    "business_distribution_annual": "USD", "pay_frequency": "category",
    "recurring_income_monthly": "USD", "banker_id": "id", "churn_excluded": "bool",
    "hard_churn_6m": "flag", "soft_churn_3m": "flag", "value_lost_6m": "USD",
}
HOUSEHOLD_FLAGS = [c for c in HOUSEHOLD_UNITS if c.startswith("has_")]
