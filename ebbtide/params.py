"""Tunable numbers of the variable catalogue.

The defaults are the published parameter values.  ``read_params`` loads a YAML tree laid out by
build step and overlays it, so a what-if run is ``params.replace(...)`` and two DataFrames.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

AVG_MONTH_DAYS = 30.44


@dataclass(frozen=True)
class Params:
    # fixed values: balances
    min_balance_for_pct: float = 10_000.0
    history_months_cap: int = 24
    tenure_cap_years: float = 50.0
    uhnw_threshold: float = 30_000_000.0
    # fixed values: recurring-deposit detector
    min_occurrences: int = 3
    cv_max: float = 0.25
    payroll_lookback_days: int = 180
    recurring_lookback_days: int = 365
    stop_days_min: int = 45
    stop_interval_multiple: float = 1.5
    default_interval: float = 30.0
    min_stream_weight: float = 0.10
    replacement_min_ratio: float = 0.50
    bonus_multiple: float = 2.0
    business_stop_days: int = 60
    change_gap_days: int = 30
    change_baseline_days: int = 210
    change_baseline_months: float = 6.0
    quarterly_interval_days: float = 60.0
    quarterly_window_days: int = 90
    # fixed values: transfers
    history_days: int = 548
    outflow_baseline_floor_monthly: float = 10_000.0
    new_destination_min_cumulative: float = 50_000.0
    lookback_new_destination_days: int = 365
    min_amount: float = 0.005
    # fixed values: investments
    benchmark_beta_low: float = 0.2
    benchmark_beta_high: float = 1.0
    non_equity_return_monthly: float = 0.003
    # fixed values: banker
    meaningful_call_minutes: float = 5.0
    reply_max_days: int = 7
    contact_censor_days: int = 365
    min_contacts_for_reply_rate: int = 3
    temporary_cover_days: int = 30
    # fixed values: complaints
    complaint_history_days: int = 365
    # fixed values: composite
    multi_signal_min_groups: int = 3
    material_not_reinvested_usd: float = 100_000.0
    legal_cleared: bool = True
    # fixed values: outcome
    outcome_months: int = 6
    hard_churn_max_share: float = 0.05
    soft_churn_threshold: float = 0.20
    soft_churn_window_months: int = 3
    # fixed values: scoring and gates
    test_share: float = 0.30
    woe_bins: int = 10
    woe_mass_point: float = 0.05
    scorecard_min_iv: float = 0.02
    scorecard_max_corr: float = 0.80
    alpha: float = 0.01
    iv_tolerance: float = 0.03
    min_lift: float = 1.5

    def replace(self, **overrides) -> "Params":
        return dataclasses.replace(self, **overrides)


def read_params(path: str, **overrides) -> Params:
    """Overlay every leaf of a YAML tree whose name is a known parameter, then the overrides."""
    import yaml

    known = {f.name: f.type for f in dataclasses.fields(Params)}
    found: dict = {}

    def visit(node):
        for key, value in node.items():
            if isinstance(value, dict):
                visit(value)
            elif key in known and not isinstance(value, list):
                default = getattr(Params, key)
                found[key] = type(default)(value)

    with open(path, encoding="utf-8") as handle:
        visit(yaml.safe_load(handle) or {})
    found.update(overrides)
    return Params(**found)


@dataclass(frozen=True)
class IncomeLaws:
    """Laws that the columns of a household are tested against."""
    # fixed values: relationship value (lognormal body, cut Pareto tail)
    value_median: float = 4_000_000.0
    value_sigma: float = 1.2
    value_min: float = 1_000_000.0
    tail_start: float = 30_000_000.0
    tail_alpha: float = 1.5
    tail_end: float = 1_000_000_000.0
    # fixed values: beta and gamma laws
    deposit_share: tuple[float, float] = (2.0, 5.0)
    tenure: tuple[float, float] = (2.0, 4.5)
    tenure_max: int = 50
    bonus_range: tuple[float, float] = (0.10, 1.5)
    bonus_share: tuple[float, float] = (1.5, 3.0)
    dividend_yield: tuple[float, float] = (4.0, 196.0)
    # fixed values: median, sigma, link to wealth and floor of the wealth-linked lognormal laws
    salary: tuple[float, float, float, float | None] = (350_000.0, 0.55, 0.45, 150_000.0)
    pension: tuple[float, float, float, float | None] = (9_000.0, 0.50, 0.30, 2_500.0)
    business: tuple[float, float, float, float | None] = (500_000.0, 0.90, 0.50, None)
