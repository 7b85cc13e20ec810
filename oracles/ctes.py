"""Common table expressions of the reference SQL: canonical tables, then features."""

from __future__ import annotations

import re

T = "DATE '1999-12-31'"
E = "DATE '2024-01-30'"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double with no negative zero."""
    half = f"5e-{digits + 1}::DOUBLE"
    return f"(CASE WHEN abs({expr}) < {half} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END)"


def routing(inst: str, slot: str) -> str:
    first = f"lpad(CAST({inst} * 2 + {slot} AS VARCHAR), 8, '0')"
    weights = (3, 7, 1, 3, 7, 1, 3, 7)
    total = " + ".join(f"CAST(substr({first}, {i + 1}, 1) AS INTEGER) * {w}"
                       for i, w in enumerate(weights))
    return f"{first} || CAST((10 - ({total}) % 10) % 10 AS VARCHAR)"


def month(day: str) -> str:
    return f"CAST(ceil({day} / 30.44::DOUBLE) AS INTEGER)"


CTES: dict[str, str] = {}

CTES["household_raw"] = """
SELECT c_custkey AS household_id, c_nationkey AS banker_id, c_acctbal,
       abs(c_acctbal) AS bal, round(abs(c_acctbal) * 20 + (c_custkey % 97 + 1) * 1000, 2) AS rv,
       c_custkey % 7 <> 0 AS inv, c_custkey % 150 = 0 AS excl,
       CAST((c_custkey * 7 + c_nationkey) % 67 + 28 AS INTEGER) AS age
FROM customer"""

CTES["household"] = f"""
SELECT household_id, {T} AS snapshot_date, CASE WHEN c_acctbal >= 8000 THEN 'UHNW' ELSE 'HNW' END AS segment,
  rv AS relationship_value, CASE WHEN inv THEN floor(rv * 25) / 100 ELSE rv END AS deposit_balance,
  CASE WHEN inv THEN round(rv - floor(rv * 25) / 100, 2) END AS aum,
  inv AS has_investments, inv AND household_id % 10 < 7 AS has_advisory,
  household_id % 4 = 0 AS has_linked_business, household_id % 3 = 0 AS has_trust,
  household_id % 20 < 7 AS has_credit_anchor, household_id % 5 < 3 AS has_payroll_stream,
  household_id % 5 = 3 AS has_pension_stream, inv AND household_id % 2 = 0 AS has_dividend_stream,
  age AS age_primary,
  least((household_id % 300) / 10, greatest(age - 18.0::DOUBLE, 0.5::DOUBLE), 50.0::DOUBLE) AS tenure_years,
  CAST(least(24, household_id % 40 + 1) AS INTEGER) AS history_months,
  CASE WHEN household_id % 5 < 3 THEN round(bal * 40 + 150000, 2) END AS salary_base_annual,
  CASE WHEN household_id % 5 < 3 THEN CASE WHEN household_id % 8 = 0 THEN 0.0::DOUBLE
       ELSE floor(round(bal * 40 + 150000, 2) * (household_id % 50 + 10)) / 100 END END AS bonus_annual,
  CASE WHEN household_id % 5 = 3 THEN round(bal + 2500, 2) END AS pension_monthly,
  CASE WHEN inv AND household_id % 2 = 0 THEN floor(round(rv - floor(rv * 25) / 100, 2) * 2) / 100 END AS dividend_annual,
  CASE WHEN household_id % 4 = 0 THEN round(bal * 50 + 1000, 2) END AS business_distribution_annual,
  CASE WHEN household_id % 5 < 3 THEN CASE household_id % 3 WHEN 0 THEN 'biweekly' WHEN 1 THEN 'semimonthly'
       ELSE 'monthly' END END AS pay_frequency,
  banker_id, excl AS churn_excluded,
  CASE WHEN NOT excl THEN CAST(c_acctbal < -350 AS INTEGER) END AS hard_churn_6m,
  CASE WHEN NOT excl THEN CAST(c_acctbal >= 0 AND c_acctbal < 1000 AS INTEGER) END AS soft_churn_3m,
  CASE WHEN NOT excl THEN CASE WHEN c_acctbal < -350 THEN rv
       WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN floor(rv * 30) / 100 ELSE 0.0 END END AS value_lost_6m
FROM household_raw"""

CTES["institution"] = """
SELECT s_suppkey AS inst_id, CASE WHEN s_nationkey < 5 THEN 'private_bank' WHEN s_nationkey < 12 THEN 'regional_bank'
  WHEN s_nationkey < 20 THEN 'title_escrow' ELSE 'broker_wealth' END AS inst_type,
  s_nationkey < 12 AS competitor_bank, s_nationkey >= 20 AS broker_wealth FROM supplier"""

CTES["institution_aba"] = f"""
SELECT {routing('inst_id', 'slot')} AS aba, inst_id FROM (
  SELECT inst_id, unnest(CASE WHEN inst_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS slot FROM institution) q"""

CTES["ledger_lines"] = f"""
SELECT l.*, o.o_custkey, CAST(l_shipdate AS DATE) AS d, date_diff('day', {T}, CAST(l_shipdate AS DATE)) AS dy
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
WHERE date_diff('day', {T}, CAST(l_shipdate AS DATE)) > -548 AND date_diff('day', {T}, CAST(l_shipdate AS DATE)) <= 0"""

CTES["transfer"] = f"""
SELECT o_custkey AS household_id, d AS date, CAST(dy AS INTEGER) AS day,
  CASE l_linenumber WHEN 1 THEN 'background' WHEN 2 THEN 'incoming' WHEN 3 THEN 'biller' WHEN 4 THEN 'move_acats'
    WHEN 5 THEN 'one_off' WHEN 6 THEN 'move_deposit' ELSE 'irs_tax' END AS category,
  round(l_extendedprice, 2) AS amount,
  CASE WHEN l_linenumber NOT IN (3, 7) THEN l_suppkey ELSE -1 END AS inst_id,
  CASE WHEN l_linenumber NOT IN (3, 7) THEN l_partkey % 50 ELSE -1 END AS dest_id,
  CASE WHEN l_linenumber NOT IN (3, 7) THEN
    {routing('l_suppkey', '(CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey % 2 ELSE 0 END)')} END AS aba
FROM ledger_lines"""

CTES["portfolio_event"] = """
SELECT o_custkey AS household_id, CAST(dy AS INTEGER) AS day,
  CASE WHEN l_returnflag = 'A' AND l_linenumber <= 2 THEN 'liq' WHEN l_returnflag = 'A' AND l_linenumber <= 4 THEN 'prop'
    WHEN l_returnflag = 'A' THEN 'fsale' WHEN l_returnflag = 'N' THEN 'mat'
    WHEN l_linenumber = 7 THEN 'rmd' ELSE 'reinv' END AS kind,
  floor(l_extendedprice * (1.0::DOUBLE - l_discount) * 100) / 100 AS amount, l_discount * 5 AS full_share
FROM ledger_lines"""

CTES["grid"] = """
SELECT c_custkey AS household_id, abs(c_acctbal) AS bal, unnest(range(-23, 7))::INTEGER AS month FROM customer"""

CTES["order_flow"] = f"""
SELECT o_custkey AS household_id, {month(f"date_diff('day', {T}, CAST(o_orderdate AS DATE))")} AS month,
  sum(CASE WHEN o_orderkey % 2 = 0 THEN a ELSE -a END) AS signed,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN a ELSE 0 END) AS contrib,
  sum(CASE WHEN o_orderpriority = '2-HIGH' THEN a ELSE 0 END) AS withdraw
FROM (SELECT *, floor(o_totalprice * 10) / 100 AS a FROM orders) q GROUP BY 1, 2"""

CTES["monthly_all"] = """
SELECT household_id, month,
  round(greatest(500, bal * 5 + sum(s) OVER w), 2) AS deposit_avg_balance,
  CASE WHEN household_id % 7 <> 0 THEN round(bal * 10 + 20000 + greatest(0, sum(c - wd) OVER w), 2) END AS aum_month_end,
  CASE WHEN household_id % 7 <> 0 THEN round(c, 2) ELSE 0.0 END AS aum_contributions,
  CASE WHEN household_id % 7 <> 0 THEN round(wd, 2) ELSE 0.0 END AS aum_withdrawals,
  1.0::DOUBLE + (month + 23) * 4 / 1000 AS twr_index, month > -least(24, household_id % 40 + 1) AS available
FROM (SELECT g.household_id, g.month, bal, coalesce(signed, 0) AS s, coalesce(contrib, 0) AS c, coalesce(withdraw, 0) AS wd
      FROM grid g LEFT JOIN order_flow f ON g.household_id = f.household_id AND g.month = f.month) q
WINDOW w AS (PARTITION BY household_id ORDER BY month ROWS UNBOUNDED PRECEDING)"""
CTES["monthly"] = "SELECT * FROM monthly_all WHERE month <= 0"
CTES["outcome"] = """
SELECT household_id, month AS k, deposit_avg_balance AS deposit, coalesce(aum_month_end, 0) AS aum, twr_index AS twr,
  household_id % 150 = 0 AS excluded FROM monthly_all WHERE month >= 0"""
CTES["monthly_cash"] = """
SELECT household_id, month, ((household_id * 31 + (month + 23) * 17) % 95) / 100 AS cash_pct FROM grid WHERE month <= 0"""
CTES["monthly_return"] = """
SELECT household_id, month, ((household_id + (month + 23) * 7) % 21 - 10) / 500 AS portfolio_return,
  ((month + 23) * 13 % 17 - 8) / 400 AS market_return, household_id % 70 / 100 + 0.3::DOUBLE AS equity_share
FROM grid WHERE month <= 0"""

CTES["ev"] = f"""
SELECT event_id, user_id AS household_id, event_type, value, CAST(ts AS DATE) AS date,
  CAST(date_diff('day', {E}, CAST(ts AS DATE)) AS INTEGER) AS day,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
CTES["recurring_tx"] = """
SELECT household_id, date, day, CASE event_type
  WHEN 'click' THEN CASE WHEN k % 10 = 9 THEN 'payroll_new' ELSE 'payroll' END
  WHEN 'signup' THEN CASE WHEN household_id % 2 = 0 THEN 'bonus' ELSE 'payroll_new' END
  WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'pension_new' ELSE 'pension' END
  WHEN 'view' THEN CASE WHEN household_id % 2 = 0 THEN 'dividend' ELSE 'business_distribution' END
  ELSE 'business_payroll' END AS stream,
  CASE WHEN event_type = 'error' THEN 'debit' ELSE 'credit' END AS direction,
  CASE WHEN event_type = 'error' THEN 'CCD' ELSE 'PPD' END AS sec_code, value AS amount FROM ev"""
CTES["recurring_event"] = """
SELECT c_custkey AS household_id, c_custkey % 29 = 0 AS retire_reported, c_custkey % 31 = 0 AS leave_reported,
  c_custkey % 150 = 0 AS death_reported, c_custkey % 37 = 0 AS business_sale FROM customer"""
CTES["interaction"] = """
SELECT household_id, date, day, CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'email' WHEN 'signup' THEN 'message'
  WHEN 'purchase' THEN 'meeting' ELSE 'meeting_cancelled_by_client' END AS kind, k % 2 = 0 AS replied_7d,
  value / 10 AS minutes FROM ev"""
CTES["complaint"] = """
SELECT complaint_id, household_id, category, open_day, CASE WHEN res <= 0 THEN res END AS close_day,
  CASE WHEN res > 0 THEN 'open' ELSE 'closed' END AS status, sla_days,
  CASE WHEN res > 0 THEN -open_day ELSE res - open_day END AS elapsed_days,
  CASE WHEN res > 0 THEN -open_day ELSE res - open_day END > sla_days AS out_of_sla, escalation_level,
  k % 13 = 0 AND res <= 0 AS reopened
FROM (SELECT event_id AS complaint_id, household_id, k,
    ['fees_pricing','process_delay','banker_attention','digital','transfers_wires','statement_error',
     'investment_performance','fraud_dispute'][k % 8 + 1] AS category,
    [7, 10, 5, 5, 5, 6, 10, 15][k % 8 + 1] AS sla_days, day AS open_day,
    CAST(day + 1 + floor(value / 20) AS INTEGER) AS res,
    CASE k % 10 WHEN 0 THEN 'management' WHEN 1 THEN 'ombudsman' WHEN 2 THEN 'regulator' WHEN 3 THEN 'legal'
      ELSE 'none' END AS escalation_level
  FROM ev WHERE event_type = 'error') q"""
CTES["assistant"] = """
SELECT c_custkey AS household_id, c_custkey % 10 < 3 AS assistant_pilot, c_custkey % 10 = 1 AS classifier_flag,
  c_custkey % 20 = 1 AS human_confirmed FROM customer"""
CTES["account"] = f"""
SELECT account_id, household_id, product, CASE WHEN st <> 'O' AND dy <= 0 THEN dy END AS close_day,
  CASE WHEN st <> 'O' AND dy <= 0 THEN ['client_request','cd_renewed','conversion','consolidation','loan_paid_at_term',
    'moved_relationship'][account_id % 6 + 1] END AS close_reason
FROM (SELECT o_orderkey AS account_id, o_custkey AS household_id, o_orderpriority AS product, o_orderstatus AS st,
  CAST(date_diff('day', {T}, CAST(o_orderdate AS DATE)) AS INTEGER) AS dy FROM orders) q"""
CTES["wealth_estimate"] = """
SELECT h.household_id, relationship_value AS value_t, deposit_avg_balance + coalesce(aum_month_end, 0) AS value_6m,
  CASE WHEN h.household_id % 5 = 0 THEN relationship_value * 1.5::DOUBLE END AS declared,
  CASE WHEN h.household_id % 5 <= 2 THEN relationship_value * 2.25::DOUBLE END AS vendor,
  relationship_value * 1.25::DOUBLE + 50000 AS model, relationship_value * (h.household_id % 5 + 8) / 8 AS wealth_old
FROM household h JOIN monthly_all m ON h.household_id = m.household_id AND m.month = -6"""
CTES["trust_event"] = """
SELECT c_custkey AS household_id, 'trustee_move' AS kind FROM customer WHERE c_custkey % 12 = 0 UNION ALL
SELECT c_custkey, 'trustee_service' FROM customer WHERE c_custkey % 17 = 0 UNION ALL
SELECT c_custkey, 'trustee_noise' FROM customer WHERE c_custkey % 23 = 0 UNION ALL
SELECT c_custkey, 'death_succession' FROM customer WHERE c_custkey % 29 = 0"""
CTES["banker"] = """
SELECT n_nationkey AS banker_id, CASE WHEN n_nationkey % 5 = 0 THEN -(n_nationkey * 3 + 20) END AS departure_day,
  n_nationkey % 5 < 2 AS captured FROM nation"""
CTES["household_banker_event"] = """
SELECT c_custkey AS household_id, CASE WHEN c_custkey % 23 = 0 THEN -(c_custkey % 170 + 1) END AS client_request_day,
  CASE WHEN c_custkey % 19 = 0 THEN -(c_custkey % 150 + 1) END AS rebalance_day,
  CASE WHEN c_custkey % 31 = 0 AND c_custkey % 45 >= 30 THEN -(c_custkey % 100 + 1) END AS reassigned_day FROM customer"""
CTES["scores"] = """
SELECT household_id, segment, hard_churn_6m AS label, relationship_value AS value, model, score,
  CASE WHEN model = 'statistical' THEN score / 8 END AS prob
FROM (SELECT household_id, segment, hard_churn_6m, relationship_value, unnest(['rules', 'expert', 'statistical']) AS model,
    unnest([CASE WHEN household_id % 9 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
      floor(((household_id * 7919 % 1000) / 1000 + sig) * 8) * 10.0::DOUBLE,
      ((household_id * 7919 % 1000) / 1000 + sig) / 1.25::DOUBLE]) AS score
  FROM (SELECT *, CASE WHEN hard_churn_6m = 1 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS sig
        FROM household WHERE NOT churn_excluded) a) b"""

# ------------------------------------------------------------------ features
_ok = lambda lo, hi: f"count(*) FILTER (WHERE month BETWEEN {lo} AND {hi} AND available) = {hi - lo + 1}"
_avg = lambda e, lo, hi: f"avg({e}) FILTER (WHERE month BETWEEN {lo} AND {hi})"
_at = lambda e, m: f"max({e}) FILTER (WHERE month = {m})"
_sum = lambda e, lo: f"coalesce(sum({e}) FILTER (WHERE month BETWEEN {lo} AND 0), 0)"
_d, _x = "deposit_avg_balance", "aum_month_end / twr_index"

CTES["panel_agg"] = f"""
SELECT household_id,
  {_ok(0, 0)} AS ok1, {_ok(-2, 0)} AS ok3, {_ok(-3, 0)} AS ok4, {_ok(-6, 0)} AS ok7, {_ok(-1, 0)} AS ok2,
  {_ok(-5, 0)} AS ok6, {_ok(-1, -1)} AS p1, {_ok(-5, -3)} AS p3, {_ok(-11, -6)} AS p6, {_ok(-6, -1)} AS b6,
  {_sum('aum_withdrawals', 0)} - {_sum('aum_contributions', 0)} AS net1,
  {_sum('aum_withdrawals', -2)} - {_sum('aum_contributions', -2)} AS net3, {_sum('aum_contributions', -2)} AS con3,
  {_avg('aum_month_end', 0, 0)} AS a1, {_avg('aum_month_end', -1, 0)} AS a2, {_avg('aum_month_end', -2, 0)} AS a3,
  {_at('aum_month_end', -3)} AS a_start,
  {_avg(_d, 0, 0)} AS d1, {_avg(_d, -1, 0)} AS d2, {_avg(_d, -2, 0)} AS d3, {_avg(_d, -5, 0)} AS d6,
  {_avg(_d, -1, -1)} AS q1, {_avg(_d, -5, -3)} AS q3, {_avg(_d, -11, -6)} AS q6, {_avg(_d, -6, -1)} AS db,
  {_at(_d, 0)} AS dn, {_at(_d, 0)} - {_at(_d, -1)} AS f1, {_at(_d, 0)} - {_at(_d, -3)} AS f3,
  {_at(_x, 0)} AS xn, {_avg(_x, -6, -1)} AS xb
FROM monthly GROUP BY 1"""

CTES["f_balances"] = """
SELECT h.household_id,
  CASE WHEN inv AND ok1 THEN greatest(net1, 0) END AS aum_outflow_30d,
  CASE WHEN inv AND ok1 AND a1 > 0 THEN greatest(net1, 0) / a1 END AS aum_outflow_pct_30d,
  CASE WHEN inv AND ok3 THEN greatest(net3, 0) END AS aum_outflow_90d,
  CASE WHEN inv AND ok3 AND a3 > 0 THEN greatest(net3, 0) / a3 END AS aum_outflow_pct_90d,
  CASE WHEN p1 AND q1 >= 10000 AND ok1 THEN d1 / q1 - 1 END AS deposit_balance_change_pct_30d,
  CASE WHEN p3 AND q3 >= 10000 AND ok3 THEN d3 / q3 - 1 END AS deposit_balance_change_pct_90d,
  CASE WHEN p6 AND q6 >= 10000 AND ok6 THEN d6 / q6 - 1 END AS deposit_balance_change_pct_180d,
  CASE WHEN ok2 THEN f1 END AS net_deposit_flow_30d, CASE WHEN ok2 AND d1 >= 10000 THEN f1 / d1 END AS net_deposit_flow_pct_30d,
  CASE WHEN ok4 THEN f3 END AS net_deposit_flow_90d, CASE WHEN ok4 AND d3 >= 10000 THEN f3 / d3 END AS net_deposit_flow_pct_90d,
  CASE WHEN inv AND b6 AND xb > 0 THEN xn / xb - 1 END AS aum_vs_baseline_pct,
  CASE WHEN b6 AND db >= 10000 THEN dn / db - 1 END AS deposit_balance_vs_6m_avg_pct
FROM (SELECT household_id, has_investments AS inv FROM household) h JOIN panel_agg p ON h.household_id = p.household_id"""

_cash = lambda a: f"(CASE WHEN h.has_investments THEN h.household_id % 20 / 100 * {a} ELSE 0 END)"
CTES["balance"] = f"""
SELECT h.household_id, CASE WHEN ok1 THEN d1 + {_cash('a1')} END AS b30, CASE WHEN ok2 THEN d2 + {_cash('a2')} END AS b60,
  CASE WHEN ok3 THEN d3 + {_cash('a3')} END AS b90 FROM household h JOIN panel_agg p ON h.household_id = p.household_id"""

CTES["ext"] = """
SELECT t.*, coalesce(i.competitor_bank, false) AS comp FROM transfer t LEFT JOIN institution i ON t.inst_id = i.inst_id
WHERE category IN ('background','one_off','real_estate','episode_deposit','episode_acats','move_deposit','move_acats','shock_aum')"""
CTES["new_dest"] = """
SELECT household_id, count(*) FILTER (WHERE w30 >= 50000 AND n30 > 0 AND fd > -30 AND p30 = 0) AS new30,
  count(*) FILTER (WHERE w90 >= 50000 AND n90 > 0 AND fd > -90 AND p90 = 0) AS new90
FROM (SELECT household_id, dest_id, min(day) AS fd, sum(amount) FILTER (WHERE day > -30) AS w30,
    sum(amount) FILTER (WHERE day > -90) AS w90, count(*) FILTER (WHERE day > -30) AS n30,
    count(*) FILTER (WHERE day > -90) AS n90, count(*) FILTER (WHERE day > -395 AND day <= -30) AS p30,
    count(*) FILTER (WHERE day > -455 AND day <= -90) AS p90
  FROM ext GROUP BY 1, 2) q GROUP BY 1"""
CTES["hhi_inst"] = """
SELECT household_id, sum(a * a) / (sum(a) * sum(a)) AS hhi
FROM (SELECT household_id, inst_id, sum(amount) AS a FROM ext WHERE day > -90 GROUP BY 1, 2) q GROUP BY 1"""
CTES["ext_sums"] = """
SELECT household_id, sum(amount) FILTER (WHERE day > -30) AS o30, sum(amount) FILTER (WHERE day > -60) AS o60,
  sum(amount) FILTER (WHERE day > -90) AS o90, sum(amount) FILTER (WHERE day > -60 AND day <= -30) AS o3060,
  sum(amount) FILTER (WHERE day > -90 AND day <= -60) AS o6090, sum(amount) FILTER (WHERE day > -210 AND day <= -30) AS base,
  sum(amount) FILTER (WHERE comp AND day > -90) AS c90,
  sum(amount) FILTER (WHERE category NOT IN ('episode_acats','move_acats','shock_aum') AND day > -30) AS w30,
  sum(amount) FILTER (WHERE category NOT IN ('episode_acats','move_acats','shock_aum') AND day > -90) AS w90
FROM ext GROUP BY 1"""
CTES["inc_sums"] = """
SELECT household_id, sum(amount) FILTER (WHERE day > -30) AS i30, sum(amount) FILTER (WHERE day > -90) AS i90
FROM transfer WHERE category = 'incoming' GROUP BY 1"""
CTES["f_transfers"] = """
SELECT household_id, CASE WHEN hist >= 2 THEN o60 END AS external_transfer_amount_60d,
  CASE WHEN b60 >= 10000 THEN o60 / b60 END AS external_transfer_pct_of_balance_60d,
  CASE WHEN b30 >= 10000 THEN o30 / b30 END AS external_transfer_pct_of_balance_30d,
  CASE WHEN hist >= 14 THEN new30 END AS new_external_destinations_30d,
  CASE WHEN hist >= 16 THEN new90 END AS new_external_destinations_90d,
  CASE WHEN hist >= 3 THEN c90 END AS transfer_to_competitor_bank_amount_90d,
  CASE WHEN b90 >= 10000 THEN c90 / b90 END AS transfer_to_competitor_pct_90d,
  CASE WHEN hist >= 3 AND b90 >= 10000 AND o30 + o3060 + o6090 > 0 THEN ((o30 - o3060) - (o3060 - o6090)) / b90 END AS external_transfer_acceleration,
  CASE WHEN b90 >= 10000 THEN o30 / b90 END AS external_outflow_pct_30d,
  CASE WHEN hist >= 1 THEN i30 - w30 END AS net_external_flow_30d, CASE WHEN hist >= 3 THEN i90 - w90 END AS net_external_flow_90d,
  CASE WHEN b90 >= 10000 THEN (i90 - w90) / b90 END AS net_external_flow_pct_90d,
  CASE WHEN hist >= 3 THEN hhi END AS external_destination_concentration,
  CASE WHEN b90 >= 10000 THEN (o30 + o3060 + o6090) / b90 END AS external_outflow_pct_90d,
  CASE WHEN hist >= 7 THEN o30 / greatest(base / 6, 10000) - 1 END AS outflow_vs_baseline_pct
FROM (SELECT h.household_id, history_months AS hist, b30, b60, b90, coalesce(o30, 0) AS o30, coalesce(o60, 0) AS o60,
    coalesce(o3060, 0) AS o3060, coalesce(o6090, 0) AS o6090, coalesce(base, 0) AS base, coalesce(c90, 0) AS c90,
    coalesce(w30, 0) AS w30, coalesce(w90, 0) AS w90, coalesce(i30, 0) AS i30, coalesce(i90, 0) AS i90,
    CAST(coalesce(new30, 0) AS INTEGER) AS new30, CAST(coalesce(new90, 0) AS INTEGER) AS new90, hhi
  FROM household h LEFT JOIN balance b ON h.household_id = b.household_id
  LEFT JOIN ext_sums e ON h.household_id = e.household_id LEFT JOIN inc_sums i ON h.household_id = i.household_id
  LEFT JOIN new_dest n ON h.household_id = n.household_id LEFT JOIN hhi_inst x ON h.household_id = x.household_id) q"""

CTES["sold"] = f"""
SELECT m.household_id, m.month, greatest(aum_withdrawals - coalesce(a, 0), 0) AS sold_for_withdrawal
FROM monthly m LEFT JOIN (SELECT household_id, {month('day')} AS month, sum(amount) AS a FROM transfer
  WHERE category IN ('episode_acats', 'move_acats') GROUP BY 1, 2) t ON m.household_id = t.household_id AND m.month = t.month"""
CTES["sold3"] = "SELECT household_id, sum(sold_for_withdrawal) AS sold FROM sold WHERE month >= -2 GROUP BY 1"
CTES["pe"] = """
SELECT household_id, coalesce(sum(amount) FILTER (WHERE kind IN ('liq','prop','fsale','mat')), 0) AS sales,
  coalesce(sum(amount) FILTER (WHERE kind = 'rmd'), 0) AS rmd, coalesce(sum(amount) FILTER (WHERE kind = 'reinv'), 0) AS reinv,
  coalesce(sum(amount) FILTER (WHERE kind = 'mat'), 0) AS mat,
  coalesce(sum(amount * full_share) FILTER (WHERE kind = 'liq'), 0) + coalesce(sum(amount) FILTER (WHERE kind IN ('prop','fsale')), 0) AS fulls
FROM portfolio_event WHERE day > -90 GROUP BY 1"""
CTES["year_return"] = """
SELECT household_id, product(1 + portfolio_return) - product(1 + beta * market_return + (1 - beta) * 0.003::DOUBLE) AS excess
FROM (SELECT *, greatest(0.2::DOUBLE, least(1.0::DOUBLE, equity_share + (household_id % 11 - 5) / 50)) AS beta
      FROM monthly_return WHERE month > -12) q GROUP BY 1"""
CTES["cash_agg"] = f"""
SELECT household_id, {_at('cash_pct', 0)} - {_avg('cash_pct', -6, -1)} AS chg FROM monthly_cash GROUP BY 1"""


def _investments(rmd: str) -> str:
    return f"""
SELECT h.household_id, CASE WHEN h.has_investments AND ok3 AND a3 > 0 THEN
    greatest(sold + coalesce(sales, 0) - {rmd} - con3 - coalesce(reinv, 0), 0) / a3 END AS investment_redemption_pct,
  CASE WHEN h.has_investments AND mat > 0 THEN 1 - reinv / mat END AS fixed_income_maturity_not_reinvested,
  CASE WHEN h.has_investments AND mat > 0 THEN mat - reinv END AS fixed_income_not_reinvested_amount,
  CASE WHEN h.has_investments AND ok7 THEN chg END AS cash_pct_of_portfolio_chg,
  CASE WHEN h.has_advisory AND history_months >= 12 THEN excess END AS return_vs_benchmark,
  CASE WHEN h.has_investments AND ok4 AND a_start > 0 THEN coalesce(fulls, 0) / a_start END AS positions_liquidated_pct
FROM household h JOIN panel_agg p ON h.household_id = p.household_id JOIN sold3 s ON h.household_id = s.household_id
JOIN year_return y ON h.household_id = y.household_id JOIN cash_agg c ON h.household_id = c.household_id
LEFT JOIN pe ON h.household_id = pe.household_id"""


CTES["f_investments"] = _investments("coalesce(rmd, 0)")
CTES["f_investments_rmd"] = _investments("0")

CTES["f_relationship"] = """
SELECT h.household_id,
  CASE WHEN history_months >= 3 THEN CAST(coalesce(p90, 0) AS INTEGER) END AS products_closed_90d,
  CASE WHEN history_months >= 3 THEN CAST(coalesce(a90, 0) AS INTEGER) END AS accounts_closed_90d,
  CASE WHEN history_months >= 6 THEN CAST(coalesce(p180, 0) AS INTEGER) END AS products_closed_180d,
  CASE WHEN history_months >= 6 THEN CAST(coalesce(a180, 0) AS INTEGER) END AS accounts_closed_180d,
  least(1, value_t / coalesce(declared, vendor, model)) AS share_of_wallet,
  CASE WHEN declared IS NOT NULL THEN 'declared' WHEN vendor IS NOT NULL THEN 'vendor' ELSE 'model' END AS wealth_estimate_source,
  CASE WHEN history_months >= 7 THEN least(1, value_t / coalesce(declared, vendor, model)) - least(1, value_6m / wealth_old) END AS share_of_wallet_change,
  CASE WHEN has_trust THEN CAST(coalesce(chg, false) AS INTEGER) END AS trustee_change_flag
FROM household h LEFT JOIN (SELECT household_id,
    count(DISTINCT product) FILTER (WHERE pr AND close_day > -90) AS p90, count(*) FILTER (WHERE ar AND close_day > -90) AS a90,
    count(DISTINCT product) FILTER (WHERE pr) AS p180, count(*) FILTER (WHERE ar) AS a180
  FROM (SELECT *, close_reason NOT IN ('cd_renewed','loan_paid_at_term','conversion','consolidation') AS pr,
      close_reason NOT IN ('cd_renewed','consolidation') AS ar FROM account WHERE close_day > -180 AND close_day <= 0) a GROUP BY 1) c
  ON h.household_id = c.household_id
JOIN wealth_estimate w ON h.household_id = w.household_id
LEFT JOIN (SELECT household_id, bool_or(kind <> 'death_succession') AS chg FROM trust_event GROUP BY 1) t ON h.household_id = t.household_id"""

CTES["banker_change"] = """
SELECT household_id, history_months, segment, captured, CASE WHEN cd > -180 THEN cd END AS change_day,
  CASE WHEN cd > -180 THEN cr END AS change_reason
FROM (SELECT h.household_id, history_months, segment, captured,
    coalesce(departure_day, client_request_day, rebalance_day, reassigned_day) AS cd,
    CASE WHEN departure_day IS NOT NULL THEN 'banker_departure' WHEN client_request_day IS NOT NULL THEN 'client_request'
      WHEN rebalance_day IS NOT NULL THEN 'book_rebalancing' WHEN reassigned_day IS NOT NULL THEN 'reassignment' END AS cr
  FROM household h LEFT JOIN banker b ON h.banker_id = b.banker_id
  LEFT JOIN household_banker_event e ON h.household_id = e.household_id) q"""
CTES["contact"] = """
SELECT household_id, max(day) FILTER (WHERE kind = 'meeting' OR (kind = 'call' AND minutes >= 5) OR (kind IN ('email','message') AND replied_7d)) AS last_c,
  count(*) FILTER (WHERE kind IN ('call','email','message') AND day > -90) AS n,
  count(*) FILTER (WHERE kind IN ('call','email','message') AND day > -90 AND replied_7d) AS rep,
  count(*) FILTER (WHERE kind IN ('meeting','meeting_cancelled_by_client') AND day > -180) AS sched,
  count(*) FILTER (WHERE kind = 'meeting_cancelled_by_client' AND day > -180) AS canc
FROM interaction WHERE day > -365 GROUP BY 1"""
CTES["f_banker"] = """
SELECT b.household_id, CASE WHEN history_months >= 6 THEN CAST(change_day IS NOT NULL AS INTEGER) END AS banker_change_6m_flag,
  change_reason AS banker_change_reason, CAST(coalesce(-last_c, 365) AS INTEGER) AS days_since_meaningful_contact,
  coalesce(-last_c, 365) / CASE segment WHEN 'HNW' THEN 90 ELSE 30 END AS contact_gap_ratio,
  CASE WHEN n >= 3 THEN rep / n END AS client_reply_rate,
  CASE WHEN captured THEN CAST(coalesce(canc, 0) AS INTEGER) END AS meetings_cancelled_by_client,
  CASE WHEN captured AND sched > 0 THEN canc / sched END AS meetings_cancelled_pct
FROM banker_change b LEFT JOIN contact c ON b.household_id = c.household_id"""
CTES["f_complaints"] = """
SELECT h.household_id, CAST(coalesce(esc, false) AS INTEGER) AS complaint_escalated_flag,
  CAST(oldest IS NOT NULL AS INTEGER) AS open_complaint_flag, CAST(coalesce(-oldest, 0) AS INTEGER) AS complaint_age_days,
  CAST(coalesce(late, false) AS INTEGER) AS complaint_out_of_sla_flag,
  CAST(coalesce(mx >= 2 OR reop, false) AS INTEGER) AS repeat_complaint_flag, CAST(coalesce(n, 0) AS INTEGER) AS complaints_12m,
  CASE WHEN assistant_pilot THEN CAST(human_confirmed AS INTEGER) END AS relationship_dissatisfaction_flag
FROM household h JOIN assistant s ON h.household_id = s.household_id LEFT JOIN (
  SELECT household_id, count(*) AS n, bool_or(escalation_level <> 'none') AS esc, min(open_day) FILTER (WHERE status = 'open') AS oldest,
    bool_or(status = 'open' AND out_of_sla) AS late, bool_or(reopened) AS reop FROM complaint GROUP BY 1) c ON h.household_id = c.household_id
LEFT JOIN (SELECT household_id, max(c) AS mx FROM (SELECT household_id, category, count(*) AS c FROM complaint GROUP BY 1, 2) g GROUP BY 1) m
  ON h.household_id = m.household_id"""
CTES["f_bureau"] = """
SELECT c_custkey AS household_id, CASE WHEN c_custkey % 20 <> 0 THEN CAST(c_custkey % 13 = 0 AND c_custkey % 11 <> 0
  AND c_custkey % 240 < 180 AS INTEGER) END AS bureau_new_mortgage_elsewhere FROM customer"""

# ------------------------------------------------------------------ detector
CTES["pay_case"] = """
SELECT household_id, c.c AS cs, fam AS stream, day, amount, fam = 'payroll' AS br, c.e AS e FROM (
  SELECT *, CASE WHEN stream = 'bonus' THEN 'payroll' ELSE stream END AS fam FROM recurring_tx) r
JOIN (VALUES ('salary', 'payroll', -2), ('salary', 'payroll_new', -2), ('business', 'business_payroll', -4),
  ('flows', 'payroll', -2), ('flows', 'payroll_new', -2), ('flows', 'pension', -2), ('flows', 'pension_new', -2),
  ('flows', 'dividend', -2), ('flows', 'business_distribution', -2),
  ('change', 'payroll', -7), ('change', 'payroll_new', -7), ('change', 'pension', -7), ('change', 'pension_new', -7),
  ('change', 'dividend', -7), ('change', 'business_distribution', -7)) c(c, s, e) ON r.fam = c.s"""


def _detect(prefix: str, source: str) -> None:
    CTES[f"{prefix}_in"] = f"SELECT * FROM {source} WHERE day > e - 30 AND day <= e"
    CTES[f"{prefix}_reg"] = f"""
SELECT p.* FROM {prefix}_in p JOIN (SELECT household_id, cs, stream, median(amount) AS m FROM {prefix}_in GROUP BY 1, 2, 3) q
  ON p.household_id = q.household_id AND p.cs = q.cs AND p.stream = q.stream WHERE NOT (br AND amount > 2 * m)"""
    CTES[f"{prefix}_gap"] = f"""
SELECT household_id, cs, stream, amount, day - lag(day) OVER (PARTITION BY household_id, cs, stream ORDER BY day) AS gap FROM {prefix}_reg"""
    CTES[prefix] = f"""
SELECT household_id, cs, stream, count(*) >= 3 AND coalesce(stddev_pop(gap) / nullif(avg(gap), 0) < 0.97, false) AS ex,
  median(gap) AS itv, median(amount) AS med FROM {prefix}_gap GROUP BY 1, 2, 3"""


_detect("det1", "pay_case")
CTES["pay_again"] = """
SELECT p.household_id, p.cs, p.stream, p.day, p.amount, p.br, -greatest(2.0::DOUBLE, 1.5::DOUBLE * coalesce(itv, 2)) AS e
FROM pay_case p LEFT JOIN det1 d ON p.household_id = d.household_id AND p.cs = d.cs AND p.stream = d.stream
WHERE p.cs IN ('salary', 'flows')"""
_detect("det2", "pay_again")
CTES["pay_end"] = "SELECT DISTINCT household_id, cs, stream, e FROM pay_again"
CTES["stop_row"] = """
SELECT d.household_id, d.cs, d.stream, ex, itv, med, e FROM det2 d JOIN pay_end t ON d.household_id = t.household_id AND d.cs = t.cs AND d.stream = t.stream
UNION ALL SELECT household_id, cs, stream, ex, itv, med, -4 FROM det1 WHERE cs IN ('change', 'business')"""
CTES["stops"] = """
SELECT s.household_id, s.cs, s.stream, ex, itv, med, ld, ex AND coalesce(ld <= e, true) AS stopped FROM stop_row s LEFT JOIN (
  SELECT p.household_id, p.cs, p.stream, max(day) FILTER (WHERE NOT br OR amount <= 2 * med) AS ld FROM pay_case p
  JOIN stop_row s ON p.household_id = s.household_id AND p.cs = s.cs AND p.stream = s.stream GROUP BY 1, 2, 3) l
  ON s.household_id = l.household_id AND s.cs = l.cs AND s.stream = l.stream"""
CTES["replaced"] = """
SELECT f.household_id, bool_or(coalesce(day > ld, true) AND coalesce(amount >= 0.5::DOUBLE * med, false)) AS rep
FROM (SELECT household_id, day, amount FROM recurring_tx WHERE stream = 'payroll_new') f
JOIN (SELECT * FROM stops WHERE cs = 'salary' AND stream = 'payroll') o ON f.household_id = o.household_id GROUP BY 1"""
CTES["weights"] = """
SELECT *, meq / nullif(tot, 0) AS weight FROM (SELECT *, sum(meq) OVER (PARTITION BY household_id) AS tot
  FROM (SELECT *, CASE WHEN ex THEN med * 30.44::DOUBLE / nullif(itv, 0) ELSE 0 END AS meq FROM stops WHERE cs = 'flows') a) b"""
CTES["hits"] = """
SELECT household_id, max(tot) AS tot, coalesce(bool_or(hit), false) AS any_stop, arg_min(nm, pr) FILTER (WHERE hit) AS stopped_type
FROM (SELECT w.household_id, tot, replace(stream, '_new', '') AS nm,
    list_position(['payroll','payroll_new','pension','pension_new','dividend','business_distribution'], stream) AS pr,
    stopped AND weight >= 0.10::DOUBLE AND NOT CASE stream WHEN 'payroll' THEN retire_reported OR leave_reported OR death_reported OR coalesce(rep, false)
      WHEN 'payroll_new' THEN retire_reported OR leave_reported OR death_reported
      WHEN 'business_distribution' THEN death_reported OR business_sale ELSE death_reported END AS hit
  FROM weights w JOIN recurring_event e ON w.household_id = e.household_id LEFT JOIN replaced r ON w.household_id = r.household_id) q GROUP BY 1"""
CTES["change"] = """
SELECT household_id, coalesce(sum(CASE WHEN itv > 6 THEN amount / 3 ELSE amount END) FILTER (WHERE day > CASE WHEN itv > 6 THEN -14 ELSE -7 END), 0) AS recent,
  coalesce(sum(amount) FILTER (WHERE day > -28 AND day <= -7), 0) / 3 AS baseline
FROM (SELECT p.household_id, p.day, p.amount, s.itv FROM pay_case p JOIN stops s ON p.household_id = s.household_id AND p.cs = s.cs AND p.stream = s.stream
  WHERE p.cs = 'change' AND s.ex AND (NOT br OR amount <= 2 * med)) q GROUP BY 1"""
CTES["f_recurring"] = """
SELECT h.household_id,
  CASE WHEN pk THEN CAST(((ops AND NOT coalesce(rep, false)) OR nps) AND NOT (retire_reported OR leave_reported OR death_reported) AS INTEGER) END AS salary_deposit_stopped_flag,
  CASE WHEN tot > 0 THEN CAST(any_stop AS INTEGER) END AS recurring_deposit_stopped_flag,
  CASE WHEN tot > 0 AND any_stop THEN stopped_type END AS recurring_deposit_stopped_type,
  CASE WHEN baseline > 0 THEN recent / baseline - 1 END AS recurring_deposit_change_pct,
  CASE WHEN nk THEN CAST(ns AND NOT death_reported AS INTEGER) END AS pension_deposit_stopped_flag,
  CASE WHEN bk THEN CAST(bs AND NOT business_sale AND NOT death_reported AS INTEGER) END AS business_payroll_stopped_flag
FROM household h JOIN recurring_event e ON h.household_id = e.household_id LEFT JOIN (SELECT household_id,
    coalesce(bool_or(ex) FILTER (WHERE cs = 'salary'), false) AS pk,
    coalesce(bool_or(stopped) FILTER (WHERE cs = 'salary' AND stream = 'payroll'), false) AS ops,
    coalesce(bool_or(stopped) FILTER (WHERE cs = 'salary' AND stream = 'payroll_new'), false) AS nps,
    coalesce(bool_or(ex) FILTER (WHERE cs = 'flows' AND stream LIKE 'pension%'), false) AS nk,
    coalesce(bool_or(stopped) FILTER (WHERE cs = 'flows' AND stream LIKE 'pension%'), false) AS ns,
    coalesce(bool_or(ex) FILTER (WHERE cs = 'business'), false) AS bk,
    coalesce(bool_or(stopped) FILTER (WHERE cs = 'business'), false) AS bs FROM stops GROUP BY 1) s ON h.household_id = s.household_id
LEFT JOIN replaced r ON h.household_id = r.household_id LEFT JOIN hits k ON h.household_id = k.household_id
LEFT JOIN change c ON h.household_id = c.household_id"""

CTES["features"] = """
SELECT * FROM f_balances JOIN f_recurring USING (household_id) JOIN f_transfers USING (household_id)
JOIN f_investments USING (household_id) JOIN f_relationship USING (household_id) JOIN f_banker USING (household_id)
JOIN f_complaints USING (household_id)"""
_c = lambda *conds: "CAST(" + " OR ".join(f"coalesce({c}, false)" for c in conds) + " AS INTEGER)"
CTES["f_groups"] = f"""
SELECT household_id,
 {_c('aum_outflow_pct_90d > 0.1::DOUBLE', 'deposit_balance_change_pct_90d <= -0.25', 'aum_vs_baseline_pct <= -0.2::DOUBLE', 'deposit_balance_vs_6m_avg_pct <= -0.3::DOUBLE')} AS group_alert_balances,
 {_c('salary_deposit_stopped_flag = 1', 'recurring_deposit_stopped_flag = 1', 'recurring_deposit_change_pct <= -0.4::DOUBLE', 'net_deposit_flow_pct_90d <= -0.15::DOUBLE', 'pension_deposit_stopped_flag = 1', 'business_payroll_stopped_flag = 1')} AS group_alert_recurring,
 {_c('external_transfer_pct_of_balance_60d > 0.15::DOUBLE', 'new_external_destinations_30d >= 1', 'transfer_to_competitor_pct_90d > 0.1::DOUBLE', '(external_transfer_acceleration > 0 AND external_outflow_pct_30d > 0.05::DOUBLE)', 'net_external_flow_pct_90d <= -0.15::DOUBLE', '(external_destination_concentration > 0.7::DOUBLE AND external_outflow_pct_90d > 0.1::DOUBLE)', 'outflow_vs_baseline_pct > 1')} AS group_alert_transfers,
 {_c('investment_redemption_pct > 0.2::DOUBLE', '(fixed_income_maturity_not_reinvested > 0.5 AND fixed_income_not_reinvested_amount >= 100000)', 'cash_pct_of_portfolio_chg > 0.1::DOUBLE', 'return_vs_benchmark <= -0.03::DOUBLE', 'positions_liquidated_pct > 0.15::DOUBLE')} AS group_alert_investments,
 {_c('products_closed_90d >= 1', 'accounts_closed_90d >= 1', 'share_of_wallet < 0.3::DOUBLE', 'share_of_wallet_change <= -0.1::DOUBLE', 'trustee_change_flag = 1')} AS group_alert_relationship,
 {_c('banker_change_6m_flag = 1', 'contact_gap_ratio > 2', 'client_reply_rate < 0.5', 'meetings_cancelled_by_client >= 2', 'meetings_cancelled_pct >= 0.5')} AS group_alert_banker,
 {_c('complaint_escalated_flag = 1', 'complaint_age_days > 30', 'complaint_out_of_sla_flag = 1', 'repeat_complaint_flag = 1', 'relationship_dissatisfaction_flag = 1')} AS group_alert_complaints
FROM features"""
CTES["f_composite"] = """
SELECT *, CAST(multi_signal_count >= 3 AS INTEGER) AS multi_signal_flag FROM (SELECT *, group_alert_balances + group_alert_recurring
  + group_alert_transfers + group_alert_investments + group_alert_relationship + group_alert_banker + group_alert_complaints AS multi_signal_count FROM f_groups) q"""


def build(final: str, **local: str) -> str:
    """``WITH`` clause of everything ``final`` needs, dependencies first."""
    pool = {**CTES, **local}
    words = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
    done: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for word in dict.fromkeys(words.findall(text)):
            if word in pool and word != me and word not in done and \
                    re.search(rf"(FROM|JOIN|,)\s+{word}\b", text):
                visit(pool[word], word)
                if word not in done:
                    done.append(word)

    visit(final, None)
    head = ",\n".join(f"{name} AS ({pool[name].strip()})" for name in done)
    return f"WITH {head}\n{final.strip()}" if done else final.strip()


def rounded(source: str, exact: list[str], doubles: dict[str, int] | list[str]) -> str:
    """Final projection: exact columns as they are, doubles rounded."""
    digits = doubles if isinstance(doubles, dict) else {c: 6 for c in doubles}
    cols = ", ".join([*exact, *[f"{r(c, d)} AS {c}" for c, d in digits.items()]])
    return f"SELECT {cols} FROM {source}"
