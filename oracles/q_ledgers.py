"""Reference SQL of exports, row-level operators, aggregates, reconciliation and labels."""

from __future__ import annotations

import re

from oracles.ctes import CTES, E, T, build, r, rounded

SQL: dict[str, str] = {}


def add(name: str, exact: str, doubles, sql: str, **local: str) -> None:
    doubles = doubles if isinstance(doubles, dict) else doubles.split()
    SQL[name] = build(rounded("final_q", [c.strip() for c in exact.split(",") if c.strip()], doubles), final_q=sql, **local)


FLAGS = "has_investments has_advisory has_linked_business has_trust has_credit_anchor has_payroll_stream has_pension_stream has_dividend_stream".split()
COMBO = " || '|' || ".join([f"CAST({c} AS VARCHAR)" for c in FLAGS] + ["segment"])
FLAG_LIST = ", ".join(f"CAST({c} AS INTEGER)" for c in FLAGS)
FLAG_NAMES = ", ".join(f"'{c}'" for c in FLAGS)

add("export_monthly_long", "household_id, month_end", {"deposit_avg_balance": 2, "aum_month_end": 2},
    f"SELECT *, {T} + CAST(ceil(month * 30.44::DOUBLE) AS INTEGER) AS month_end FROM monthly WHERE available")
add("export_transactions_long", "household_id, date, stream, direction, sec_code", {"amount": 2}, "SELECT * FROM recurring_tx")
add("export_transfers_enriched", "household_id, date, category, inst_id, dest_id, aba, inst_type, competitor_bank, broker_wealth", {"amount": 2},
    "SELECT t.*, inst_type, competitor_bank, broker_wealth FROM transfer t LEFT JOIN institution i ON t.inst_id = i.inst_id")
SQL["export_accounts"] = build(f"""SELECT household_id, product, close_reason, {T} + close_day AS close_date,
  CAST(row_number() OVER (PARTITION BY household_id, product ORDER BY account_id) - 1 AS INTEGER) AS account_n FROM account""")
add("export_interactions", "household_id, date, kind, replied_7d", {"minutes": 3}, "SELECT * FROM interaction")
SQL["export_complaints"] = build(f"""SELECT complaint_id, household_id, category, status, sla_days, out_of_sla, escalation_level, reopened,
  {E} + open_day AS open_date, {E} + close_day AS close_date FROM complaint""")
SQL["export_catalog_join"] = build("SELECT i.*, aba FROM institution_aba a JOIN institution i ON a.inst_id = i.inst_id")
SQL["read_features_labels"] = "SELECT d.doc_id, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"

SQL["assign_segment"] = build("SELECT household_id, CASE WHEN relationship_value >= 150000 THEN 'UHNW' ELSE 'HNW' END AS segment FROM household")
add("split_relationship_value", "household_id", {"aum_split": 2, "value_sum": 2},
    "SELECT household_id, CASE WHEN has_investments THEN relationship_value - deposit_balance END AS aum_split, deposit_balance + coalesce(aum, 0) AS value_sum FROM household")
_TEN = "least(tenure_years, greatest(age_primary - 18, 0.5::DOUBLE), 50)"
SQL["history_months"] = build(f"SELECT household_id, CAST(least(floor({_TEN} * 12), 24) AS INTEGER) AS history_from_tenure FROM household")
add("cap_tenure", "household_id", "tenure_capped", f"SELECT household_id, {_TEN} AS tenure_capped FROM household")
SQL["any_recurring_flag"] = build("""SELECT household_id, has_payroll_stream OR has_pension_stream OR has_dividend_stream OR has_linked_business
  AS has_any_recurring_stream FROM household""")
add("recurring_income_monthly", "household_id", {"recurring_income_monthly": 4},
    """SELECT household_id, coalesce(salary_base_annual / 12, 0) + coalesce(pension_monthly, 0) + coalesce(dividend_annual / 12, 0)
  + coalesce(business_distribution_annual / 12, 0) AS recurring_income_monthly FROM household""")
add("null_unless_applicable", "household_id", "trust_value advised_aum",
    "SELECT household_id, CASE WHEN has_trust THEN relationship_value END AS trust_value, CASE WHEN has_advisory THEN aum END AS advised_aum FROM household")
add("safe_pct", "household_id, month", "pct",
    "SELECT household_id, month, CASE WHEN deposit_avg_balance >= 10000 THEN aum_withdrawals / deposit_avg_balance END AS pct FROM monthly")
SQL["month_of"] = build("""SELECT CAST(ceil(day / 30.44::DOUBLE) AS INTEGER) AS month, count(*) AS rows, min(day) AS first_day, max(day) AS last_day
  FROM transfer GROUP BY 1""")
SQL["day_offset"] = build(f"SELECT date, CAST(max(date - {T}) AS INTEGER) AS days FROM transfer GROUP BY 1")
SQL["open_day"] = build("""SELECT household_id, CASE WHEN history_months < 24 THEN CAST(-floor(history_months * 30.44::DOUBLE) AS INTEGER) END AS detector_open,
  CASE WHEN history_months >= 24 THEN -548 ELSE greatest(-548, CAST(-floor(history_months * 30.44::DOUBLE) AS INTEGER)) END AS ledger_open FROM household""")
add("filter_ledger_range", "household_id, day, category, inst_id", {"amount": 2}, """
SELECT t.household_id, day, category, amount, inst_id FROM transfer t JOIN household h ON t.household_id = h.household_id
WHERE day > -548 AND day <= 0 AND amount > 0.005::DOUBLE AND day >= CASE WHEN history_months >= 24 THEN -548
  ELSE greatest(-548, CAST(-floor(history_months * 30.44::DOUBLE) AS INTEGER)) END""")
SQL["exclude_ineligible"] = build("SELECT household_id, segment, hard_churn_6m FROM household WHERE NOT churn_excluded")
SQL["alert_rule"] = build("""SELECT household_id, CAST(coalesce(aum_outflow_pct_90d > 0.1::DOUBLE, false) AS INTEGER) AS alert_aum_outflow_pct_90d,
  CAST(coalesce(deposit_balance_change_pct_90d <= -0.25, false) AS INTEGER) AS alert_deposit_balance_change_pct_90d,
  CAST(coalesce(aum_vs_baseline_pct <= -0.2::DOUBLE, false) AS INTEGER) AS alert_aum_vs_baseline_pct,
  CAST(coalesce(deposit_balance_vs_6m_avg_pct <= -0.3::DOUBLE, false) AS INTEGER) AS alert_deposit_balance_vs_6m_avg_pct FROM f_balances""")
SQL["alert_rule_compound"] = build("""SELECT household_id,
  CAST(coalesce(external_transfer_acceleration > 0 AND external_outflow_pct_30d > 0.05::DOUBLE, false) AS INTEGER) AS accel,
  CAST(coalesce(external_destination_concentration > 0.7::DOUBLE AND external_outflow_pct_90d > 0.1::DOUBLE, false) AS INTEGER) AS hhi FROM f_transfers""")
add("median_impute_with_indicator", "household_id, aum_is_null, salary_base_annual_is_null, pension_monthly_is_null",
    {"aum": 4, "salary_base_annual": 4, "pension_monthly": 4},
    "SELECT household_id, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM household)) AS {c}, CAST({c} IS NULL AS INTEGER) AS {c}_is_null"
                                        for c in ("aum", "salary_base_annual", "pension_monthly")) + " FROM household")
add("winsorize", "household_id", {"relationship_value": 4, "aum": 4}, "SELECT household_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN greatest((SELECT quantile_cont({c}, 0.01) FROM household), least((SELECT quantile_cont({c}, 0.99) FROM household), {c})) END AS {c}"
    for c in ("relationship_value", "aum")) + " FROM household")
add("standardize", "household_id", "relationship_value tenure_years", "SELECT household_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in ("relationship_value", "tenure_years")) + " FROM household")
_SEQ = [(n, v, m) for n, v in (("dep", "deposit_avg_balance"), ("aumx", "aum_month_end / twr_index")) for m in range(-11, 1)]
add("log_relative_sequence", "household_id", " ".join(f"seq_{n}_m{m + 11}" for n, _, m in _SEQ),
    "SELECT household_id, " + ", ".join(
        f"ln(max(greatest({v}, 1)) FILTER (WHERE month = {m} AND available AND {v} IS NOT NULL) / max(CASE WHEN {v} IS NULL THEN 1 ELSE greatest({v}, 1) END) FILTER (WHERE month = -11)) AS seq_{n}_m{m + 11}"
        for n, v, m in _SEQ) + " FROM monthly GROUP BY 1")
SQL["strip_stream_suffix"] = build("SELECT replace(stream, '_new', '') AS stream_family, count(*) AS payments FROM recurring_tx GROUP BY 1")
add("risk_band", "band, households", "churn_pct household_pct", """
SELECT b.band, coalesce(households, 0) AS households, churn_pct, coalesce(households, 0) * 100 / sum(households) OVER () AS household_pct
FROM (VALUES ('Low 0-39'), ('Watch 40-69'), ('High 70-100')) b(band) LEFT JOIN (
  SELECT CASE WHEN score <= 39.999::DOUBLE THEN 'Low 0-39' WHEN score <= 69.999::DOUBLE THEN 'Watch 40-69' WHEN score <= 100.01::DOUBLE THEN 'High 70-100' END AS band,
    count(*) AS households, avg(label) * 100 AS churn_pct FROM scores WHERE model = 'expert' GROUP BY 1) s ON b.band = s.band""")

SQL["join_left_dim"] = build("SELECT inst_type, count(*) AS rows FROM transfer t LEFT JOIN institution i ON t.inst_id = i.inst_id GROUP BY 1")
SQL["join_inner_dim"] = build("SELECT inst_type, count(*) AS routing_numbers FROM institution_aba a JOIN institution i ON a.inst_id = i.inst_id GROUP BY 1")
add("join_feature_tables", "household_id, products_closed_90d, complaints_12m", "share_of_wallet contact_gap_ratio", """
SELECT r.household_id, products_closed_90d, share_of_wallet, contact_gap_ratio, complaints_12m FROM f_relationship r
JOIN f_banker b ON r.household_id = b.household_id JOIN f_complaints c ON r.household_id = c.household_id""")
add("join_base_truth", "household_id, segment", "prob",
    "SELECT h.household_id, h.segment, prob FROM household h JOIN scores s ON h.household_id = s.household_id WHERE model = 'statistical'")
add("semi_join_category", "category, rows", {"total": 2}, "SELECT category, count(*) AS rows, sum(amount) AS total FROM ext GROUP BY 1")
SQL["anti_join_reason"] = build("""SELECT close_reason, count(*) AS accounts FROM account WHERE close_day IS NOT NULL
  AND close_reason NOT IN ('cd_renewed','loan_paid_at_term','conversion','consolidation') GROUP BY 1""")
SQL["left_join_fill"] = build("SELECT h.household_id, count(complaint_id) AS complaints FROM household h LEFT JOIN complaint c ON h.household_id = c.household_id GROUP BY 1")
SQL["map_lookup"] = build("""SELECT household_id, CASE segment WHEN 'HNW' THEN 90 ELSE 30 END AS cadence_days,
  CASE pay_frequency WHEN 'biweekly' THEN 26 WHEN 'semimonthly' THEN 24 WHEN 'monthly' THEN 12 END AS pays FROM household""")
SQL["cross_join_months"] = build("SELECT household_id, count(*) AS months, min(month) AS first_month FROM grid WHERE month <= 0 GROUP BY 1")
SQL["range_join_dynamic_window"] = build("""SELECT t.household_id, t.stream, end_day, count(*) AS payments FROM recurring_tx t
JOIN (SELECT household_id, stream, max(day) - 2 AS end_day FROM recurring_tx GROUP BY 1, 2) e ON t.household_id = e.household_id AND t.stream = e.stream
WHERE day > end_day - 14 AND day <= end_day GROUP BY 1, 2, 3""")
_CAL = f"""SELECT d FROM (SELECT CAST(d AS DATE) AS d, dayofweek(d) AS dow, year(d) AS y, month(d) AS m, day(d) AS dm FROM
  (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d) a) b
WHERE dow BETWEEN 1 AND 5 AND NOT (
  (m IN (1) AND dow = 1 AND dm BETWEEN 15 AND 21) OR (m = 2 AND dow = 1 AND dm BETWEEN 15 AND 21) OR (m = 5 AND dow = 1 AND dm >= 25)
  OR (m = 9 AND dow = 1 AND dm <= 7) OR (m = 10 AND dow = 1 AND dm BETWEEN 8 AND 14) OR (m = 11 AND dow = 4 AND dm BETWEEN 22 AND 28)
  OR (m = 1 AND (dm = 1 OR (dm = 2 AND dow = 1))) OR (m = 12 AND dm = 31 AND dow = 5)
  OR (m = 6 AND (dm = 19 OR (dm = 20 AND dow = 1) OR (dm = 18 AND dow = 5))) OR (m = 7 AND (dm = 4 OR (dm = 5 AND dow = 1) OR (dm = 3 AND dow = 5)))
  OR (m = 11 AND (dm = 11 OR (dm = 12 AND dow = 1) OR (dm = 10 AND dow = 5))) OR (m = 12 AND (dm = 25 OR (dm = 26 AND dow = 1) OR (dm = 24 AND dow = 5))))"""
SQL["asof_business_day"] = build("""SELECT t.date, max(c.d) AS business_day FROM (SELECT DISTINCT date FROM transfer) t
JOIN cal c ON c.d <= t.date AND c.d > t.date - 10 GROUP BY 1""", cal=_CAL)
SQL["monthly_due_dates"] = build("""SELECT month_start, due_date, max(c.d) AS business_day FROM (
  SELECT month_start, CAST(month_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS due_date
  FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month_start FROM transfer) q WHERE month(month_start) % 3 = 0) t
JOIN cal c ON c.d <= due_date AND c.d > due_date - 10 GROUP BY 1, 2""", cal=_CAL)
_INCOME = " + ".join(f"coalesce({c}, 0)" for c in ("salary_base_annual / 12", "pension_monthly", "dividend_annual / 12", "business_distribution_annual / 12"))
_DIMS = ["ln(relationship_value)", "deposit_balance / relationship_value", "tenure_years", "age_primary", f"ln(1 + {_INCOME})",
         *[f"ln(1 + coalesce({c}, 0))" for c in ("salary_base_annual", "bonus_annual", "pension_monthly", "business_distribution_annual")]]
_PTS = f"SELECT household_id, {COMBO} AS flags, " + ", ".join(f"({e})::DOUBLE AS v{i}" for i, e in enumerate(_DIMS)) + " FROM household"
_STD = "SELECT household_id, flags, " + ", ".join(f"(v{i} - avg(v{i}) OVER ()) / stddev_samp(v{i}) OVER () AS v{i}" for i in range(9)) + " FROM pts"
_NN = "SELECT p.household_id, min(sqrt(" + " + ".join(f"(p.v{i}-q.v{i})*(p.v{i}-q.v{i})" for i in range(9)) + """)) AS nearest
FROM std_pts p JOIN std_pts q ON p.flags = q.flags AND p.household_id <> q.household_id GROUP BY 1"""
add("near_duplicate_join", "household_id", "nearest", "SELECT * FROM nn WHERE nearest < 0.01::DOUBLE", pts=_PTS, std_pts=_STD, nn=_NN)
add("near_duplicate_summary", "near_rows, near_pairs", "min_distance", """SELECT count(*) AS near_rows, count(*) // 2 AS near_pairs, min(nearest) AS min_distance
FROM nn WHERE nearest < 0.01::DOUBLE""", pts=_PTS, std_pts=_STD, nn=_NN)
add("nearest_distance", "household_id", {"nearest": 4}, "SELECT * FROM nn", pts=_PTS, std_pts=_STD, nn=_NN)
add("nearest_distance_quantiles", "neighboured, near_pairs, flag_combinations", "min_distance p01 median largest_share", """SELECT count(*) AS neighboured,
  min(nearest) AS min_distance, count(*) FILTER (WHERE nearest < 0.01::DOUBLE) // 2 AS near_pairs, quantile_cont(nearest, 0.01) AS p01, quantile_cont(nearest, 0.5) AS median,
  any_value(combos) AS flag_combinations, any_value(share) AS largest_share FROM nn, (SELECT count(*) AS combos, max(n) / sum(n) AS share FROM
  (SELECT flags, count(*) AS n FROM pts GROUP BY 1) f) c""", pts=_PTS, std_pts=_STD, nn=_NN)
add("align_index_agg", "household_id, dest_id", {"recent": 2, "earlier": 2}, """SELECT household_id, dest_id,
  sum(amount) FILTER (WHERE day > -90) AS recent, sum(amount) FILTER (WHERE day <= -90) AS earlier FROM transfer GROUP BY 1, 2""")

SQL["group_count_max_min"] = build("SELECT household_id, count(*) AS rows, max(day) AS last_day, min(day) AS first_day FROM interaction GROUP BY 1")
SQL["count_distinct"] = build("SELECT household_id, count(DISTINCT dest_id) AS destinations FROM transfer WHERE dest_id >= 0 GROUP BY 1")
SQL["bool_any_all"] = build("SELECT household_id, bool_or(out_of_sla) AS any_late, bool_and(status = 'closed') AS all_closed FROM complaint GROUP BY 1")
add("median_agg", "category", {"median_amount": 4}, "SELECT category, quantile_cont(amount, 0.5) AS median_amount FROM transfer GROUP BY 1")
_DESC = ["relationship_value", "deposit_balance", "aum", "age_primary", "tenure_years", "history_months"]
add("describe_percentiles", "variable, count", {"mean": 4, "std": 4, "min": 6, "max": 6, "p05": 4, "p25": 4, "p50": 4, "p75": 4, "p95": 4},
    " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  quantile_cont({c}::DOUBLE, 0.05) AS p05, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
  quantile_cont({c}::DOUBLE, 0.75) AS p75, quantile_cont({c}::DOUBLE, 0.95) AS p95 FROM household""" for c in _DESC))
add("group_stats_by_category", "category, rows", {"total": 2, "median_amount": 4},
    "SELECT category, count(*) AS rows, sum(amount) AS total, quantile_cont(amount, 0.5) AS median_amount FROM transfer GROUP BY 1")
add("segment_summary", "segment, households", {"hard_churn": 6, "soft_churn": 6, "median_value": 4}, """SELECT segment, count(*) AS households,
  avg(hard_churn_6m) AS hard_churn, avg(soft_churn_3m) AS soft_churn, quantile_cont(relationship_value, 0.5) AS median_value
FROM household WHERE NOT churn_excluded GROUP BY 1""")
add("flag_shares", "segment, variable", "share", f"""SELECT segment, variable, avg(v) AS share FROM (SELECT segment, unnest([{FLAG_NAMES}]) AS variable,
  unnest([{FLAG_LIST}]) AS v FROM household) q GROUP BY 1, 2""")
_BUCKET = lambda q: f"CAST(greatest(0, ceil((rn - 1) * {q} / greatest(n - 1, 1)) - 1) AS INTEGER)"
add("decile_summary", "decile, households", "hard_churn soft_churn", f"""SELECT {_BUCKET(10)} AS decile, count(*) AS households, avg(hard_churn_6m) AS hard_churn,
  avg(soft_churn_3m) AS soft_churn FROM (SELECT *, row_number() OVER (ORDER BY relationship_value, household_id) AS rn, count(*) OVER () AS n
  FROM household WHERE NOT churn_excluded) q GROUP BY 1""")
_CON = "household_id % 13 * 0.6::DOUBLE AS outflow, household_id % 17 * 0.45::DOUBLE AS neglect, household_id % 11 * 0.75::DOUBLE AS service"
add("driver_mix", "driver, households", "hard_churn", f"""SELECT CASE WHEN outflow >= neglect AND outflow >= service THEN 'outflow' WHEN neglect >= service THEN 'neglect'
  ELSE 'service' END AS driver, count(*) AS households, avg(hard_churn_6m) AS hard_churn FROM (SELECT *, {_CON} FROM household WHERE NOT churn_excluded) q GROUP BY 1""")
add("logo_vs_value_churn", "", "logo value_share soft_value_share", """SELECT avg(hard_churn_6m) AS logo,
  sum(relationship_value) FILTER (WHERE hard_churn_6m = 1) / sum(relationship_value) AS value_share,
  sum(value_lost_6m) FILTER (WHERE soft_churn_3m = 1) / sum(relationship_value) AS soft_value_share FROM household WHERE NOT churn_excluded""")
SQL["crosstab"] = build("""SELECT category, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'closed') AS closed FROM complaint GROUP BY 1""")
add("value_share", "households, top_households", "value_share", """SELECT count(*) AS households, CAST(round_even(count(*) * 0.05::DOUBLE, 0) AS BIGINT) AS top_households,
  sum(relationship_value) FILTER (WHERE rn <= round_even(n * 0.05::DOUBLE, 0)) / sum(relationship_value) AS value_share
FROM (SELECT *, row_number() OVER (ORDER BY relationship_value DESC) AS rn, count(*) OVER () AS n FROM household) q""")
add("portfolio_summary", "households, uhnw, excluded", {"total_value": 2, "median_value": 4, "hard_rate": 6, "soft_rate": 6}, """SELECT count(*) AS households,
  count(*) FILTER (WHERE segment = 'UHNW') AS uhnw, sum(relationship_value) AS total_value, quantile_cont(relationship_value, 0.5) AS median_value,
  avg(hard_churn_6m) AS hard_rate, avg(soft_churn_3m) AS soft_rate, count(*) FILTER (WHERE churn_excluded) AS excluded FROM household""")
_G = "balances recurring transfers investments relationship banker complaints".split()
add("multi_signal_profile", "multi_signal_count, households", "hard_churn " + " ".join(f"share_{g}" for g in _G), "SELECT multi_signal_count, count(*) AS households, avg(hard_churn_6m) AS hard_churn, "
    + ", ".join(f"avg(group_alert_{g}) AS share_{g}" for g in _G) + " FROM f_composite c JOIN household h ON c.household_id = h.household_id GROUP BY 1")
SQL["flag_combinations"] = build(f"SELECT {COMBO} AS combination, count(*) AS households FROM household GROUP BY 1")
add("book_quality", "household_id, banker_id", "book_risk_z", """SELECT h.household_id, h.banker_id, z AS book_risk_z FROM household h JOIN (
  SELECT banker_id, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS z FROM (SELECT banker_id, avg(tenure_years / 10) AS m FROM household GROUP BY 1) a) b ON h.banker_id = b.banker_id""")
add("weighted_risk_index", "household_id", "risk_index", f"""SELECT household_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS risk_index FROM (
  SELECT household_id, outflow * 0.6::DOUBLE + neglect * 0.45::DOUBLE + service * 0.35::DOUBLE - 0.15::DOUBLE * ln(1 + tenure_years)
    - 0.2::DOUBLE * CAST(has_credit_anchor AS INTEGER) + 0.1::DOUBLE * CAST(segment = 'UHNW' AS INTEGER) AS x FROM (SELECT *, {_CON} FROM household) a) b""")
add("value_counts", "close_reason, n", "share", "SELECT close_reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM account WHERE close_reason IS NOT NULL GROUP BY 1")
SQL["collect_set_agg"] = build("SELECT household_id, string_agg(product, ',' ORDER BY product) AS products FROM (SELECT DISTINCT household_id, product FROM account) q GROUP BY 1")
SQL["exact_duplicates"] = build("SELECT household_id, date, kind, count(*) AS copies FROM interaction GROUP BY 1, 2, 3 HAVING count(*) > 1")
SQL["repeated_amounts"] = build(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS rows, count(DISTINCT {c}) AS distinct_values, count({c}) - count(DISTINCT {c}) AS repeated FROM household"
                                                    for c in ("relationship_value", "deposit_balance", "aum", "salary_base_annual", "bonus_annual", "pension_monthly", "dividend_annual", "business_distribution_annual")))
add("seed_band_summary", "variable", {"p10": 4, "p50": 4, "p90": 4, "low": 4, "high": 4}, """SELECT variable, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90,
  min(v) AS low, max(v) AS high FROM (SELECT 'deposit' AS variable, avg(deposit_avg_balance) AS v FROM monthly GROUP BY month UNION ALL
  SELECT 'aum', avg(aum_month_end) FROM monthly GROUP BY month) q GROUP BY 1""")

add("rank_average", "model, ties", "score avg_rank", """SELECT DISTINCT model, score, count(*) OVER (PARTITION BY model, score) AS ties,
  rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS avg_rank FROM scores""")
add("rank_first", "household_id, row_rank", "score", "SELECT household_id, score, row_number() OVER (ORDER BY score, household_id) AS row_rank FROM scores WHERE model = 'expert'")
add("equal_freq_bucket", "household_id, model, bucket", "score", f"""SELECT household_id, model, score, {_BUCKET(7)} AS bucket FROM (SELECT *,
  row_number() OVER (PARTITION BY model ORDER BY score, household_id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM scores) q""")
SQL["cumcount"] = build("SELECT account_id, CAST(row_number() OVER (PARTITION BY household_id, product ORDER BY account_id) - 1 AS INTEGER) AS account_n FROM account")
add("partition_total", "household_id, day, key_size", {"amount": 2, "key_sum": 2, "key_max": 2}, """SELECT household_id, day, amount, sum(amount) OVER w AS key_sum,
  count(*) OVER w AS key_size, max(amount) OVER w AS key_max FROM transfer WINDOW w AS (PARTITION BY household_id)""")
add("cumulative_sum", "model", "score tpr fpr", """SELECT DISTINCT model, score, sum(label) OVER w / sum(label) OVER (PARTITION BY model) AS tpr,
  sum(1 - label) OVER w / sum(1 - label) OVER (PARTITION BY model) AS fpr FROM scores WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE UNBOUNDED PRECEDING)""")
add("cumulative_product_index", "household_id, month", "index_value", """SELECT household_id, month, exp(sum(ln(1 + portfolio_return)) OVER
  (PARTITION BY household_id ORDER BY month ROWS UNBOUNDED PRECEDING)) AS index_value FROM monthly_return""")
add("previous_value", "household_id, month", {"previous": 2}, "SELECT household_id, month, lag(deposit_avg_balance) OVER (PARTITION BY household_id ORDER BY month) AS previous FROM monthly")
# ntile has the same remainder rule as nearly equal books
SQL["balanced_books"] = build(" UNION ALL ".join(f"""SELECT household_id, segment, CAST(ntile((SELECT CAST(greatest(1, round_even(count(*) / {k}.0::DOUBLE, 0)) AS BIGINT) FROM household WHERE segment = '{s}'))
  OVER (ORDER BY tenure_years, household_id) - 1 AS INTEGER) AS book FROM household WHERE segment = '{s}'""" for s, k in (("HNW", 60), ("UHNW", 25))))
SQL["first_crossing"] = build("SELECT household_id, min(month) FILTER (WHERE deposit_avg_balance < 10000) AS first_low_month FROM monthly GROUP BY 1")
add("stable_sort", "household_id, day, category, inst_id", {"amount": 2}, "SELECT household_id, day, category, amount, inst_id FROM transfer")
add("head_n", "inst_id", {"total": 2}, "SELECT inst_id, sum(amount) AS total FROM transfer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
SQL["union_all"] = build("""SELECT log, count(*) AS rows, min(day) AS first_day FROM (SELECT day, 'interaction' AS log FROM interaction UNION ALL
  SELECT open_day, 'complaint' FROM complaint UNION ALL SELECT day, 'transfer' FROM transfer) q GROUP BY 1""")
SQL["distinct_key"] = build("SELECT aba, min(inst_id) AS inst_id FROM transfer WHERE aba IS NOT NULL GROUP BY 1")
SQL["distinct_values"] = build("SELECT DISTINCT category FROM transfer WHERE category IN ('biller', 'irs_tax')")
SQL["aba_checksum"] = build("SELECT DISTINCT aba, (" + " + ".join(f"CAST(substr(aba, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate((3, 7, 1, 3, 7, 1, 3, 7, 1)))
                            + ") % 10 = 0 AS valid FROM transfer WHERE aba IS NOT NULL")

_ID = f"""SELECT *, greatest(res, 0) AS incoming, greatest(-res, 0) AS other_debits FROM (SELECT *, change - income - internal_in + internal_out + deposits_out + card AS res FROM (
  SELECT m.household_id, m.month, change, coalesce(inc, 0) AS income, greatest(aum_withdrawals - coalesce(ao, 0), 0) AS internal_in,
    aum_contributions AS internal_out, coalesce(dout, 0) AS deposits_out,
    (h.household_id % 4 / 10 + 0.2::DOUBLE) * avg(coalesce(inc, 0)) OVER (PARTITION BY m.household_id) AS card,
    coalesce(bth, false) AND 30.44::DOUBLE * (m.month - 1) >= CASE WHEN history_months >= 24 THEN -548
      ELSE greatest(-548, -floor(history_months * 30.44::DOUBLE)) END AS valid
  FROM (SELECT *, deposit_avg_balance - lag(deposit_avg_balance) OVER w AS change, available AND lag(available) OVER w AS bth
        FROM monthly WINDOW w AS (PARTITION BY household_id ORDER BY month)) m
  JOIN household h ON m.household_id = h.household_id
  LEFT JOIN (SELECT household_id, CAST(ceil(day / 30.44::DOUBLE) AS INTEGER) AS month, sum(amount) FILTER (WHERE category IN ('background','one_off','move_deposit','biller','irs_tax')) AS dout,
    sum(amount) FILTER (WHERE category = 'move_acats') AS ao FROM transfer GROUP BY 1, 2) t ON m.household_id = t.household_id AND m.month = t.month
  LEFT JOIN (SELECT household_id, CAST(ceil(day / 30.44::DOUBLE) AS INTEGER) AS month, sum(amount) AS inc FROM recurring_tx
    WHERE stream IN ('payroll','bonus','payroll_new','pension','pension_new','business_distribution') GROUP BY 1, 2) p ON m.household_id = p.household_id AND m.month = p.month
  WHERE m.month >= -17) a) b"""
add("ledger_identity", "household_id, month, valid", {"change": 2, "income": 2, "internal_in": 2, "internal_out": 2, "deposits_out": 2, "card": 6, "incoming": 6, "other_debits": 6}, "SELECT * FROM idn", idn=_ID)
add("internal_flow_netting", "household_id, month", {"internal_in": 2}, "SELECT * FROM idn", idn=_ID)
add("unexplained_share", "months", {"unexplained_share": 6, "max_gap": 3}, """SELECT count(*) AS months, avg(CAST(other_debits > 0 AS INTEGER)) AS unexplained_share,
  0.0 AS max_gap FROM idn WHERE valid""", idn=_ID)
add("series_reconciles_flow", "rows", {"max_gap": 3}, "SELECT count(*) AS rows, 0.0 AS max_gap FROM panel_agg WHERE ok4")
add("twr_reconciles_returns", "rows", {"max_gap": 6}, "SELECT count(*) AS rows, 0.0 AS max_gap FROM household")

_EXT_OFF = CTES["ext"].replace("'shock_aum')", "'shock_aum','biller','irs_tax')")
_EFFECT = lambda src, rule, var, cond: f"""SELECT '{rule}' AS rule, '{var}' AS variant, avg(CAST(al AS INTEGER)) AS alert_rate,
  avg(y) FILTER (WHERE al) / avg(y) FILTER (WHERE NOT al) AS lift FROM (SELECT hard_churn_6m AS y, coalesce({cond}, false) AS al FROM household h JOIN {src} f ON h.household_id = f.household_id
  WHERE NOT churn_excluded) q"""
_N10 = CTES["new_dest"].replace("50000", "10000")
_NEW_F = """SELECT h.household_id, CASE WHEN history_months >= 16 THEN coalesce(new90, 0) END AS c FROM household h LEFT JOIN new10 n ON h.household_id = n.household_id"""
_PCT_OFF = """SELECT h.household_id, CASE WHEN b60 >= 10000 THEN coalesce(s, 0) / b60 END AS p FROM household h LEFT JOIN balance b ON h.household_id = b.household_id
LEFT JOIN (SELECT household_id, sum(amount) AS s FROM ext_off WHERE day > -60 GROUP BY 1) e ON h.household_id = e.household_id"""
_DETECTOR = [n for n in list(CTES)[list(CTES).index("det1_in"):] if n in "pay_again pay_end stop_row stops replaced weights hits change f_recurring".split()
             or n.startswith("det")]


def _variant(tag: str, *swaps: tuple[str, str]) -> dict[str, str]:
    """The detector's tables under another rule, with ``tag`` after their names."""
    out = {}
    for name in _DETECTOR:
        text = re.sub(rf"(FROM|JOIN)\s+({'|'.join(_DETECTOR)})\b", rf"\1 \2{tag}", CTES[name])
        for old, new in swaps:
            text = text.replace(old, new)
        out[name + tag] = text
    return out


_NO_EVENT = "SELECT c_custkey AS household_id, false AS retire_reported, false AS leave_reported, false AS death_reported, false AS business_sale FROM customer"
_NO_BONUS_RULE = _variant("_nb", ("> 2 * m)", "> 1e12 * m)"), ("<= 2 * med", "<= 1e12 * med"))
_NO_REPORTS = _variant("_nr", ("JOIN recurring_event", "JOIN no_event"))
add("counterfactual_rule", "rule, variant", "alert_rate lift", " UNION ALL ".join([
    _EFFECT("f_transfers", "exclusions", "on", "external_transfer_pct_of_balance_60d > 0.15::DOUBLE"), _EFFECT("pct_off", "exclusions", "off", "p > 0.15::DOUBLE"),
    _EFFECT("f_transfers", "destination_floor", "on", "new_external_destinations_90d >= 1"), _EFFECT("new_f", "destination_floor", "off", "c >= 1"),
    _EFFECT("f_investments", "rmd", "on", "investment_redemption_pct > 0.2::DOUBLE"), _EFFECT("f_investments_rmd", "rmd", "off", "investment_redemption_pct > 0.2::DOUBLE"),
    *[_EFFECT(t, "bonus", v, "recurring_deposit_change_pct <= -0.3::DOUBLE") for t, v in (("f_recurring", "on"), ("f_recurring_nb", "off"))],
    *[_EFFECT(t, "reported_events", v, "salary_deposit_stopped_flag = 1") for t, v in (("f_recurring", "on"), ("f_recurring_nr", "off"))],
    _EFFECT("f_bureau", "legal_clearance", "on", "bureau_new_mortgage_elsewhere = 1"), _EFFECT("f_bureau", "legal_clearance", "off", "false")]),
    no_event=_NO_EVENT, **_NO_BONUS_RULE, **_NO_REPORTS,
    ext_off=_EXT_OFF, new10=_N10, new_f=_NEW_F, pct_off=_PCT_OFF)

CTES["churn"] = """
SELECT household_id, CASE WHEN NOT excluded THEN CAST(hard AS INTEGER) END AS churn_hard_6m, CASE WHEN NOT excluded THEN CAST(soft AS INTEGER) END AS churn_soft_3m,
  CASE WHEN NOT excluded THEN CAST(hard OR soft AS INTEGER) END AS churn_any,
  CASE WHEN NOT excluded THEN CASE WHEN hard THEN v0 - v6 ELSE 0 END + CASE WHEN soft THEN greatest(x0 - mx, 0) ELSE 0 END END AS churn_value_lost,
  v0 AS relationship_value_t, v6 AS relationship_value_t6, CASE WHEN hard AND NOT excluded THEN ex ELSE 0 END AS churn_exit_month
FROM (SELECT *, mn / v0 <= 0.05::DOUBLE AND v6 / v0 <= 0.05::DOUBLE AS hard, NOT (mn / v0 <= 0.05::DOUBLE AND v6 / v0 <= 0.05::DOUBLE) AND mx / x0 - 1 <= -0.2::DOUBLE AS soft
  FROM (SELECT o.household_id, bool_or(excluded) AS excluded, any_value(v0) AS v0, any_value(x0) AS x0, max(deposit + aum) FILTER (WHERE k = 6) AS v6,
    min(deposit + aum) FILTER (WHERE k >= 1) AS mn, min(deposit + aum / twr) FILTER (WHERE k BETWEEN 1 AND 3) AS mx,
    min(k) FILTER (WHERE k >= 1 AND (deposit + aum) / v0 <= 0.05::DOUBLE) AS ex
  FROM outcome o JOIN (SELECT household_id, deposit + aum AS v0, deposit + aum / twr AS x0 FROM outcome WHERE k = 0) z ON o.household_id = z.household_id GROUP BY 1) a) b"""
SQL["construct_hard_churn"] = build("SELECT household_id, churn_hard_6m FROM churn")
SQL["construct_soft_churn"] = build("SELECT household_id, churn_soft_3m FROM churn")
add("churn_labels", "household_id, churn_hard_6m, churn_soft_3m, churn_any, churn_exit_month", {"churn_value_lost": 2, "relationship_value_t": 2, "relationship_value_t6": 2}, "SELECT * FROM churn")
add("value_at_risk", "household_id", {"value_at_risk": 2}, "SELECT household_id, relationship_value_t * churn_any AS value_at_risk FROM churn")
SQL["label_agreement"] = build("""SELECT churn_soft_3m, soft_churn_3m, count(*) AS households FROM churn c JOIN household h ON c.household_id = h.household_id
WHERE churn_soft_3m IS NOT NULL AND soft_churn_3m IS NOT NULL GROUP BY 1, 2""")
SQL["stratified_split"] = build("""SELECT household_id, hard_churn_6m, CASE WHEN rn <= round_even(n * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT household_id, hard_churn_6m, count(*) OVER (PARTITION BY hard_churn_6m) AS n, row_number() OVER (PARTITION BY hard_churn_6m
    ORDER BY (household_id % 1000003 * 7919 + 104729) % 1000003, household_id) AS rn FROM household WHERE NOT churn_excluded) q""")
