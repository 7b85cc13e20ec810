"""Reference SQL of scorecards, weight of evidence and evaluation."""

from __future__ import annotations

from oracles import q_ledgers  # noqa: F401 - registers the churn table
from ebbtide.contract import CALIBRATION_TARGETS, PRIMARY_COLUMNS
from oracles.ctes import CTES, build, rounded

SQL: dict[str, str] = {}


def add(name: str, exact: str, doubles, sql: str, **local: str) -> None:
    doubles = doubles if isinstance(doubles, dict) else doubles.split()
    SQL[name] = build(rounded("final_q", [c.strip() for c in exact.split(",") if c.strip()], doubles), final_q=sql, **local)


_FRAME = {**{c: c for c in PRIMARY_COLUMNS.values() if c != "multi_signal_flag"}, "multi_signal_count": "multi_signal_count",
          "log_relationship_value": "ln(relationship_value)", "tenure_years": "tenure_years", "age_primary": "age_primary",
          "is_uhnw": "CAST(segment = 'UHNW' AS INTEGER)", "has_investments": "CAST(has_investments AS INTEGER)", "has_trust": "CAST(has_trust AS INTEGER)",
          "has_credit_anchor": "CAST(has_credit_anchor AS INTEGER)", "has_linked_business": "CAST(has_linked_business AS INTEGER)"}
CTES["frame"] = "SELECT household_id, segment, hard_churn_6m, soft_churn_3m, relationship_value, external_outflow_pct_30d, external_outflow_pct_90d, " + ", ".join(
    f"(CASE WHEN abs({e}) < 5e-10::DOUBLE THEN 0.0::DOUBLE ELSE round(({e})::DOUBLE, 9) END) AS {c}" for c, e in _FRAME.items()
) + """ FROM household JOIN features USING (household_id) JOIN f_composite USING (household_id) JOIN f_bureau USING (household_id)
WHERE NOT churn_excluded"""


def long_of(columns: dict[str, str]) -> str:
    """Long form of columns of the frame: name to expression."""
    return (f"SELECT household_id AS id, hard_churn_6m AS y, unnest([{', '.join(repr(c) for c in columns)}]) AS variable, "
            f"unnest([{', '.join(f'({e})::DOUBLE' for e in columns.values())}]) AS value FROM frame")


CTES["long_frame"] = long_of({c: c for c in _FRAME})


def bins(prefix: str, source: str) -> None:
    """Mass points, equal-frequency ranks and NULL of a long table, then the WoE table."""
    CTES[f"{prefix}_mark"] = f"""SELECT *, value IS NOT NULL AND count(*) OVER (PARTITION BY variable, value) > 0.05::DOUBLE * count(value) OVER (PARTITION BY variable) AS mass FROM {source}"""
    CTES[f"{prefix}_nq"] = f"SELECT variable, greatest(1, 10 - count(DISTINCT value) FILTER (WHERE mass)) AS nq FROM {prefix}_mark GROUP BY 1"
    CTES[f"{prefix}_bin"] = f"""
SELECT id, variable, y, value, 'q' AS kind, CASE WHEN n >= nq THEN greatest(0, ceil((rn - 1) * nq / greatest(n - 1, 1)) - 1) ELSE 0 END::DOUBLE AS bk
FROM (SELECT m.*, nq, row_number() OVER (PARTITION BY m.variable ORDER BY value, id) AS rn, count(*) OVER (PARTITION BY m.variable) AS n
  FROM {prefix}_mark m JOIN {prefix}_nq k ON m.variable = k.variable WHERE NOT mass AND value IS NOT NULL) q
UNION ALL SELECT id, variable, y, value, 'm', value FROM {prefix}_mark WHERE mass
UNION ALL SELECT id, variable, y, value, 'null', 0 FROM {prefix}_mark WHERE value IS NULL"""
    woe(prefix, f"{prefix}_bin")


def woe(prefix: str, source: str) -> None:
    CTES[f"{prefix}_woe"] = f"""
SELECT *, ln(bad / good) AS woe, (bad - good) * ln(bad / good) AS iv, ev / (ev + nev) AS event_rate FROM (
  SELECT *, (nev + 0.5::DOUBLE) / (sum(nev) OVER (PARTITION BY variable) + 0.5::DOUBLE * count(*) OVER (PARTITION BY variable)) AS good,
    (ev + 0.5::DOUBLE) / (sum(ev) OVER (PARTITION BY variable) + 0.5::DOUBLE * count(*) OVER (PARTITION BY variable)) AS bad,
    CAST(row_number() OVER (PARTITION BY variable ORDER BY kind = 'null', low, high, kind, bk) - 1 AS INTEGER) AS bin_index
  FROM (SELECT variable, kind, bk, min(value) AS low, max(value) AS high, CAST(sum(1 - y) AS BIGINT) AS nev, CAST(sum(y) AS BIGINT) AS ev FROM {source} GROUP BY 1, 2, 3) a) b"""


bins("wq", "long_frame")
_WT = "SELECT variable, bin_index, low, high, nev AS non_events, ev AS events, event_rate, woe, iv FROM {}"
add("woe_table", "variable, bin_index, non_events, events", "low high event_rate woe iv", _WT.format("wq_woe"))
CTES["doc_long"] = "SELECT d.doc_id AS id, 'n_chars' AS variable, n_chars::DOUBLE AS value, toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
bins("wd", "doc_long")
add("woe_document_quality", "variable, bin_index, non_events, events", "low high event_rate woe iv", _WT.format("wd_woe"))
add("information_value", "variable", "iv", "SELECT variable, sum(iv) AS iv FROM wq_woe GROUP BY 1")
_CA = """SELECT variable, (sum(s * r) - sum(r) / sum(n) * sum(s * n)) / nullif(sqrt(sum(r) / sum(n) * (1 - sum(r) / sum(n)) * (sum(s * s * n) - sum(s * n) * sum(s * n) / sum(n))), 0) AS trend_z
FROM (SELECT variable, bin_index::DOUBLE AS s, (ev + nev)::DOUBLE AS n, ev::DOUBLE AS r FROM {} WHERE kind <> 'null') q GROUP BY 1"""
add("cochran_armitage", "variable", "trend_z", _CA.format("wq_woe"))
add("bin_monotonicity", "variable", "monotonicity", """SELECT variable, corr(bin_index, rk) AS monotonicity FROM (SELECT variable, bin_index,
  rank() OVER (PARTITION BY variable ORDER BY event_rate) + (count(*) OVER (PARTITION BY variable, event_rate) - 1) / 2 AS rk FROM wq_woe WHERE kind <> 'null') q GROUP BY 1""")
add("u_shape_check", "variable, u_shaped", "first_rate last_rate middle_rate", """SELECT *, coalesce(first_rate > middle_rate AND last_rate > middle_rate, false) AS u_shaped FROM (
  SELECT variable, max(event_rate) FILTER (WHERE bin_index = 0) AS first_rate, max(event_rate) FILTER (WHERE bin_index = mx) AS last_rate,
    avg(event_rate) FILTER (WHERE bin_index BETWEEN 2 AND mx - 2) AS middle_rate
  FROM (SELECT *, max(bin_index) OVER (PARTITION BY variable) AS mx FROM wq_woe WHERE kind <> 'null') a GROUP BY 1) b""")
CTES["edge_list"] = """SELECT variable, list_distinct(q) AS e0, list_sort(list_distinct(q)) AS edges FROM (SELECT variable,
  quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM wq_mark WHERE NOT mass AND value IS NOT NULL GROUP BY 1) a"""
add("woe_bin_fit", "variable, position", "edge", "SELECT variable, CAST(unnest(range(len(edges))) AS INTEGER) AS position, unnest(edges) AS edge FROM edge_list")
CTES["edge_bin"] = """
SELECT id, m.variable, y, value, 'q' AS kind, CASE WHEN len(edges) > 1 THEN greatest(0, least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2)) ELSE 0 END::DOUBLE AS bk
FROM wq_mark m JOIN edge_list e ON m.variable = e.variable WHERE NOT mass AND value IS NOT NULL
UNION ALL SELECT id, variable, y, value, 'm', value FROM wq_mark WHERE mass
UNION ALL SELECT id, variable, y, value, 'null', 0 FROM wq_mark WHERE value IS NULL"""
woe("we", "edge_bin")
add("woe_encode", "household_id, variable", "woe", """SELECT id AS household_id, b.variable, woe FROM edge_bin b JOIN we_woe w ON b.variable = w.variable AND b.kind = w.kind AND b.bk = w.bk""")
CTES["pts_table"] = """SELECT variable, kind, bk, bin_index, ev + nev AS n_train, 100 * raw / (SELECT sum(top) FROM (SELECT variable, max(woe) - min(woe) AS top FROM we_woe GROUP BY 1) t) AS points
FROM (SELECT *, woe - min(woe) OVER (PARTITION BY variable) AS raw FROM we_woe) q"""
add("points_table", "variable, bin_index, n_train", "points", "SELECT * FROM pts_table")
add("scorecard_score", "household_id", "score", """SELECT id AS household_id, sum(points) AS score FROM edge_bin b JOIN pts_table p ON b.variable = p.variable AND b.kind = p.kind AND b.bk = p.bk GROUP BY 1""")
add("pearson_pair", "", "rho", "SELECT corr(ln(salary_base_annual), ln(relationship_value)) AS rho FROM household WHERE salary_base_annual IS NOT NULL")
CTES["pairs"] = """SELECT a.variable AS left_column, b.variable AS right_column, a.value AS x, b.value AS y FROM long_frame a
JOIN long_frame b ON a.id = b.id AND a.variable < b.variable AND a.value IS NOT NULL AND b.value IS NOT NULL
WHERE a.variable NOT IN (SELECT unnest({c})) AND b.variable NOT IN (SELECT unnest({c}))""".format(c=list(_FRAME)[-8:])
CTES["pair_ranks"] = """SELECT left_column, right_column,
  rank() OVER (PARTITION BY left_column, right_column ORDER BY x) + (count(*) OVER (PARTITION BY left_column, right_column, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY left_column, right_column ORDER BY y) + (count(*) OVER (PARTITION BY left_column, right_column, y) - 1) / 2 AS ry FROM pairs"""
CTES["sp"] = """SELECT left_column, right_column, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho
FROM pair_ranks GROUP BY 1, 2"""
add("spearman_matrix", "left_column, right_column", "rho", "SELECT * FROM sp")
add("sort_by_abs", "left_column, right_column", "rho", "SELECT * FROM sp WHERE abs(rho) >= 0.01::DOUBLE")

add("business_rules", "household_id", "rules_score", """SELECT c.household_id, CAST(coalesce(relationship_dissatisfaction_flag = 1, false) OR complaint_age_days > 30 OR contact_gap_ratio > 2 AS INTEGER)::DOUBLE AS rules_score
FROM f_complaints c JOIN f_banker b ON c.household_id = b.household_id""")
add("expert_scorecard", "household_id", "expert_score", """SELECT household_id, least(100, (CASE WHEN relationship_dissatisfaction_flag = 1 THEN 30 ELSE 0 END
  + CASE WHEN external_transfer_pct_of_balance_60d > 0.15::DOUBLE THEN 25 ELSE 0 END + CASE WHEN recurring_deposit_stopped_flag = 1 OR recurring_deposit_change_pct <= -0.4::DOUBLE THEN 15 ELSE 0 END
  + CASE WHEN investment_redemption_pct > 0.2::DOUBLE OR aum_outflow_pct_90d > 0.1::DOUBLE THEN 10 ELSE 0 END + CASE WHEN complaint_age_days > 30 THEN 10 ELSE 0 END
  + CASE WHEN contact_gap_ratio > 2 THEN 10 ELSE 0 END + CASE WHEN banker_change_6m_flag = 1 THEN 10 ELSE 0 END))::DOUBLE AS expert_score FROM features""")

CTES["auc_m"] = """SELECT model, (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM (SELECT *,
  rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS rk FROM scores) q GROUP BY 1"""
CTES["ks_m"] = """SELECT model, max(abs(tp - fp)) AS ks FROM (SELECT model, sum(label) OVER w / sum(label) OVER (PARTITION BY model) AS tp,
  sum(1 - label) OVER w / sum(1 - label) OVER (PARTITION BY model) AS fp FROM scores WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE UNBOUNDED PRECEDING)) q GROUP BY 1"""
_TOP = lambda f: f"""SELECT model, {f}::DOUBLE AS fraction, CAST(max(k) AS BIGINT) AS size, sum(label) FILTER (WHERE rn <= k) / max(k) AS precision,
  sum(label) FILTER (WHERE rn <= k) / sum(label) AS recall, (sum(label) FILTER (WHERE rn <= k) / max(k)) / avg(label) AS lift,
  sum(value * label) FILTER (WHERE rn <= k) / sum(value * label) AS value_captured
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, household_id) AS rn, round_even(count(*) OVER (PARTITION BY model) * {f}::DOUBLE, 0) AS k FROM scores) q GROUP BY 1"""
CTES["top5"], CTES["top10"] = _TOP(0.05), _TOP("0.10")
CTES["prob_m"] = "SELECT model, avg(prob) AS mean_prob, avg(label) AS observed, avg((prob - label) * (prob - label)) AS brier FROM scores WHERE prob IS NOT NULL GROUP BY 1"
add("auc", "model", "auc", "SELECT * FROM auc_m")
add("gini", "model", "gini", "SELECT model, 2 * auc - 1 AS gini FROM auc_m")
add("auc_by_segment", "model, segment", "auc", """SELECT model, segment, (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0) AS auc FROM (SELECT *,
  rank() OVER (PARTITION BY model, segment ORDER BY score) + (count(*) OVER (PARTITION BY model, segment, score) - 1) / 2 AS rk FROM scores) q GROUP BY 1, 2""")
add("ks_stat", "model", "ks", "SELECT * FROM ks_m")
add("brier", "model", "brier", "SELECT * FROM prob_m")
add("mean_prob_vs_observed", "model", "mean_prob observed", "SELECT * FROM prob_m")
_TOPC = "fraction precision recall lift value_captured"
add("top_k_list", "model, size", _TOPC, "SELECT * FROM top10")
add("top_k_metrics", "model, size", _TOPC, "SELECT * FROM top5 UNION ALL SELECT * FROM top10")
add("calibration_deciles", "model, decile, n", "mean_prob observed", """SELECT model, CAST(greatest(0, ceil((rn - 1) * 10 / greatest(c - 1, 1)) - 1) AS INTEGER) + 1 AS decile, avg(prob) AS mean_prob, avg(label) AS observed, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob, household_id) AS rn, count(*) OVER (PARTITION BY model) AS c FROM scores WHERE prob IS NOT NULL) q GROUP BY 1, 2""")
_MC = [f"{c}_top_{k}" for k in (5, 10) for c in ("precision", "recall", "lift", "value_captured")]
add("model_comparison", "model", "auc gini ks mean_prob observed brier " + " ".join(_MC), """SELECT a.model, auc, 2 * auc - 1 AS gini, ks, mean_prob, observed, brier, """ + ", ".join(
    f"t{k}.{c} AS {c}_top_{k}" for k in (5, 10) for c in ("precision", "recall", "lift", "value_captured")) +
    " FROM auc_m a JOIN ks_m k ON a.model = k.model JOIN top5 t5 ON a.model = t5.model JOIN top10 t10 ON a.model = t10.model LEFT JOIN prob_m p ON a.model = p.model")
add("lift_alert", "", "rate_in rate_out lift", """SELECT *, rate_in / rate_out AS lift FROM (SELECT avg(hard_churn_6m) FILTER (WHERE aum_outflow_pct_90d > 0.1::DOUBLE) AS rate_in,
  avg(hard_churn_6m) FILTER (WHERE aum_outflow_pct_90d <= 0.1::DOUBLE) AS rate_out FROM frame) q""")

_NAMED = {"accel": "external_transfer_acceleration > 0 AND external_outflow_pct_30d > 0.05::DOUBLE",
          "hhi": "external_destination_concentration > 0.7::DOUBLE AND external_outflow_pct_90d > 0.10::DOUBLE"}
_ALERT = {v: f"coalesce({_NAMED.get(t[0]) or f'{v} {t[0]}::DOUBLE'}, false)" for v, t in CALIBRATION_TARGETS.items()}
CTES["calib_rows"] = ("SELECT household_id AS id, hard_churn_6m AS y, unnest([" + ", ".join(repr(v) for v in _ALERT) + "]) AS variable, unnest(["
    + ", ".join(f"{v}::DOUBLE" for v in _ALERT) + "]) AS value, unnest([" + ", ".join(_ALERT.values()) + "]) AS alert, unnest(["
    + ", ".join(str(t[5] == "all").lower() for t in CALIBRATION_TARGETS.values()) + "]) AS keeps, unnest(["
    + ", ".join("-1" if t[0].startswith("<") else "1" for t in CALIBRATION_TARGETS.values()) + "]) AS dir FROM frame")
CTES["long_calib"] = "SELECT id, y, variable, value FROM calib_rows WHERE value IS NOT NULL OR keeps"
bins("wk", "long_calib")
CTES["trend"] = _CA.format("wk_woe")
CTES["calib"] = """SELECT a.variable, alert_rate, iv, i / nullif(o, 0) AS lift, trend_z * dir AS trend_z, null_pct FROM (
  SELECT variable, max(dir) AS dir, avg(CAST(alert AS INTEGER)) FILTER (WHERE value IS NOT NULL) AS alert_rate,
    avg(y) FILTER (WHERE value IS NOT NULL AND alert) AS i, avg(y) FILTER (WHERE value IS NOT NULL AND NOT alert) AS o,
    100 * avg(CAST(value IS NULL AS INTEGER)) AS null_pct FROM calib_rows GROUP BY 1) a
JOIN (SELECT variable, sum(iv) AS iv FROM wk_woe GROUP BY 1) b ON a.variable = b.variable LEFT JOIN trend c ON a.variable = c.variable"""
add("variable_calibration", "variable", "alert_rate iv lift trend_z null_pct", "SELECT * FROM calib")
_IDS = {c.replace("multi_signal_flag", "multi_signal_count"): i for i, c in PRIMARY_COLUMNS.items()}
add("final_variable_report", "variable, variable_id", "alert_rate iv lift trend_z null_pct rate_low rate_high iv_low iv_high", "SELECT c.*, t.* EXCLUDE (variable) FROM calib c JOIN targets t ON c.variable = t.variable",
    targets=" UNION ALL ".join(f"SELECT '{v}' AS variable, {_IDS[v]} AS variable_id, {a}::DOUBLE AS rate_low, {b}::DOUBLE AS rate_high, {c}::DOUBLE AS iv_low, {d}::DOUBLE AS iv_high"
                               for v, (_, a, b, c, d, _) in CALIBRATION_TARGETS.items()))
add("calibration_gate", "variable, check_name, ok", "value", " UNION ALL ".join(
    f"SELECT c.variable, '{n}' AS check_name, {n2} AS value, coalesce({cond}, false) AS ok FROM calib c JOIN bands b ON c.variable = b.variable" for n, n2, cond in (
        ("alert_rate", "alert_rate", "alert_rate BETWEEN rl AND rh"), ("iv", "iv", "iv BETWEEN il - 0.03::DOUBLE AND ih + 0.03::DOUBLE"),
        ("lift", "lift", "lift >= 1.5"), ("trend", "trend_z", "trend_z > 2.3263478740408408::DOUBLE"))),
    bands=" UNION ALL ".join(f"SELECT '{v}' AS variable, {a}::DOUBLE AS rl, {b}::DOUBLE AS rh, {c}::DOUBLE AS il, {d}::DOUBLE AS ih"
                             for v, (_, a, b, c, d, _) in CALIBRATION_TARGETS.items()))
