"""Reference SQL of the statistical tests."""

from __future__ import annotations

import math

from oracles.ctes import build, rounded

SQL: dict[str, str] = {}


def add(name: str, exact: str, doubles, sql: str, **local: str) -> None:
    doubles = doubles if isinstance(doubles, dict) else doubles.split()
    SQL[name] = build(rounded("final_q", [c.strip() for c in exact.split(",") if c.strip()], doubles), final_q=sql, **local)


def long(cols, where="true", table="household"):
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL AND {where.format(c=c)}" for c in cols)


_PIT = """SELECT 'tenure' AS variable, tenure_years / 30 AS u FROM household UNION ALL SELECT 'value', 1 - exp(-relationship_value / 150000) FROM household"""
_RN = "SELECT variable, u, row_number() OVER (PARTITION BY variable ORDER BY u) AS i, count(*) OVER (PARTITION BY variable) AS n FROM pit"
add("ks_uniform", "variable, n", "statistic", "SELECT variable, max(greatest(i / n - u, u - (i - 1) / n)) AS statistic, count(*) AS n FROM rn GROUP BY 1", pit=_PIT, rn=_RN)
add("cramer_von_mises", "variable, n", "statistic", "SELECT variable, sum((u - (2 * i - 1) / (2 * n)) * (u - (2 * i - 1) / (2 * n))) + 1 / (12 * count(*)) AS statistic, count(*) AS n FROM rn GROUP BY 1", pit=_PIT, rn=_RN)
add("chi_square_gof", "dof, n", "statistic", """SELECT sum((o - s * t) * (o - s * t) / (s * t)) AS statistic, 2 AS dof, CAST(max(t) AS BIGINT) AS n FROM (SELECT o, s, sum(o) OVER () AS t FROM (
  SELECT pay_frequency AS f, count(*) AS o FROM household WHERE pay_frequency IS NOT NULL GROUP BY 1) a JOIN (VALUES ('biweekly', 0.4::DOUBLE), ('semimonthly', 0.45::DOUBLE), ('monthly', 0.15::DOUBLE)) v(f, s) ON a.f = v.f) q""")
add("chi_square_independence", "dof", "statistic", """SELECT sum((coalesce(n, 0) - na * nb / t) * (coalesce(n, 0) - na * nb / t) / (na * nb / t)) AS statistic,
  CAST((count(DISTINCT a.segment) - 1) * (count(DISTINCT b.y) - 1) AS INTEGER) AS dof FROM (SELECT segment, count(*) AS na FROM el GROUP BY 1) a
  JOIN (SELECT soft_churn_3m AS y, count(*) AS nb FROM el GROUP BY 1) b ON true JOIN (SELECT count(*) AS t FROM el) tt ON true
  LEFT JOIN (SELECT segment, soft_churn_3m AS y, count(*) AS n FROM el GROUP BY 1, 2) c ON a.segment = c.segment AND b.y = c.y""", el="SELECT * FROM household WHERE NOT churn_excluded")
_PR = "SELECT label, prob FROM scores WHERE model = 'statistical'"
add("hosmer_lemeshow", "dof", "statistic", """SELECT sum((o - e) * (o - e) / (e * (1 - e / n))) AS statistic, CAST(count(*) - 1 AS INTEGER) AS dof FROM (
  SELECT len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda v: v < prob)) AS g, sum(label) AS o, sum(prob) AS e, count(*) AS n FROM pr, eq GROUP BY 1) q""",
    pr=_PR, eq="SELECT list_sort(list_distinct(quantile_cont(prob, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM pr")
add("poisson_binomial_z", "observed", "expected statistic", "SELECT CAST(sum(label) AS BIGINT) AS observed, sum(prob) AS expected, (sum(label) - sum(prob)) / sqrt(sum(prob * (1 - prob))) AS statistic FROM pr", pr=_PR)
add("fisher_z_corr", "", "r statistic", "SELECT corr(relationship_value, tenure_years) AS r, (atanh(corr(relationship_value, tenure_years)) - atanh(0.1::DOUBLE)) * sqrt(count(*) - 3) AS statistic FROM household")
_MON = ["relationship_value", "aum", "pension_monthly", "tenure_years"]
_MOM = """SELECT variable, count(*) AS n, avg(x) AS m, avg(x) AS mean, stddev_samp(x) AS sd, avg((x - mu) * (x - mu) * (x - mu)) / pow(avg((x - mu) * (x - mu)), 1.5) AS skew,
  avg((x - mu) * (x - mu) * (x - mu) * (x - mu)) / pow(avg((x - mu) * (x - mu)), 2) - 3 AS excess FROM (SELECT *, avg(x) OVER (PARTITION BY variable) AS mu FROM {}) q GROUP BY 1"""
_KZ = """SELECT variable, n, excess, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS kurtosis_z FROM (
  SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM (SELECT *, (excess + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM (SELECT * REPLACE (n::DOUBLE AS n) FROM mom) z) y) w""".replace("SELECT variable, n, excess, (1", "SELECT variable, CAST(n AS BIGINT) AS n, excess, (1")
add("kurtosis_test", "variable, n", "excess kurtosis_z", _KZ,
    lg=long(_MON), mom=_MOM.format("lg"))
add("jarque_bera", "variable", "skew jarque_bera", "SELECT variable, skew, n / 6 * (skew * skew + excess * excess / 4) AS jarque_bera FROM mom", lg=long(_MON), mom=_MOM.format("lg"))
_LM = """SELECT variable, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS l_skewness, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) AS l_kurtosis FROM (
  SELECT variable, avg(x) AS b0, avg((i - 1) / (n - 1) * x) AS b1, avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * x) AS b2, avg((i - 1) * (i - 2) * (i - 3) / ((n - 1) * (n - 2) * (n - 3)) * x) AS b3
  FROM (SELECT variable, x, row_number() OVER (PARTITION BY variable ORDER BY x)::DOUBLE AS i, count(*) OVER (PARTITION BY variable)::DOUBLE AS n FROM {}) q GROUP BY 1) z"""
_HILL = """SELECT variable, 1 / (avg(ln(x)) FILTER (WHERE i <= k) - max(ln(x)) FILTER (WHERE i = k + 1)) AS hill_alpha FROM (SELECT variable, x, row_number() OVER (PARTITION BY variable ORDER BY x DESC) AS i,
  greatest(floor(count(*) OVER (PARTITION BY variable) * 0.01::DOUBLE), 10) AS k FROM {}) q GROUP BY 1"""
add("l_moments", "variable", "l_skewness l_kurtosis", _LM.format("lg"), lg=long(_MON))
add("hill_alpha", "variable", "hill_alpha", _HILL.format("lg"), lg=long(_MON, "{c} > 0"))
_MONEY = ["relationship_value", "deposit_balance", "aum", "salary_base_annual", "bonus_annual", "pension_monthly", "dividend_annual", "business_distribution_annual", "recurring_income_monthly"]
_HI = """SELECT *, coalesce(salary_base_annual / 12, 0) + coalesce(pension_monthly, 0) + coalesce(dividend_annual / 12, 0) + coalesce(business_distribution_annual / 12, 0) AS recurring_income_monthly FROM household"""
add("tail_table", "variable, n", {"mean": 4, "sd": 3, "skew": 6, "excess": 6, "excess_log": 6, "median": 4, "p99_p50": 6, "l_skewness": 6, "l_kurtosis": 6, "hill_alpha": 6},
    """SELECT m.variable, m.n, m.mean, m.sd, m.skew, m.excess, ml.excess AS excess_log, median, p99 / median AS p99_p50, l_skewness, l_kurtosis, hill_alpha FROM mom m JOIN moml ml ON m.variable = ml.variable
  JOIN (SELECT variable, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS p99 FROM lg GROUP BY 1) q ON m.variable = q.variable JOIN lm ON m.variable = lm.variable JOIN hl ON m.variable = hl.variable""",
    hi=_HI, lg=long(_MONEY, "{c} > 0", "hi"), lgl="SELECT variable, ln(x) AS x FROM lg", mom=_MOM.format("lg"), moml=_MOM.format("lgl"), lm=_LM.format("lg"), hl=_HILL.format("lg"))
add("mean_vs_theory", "variable", {"mean": 4, "statistic": 6}, """SELECT variable, mean, (mean - t) / (sd / sqrt(n)) AS statistic FROM mom m JOIN (VALUES ('age_primary', 61), ('tenure_years', 9), ('relationship_value', 150000)) v(w, t) ON variable = w""",
    lg=long(["age_primary", "tenure_years", "relationship_value"]), mom=_MOM.format("lg"))
_B = {"relationship_value_mean": ("avg(relationship_value)", 5e6, 15e6), "relationship_value_median": ("quantile_cont(relationship_value, 0.5)", 3e6, 8e6),
      "deposit_share_mean": ("avg(deposit_balance / relationship_value) FILTER (WHERE has_investments)", .2, .45), "salary_base_annual_median": ("quantile_cont(salary_base_annual, 0.5)", 250e3, 600e3),
      "bonus_to_salary_mean": ("avg(bonus_annual / salary_base_annual)", .3, .8), "pension_monthly_median": ("quantile_cont(pension_monthly, 0.5)", 5e3, 15e3), "dividend_yield_mean": ("avg(dividend_annual / aum)", .015, .025),
      "recurring_income_monthly_median": ("quantile_cont(recurring_income_monthly, 0.5) FILTER (WHERE recurring_income_monthly > 0)", 15e3, 60e3), "age_primary_mean": ("avg(age_primary)", 55, 65),
      "tenure_years_mean": ("avg(tenure_years)", 6, 12), "hard_churn_6m_rate": ("avg(hard_churn_6m)", .03, .1), "soft_churn_3m_rate": ("avg(soft_churn_3m)", .05, .15)}
add("business_bands", "statistic_name, ok", {"value": 4}, " UNION ALL ".join(f"SELECT '{n}' AS statistic_name, {e} AS value, {e} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE AS ok FROM hi" for n, (e, lo, hi) in _B.items()), hi=_HI)
_SP = lambda a, b: f"""SELECT '{a}~{b}' AS pair, count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM household WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"""
add("spearman_test", "pair, n", "rho t_statistic", "SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_statistic FROM sp", sp=_SP("relationship_value", "tenure_years") + " UNION ALL " + _SP("salary_base_annual", "age_primary"))
add("welch_ttest", "", "difference statistic dof", """SELECT m1 - m0 AS difference, (m1 - m0) / sqrt(v1 + v0) AS statistic, (v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)) AS dof FROM (
  SELECT avg(relationship_value) FILTER (WHERE has_credit_anchor) AS m1, avg(relationship_value) FILTER (WHERE NOT has_credit_anchor) AS m0, count(*) FILTER (WHERE has_credit_anchor) AS n1,
  count(*) FILTER (WHERE NOT has_credit_anchor) AS n0, var_samp(relationship_value) FILTER (WHERE has_credit_anchor) / count(*) FILTER (WHERE has_credit_anchor) AS v1,
  var_samp(relationship_value) FILTER (WHERE NOT has_credit_anchor) / count(*) FILTER (WHERE NOT has_credit_anchor) AS v0 FROM household) q""")
_RANK = """SELECT r.{k}, max(p.v) AS production, count(r.v) AS runs, (sum(CASE WHEN r.v < p.v THEN 1.0 WHEN r.v = p.v THEN 0.5 ELSE 0 END) + 0.5) / (count(r.v) + 1) AS percentile
FROM runs r JOIN runs p ON r.{k} = p.{k} AND p.month = 0 WHERE r.month < 0 GROUP BY 1"""
_RUN = "SELECT '{n}' AS {k}, month, round({e}, 4) AS v FROM monthly GROUP BY month"
for _name, _k, _rows in (("empirical_percentile_rank", "metric", [("mean deposit", "avg(deposit_avg_balance)")]),
                         ("reference_run_atypicality", "variable", [("deposit", "avg(deposit_avg_balance)"), ("aum", "avg(aum_month_end)"), ("withdrawal_rate", "avg(CAST(aum_withdrawals > 0 AS INTEGER))")])):
    add(_name, f"{_k}, runs", {"production": 6, "percentile": 6, "p_value": 6}, "SELECT *, 2 * least(percentile, 1 - percentile) AS p_value FROM rk",
        runs=" UNION ALL ".join(_RUN.format(n=n, k=_k, e=e) for n, e in _rows), rk=_RANK.format(k=_k))
_T = "SELECT banker_id, round(avg(CAST(has_trust AS INTEGER)) / 10, 4) AS p_value FROM household GROUP BY 1"
_BH = """SELECT banker_id, p_value, least(1, min(p_value * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM (
  SELECT *, row_number() OVER (ORDER BY p_value, banker_id) AS i, count(*) OVER () AS n FROM {}) q"""
add("bh_adjust", "banker_id", "p_value p_bh", _BH.format("tests"), tests=_T)
add("cummin_reverse_bh", "banker_id", "p_value p_bh", _BH.format("tests2"), tests=_T, tests2="SELECT * FROM tests")


def _phi(z: str) -> str:
    """Normal CDF by its series of positive terms z^(2k+1) / (2k+1)!!."""
    return (f"(CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + 0.5 * ln(pi())))) END)")


def _linked(column: str, median: float, sigma: float, link: float, floor: float | None) -> str:
    own, middle = f"({sigma} * sqrt(1 - {link} * {link}))::DOUBLE", f"(ln({median}) + {link} * {sigma} * w)"
    least = "NULL::DOUBLE" if floor is None else f"(ln({floor}) - {middle}) / {own}"
    return (f"SELECT household_id, '{column}' AS column_name, (ln({column}) - {middle}) / {own} AS z, {least} AS a "
            f"FROM wealth WHERE {column} IS NOT NULL")


def _binomial_upper(x: str, n: int, least: int) -> str:
    """Beta(least, n - least + 1) CDF: at least so many of n hits."""
    return "1 - (" + " + ".join(f"{math.comb(n, j)} * pow({x}, {j}) * pow(1 - {x}, {n - j})" for j in range(least)) + ")"


_LAW = dict(
    wealth="SELECT *, (ln(relationship_value) - ln(80000::DOUBLE)) / 0.7::DOUBLE AS w FROM household",
    zs=" UNION ALL ".join([
        "SELECT household_id, 'relationship_value' AS column_name, least(w, (ln(150000::DOUBLE) - ln(80000::DOUBLE)) / 0.7::DOUBLE) AS z, (ln(1000::DOUBLE) - ln(80000::DOUBLE)) / 0.7::DOUBLE AS a FROM wealth",
        _linked("salary_base_annual", 350000, 0.55, 0.45, 150000), _linked("pension_monthly", 9000, 0.5, 0.3, 2500),
        _linked("business_distribution_annual", 500000, 0.9, 0.5, None)]),
    us=f"SELECT household_id, column_name, CASE WHEN a IS NULL THEN {_phi('z')} ELSE ({_phi('z')} - {_phi('a')}) / (1 - {_phi('a')}) END AS u FROM zs",
    laws=f"""SELECT u.household_id, column_name, CASE WHEN column_name = 'relationship_value' AND relationship_value >= 150000
    THEN u + (1 - u) * (1 - pow(150000::DOUBLE / relationship_value, 1.5)) / (1 - pow(150000::DOUBLE / 1e9, 1.5)) ELSE u END AS pit FROM us u JOIN household h ON u.household_id = h.household_id
  UNION ALL SELECT household_id, 'deposit_share', {_binomial_upper('(deposit_balance::DOUBLE / relationship_value)', 6, 2)} FROM household WHERE has_investments
  UNION ALL SELECT household_id, 'tenure_years', 1 - exp(-tenure_years / 4.5::DOUBLE) * (1 + tenure_years / 4.5::DOUBLE) FROM household WHERE age_primary >= 68
  UNION ALL SELECT household_id, 'bonus_share', pow(b, 1.5) * (1 + 1.5 * (1 - b) + 1.875 * (1 - b) * (1 - b)) FROM (
    SELECT household_id, least(1, greatest(0, (bonus_annual::DOUBLE / salary_base_annual - 0.1::DOUBLE) / 1.4::DOUBLE)) AS b FROM household WHERE bonus_annual > 0) q
  UNION ALL SELECT household_id, 'dividend_yield', {_binomial_upper('(dividend_annual::DOUBLE / aum)', 199, 4)} FROM household WHERE aum > 0 AND dividend_annual IS NOT NULL""")
add("pit_transform", "household_id, column_name", "pit", "SELECT household_id, column_name, pit FROM laws WHERE pit IS NOT NULL", **_LAW)
add("pit_uniformity", "column_name, n", "statistic p_value", """SELECT column_name, n, statistic, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x))))) END AS p_value FROM (
  SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * statistic AS x FROM (SELECT column_name, count(*) AS n, max(greatest(i / n - pit, pit - (i - 1) / n)) AS statistic FROM (
    SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY pit) AS i, count(*) OVER (PARTITION BY column_name) AS n FROM laws WHERE pit IS NOT NULL) r GROUP BY 1) g) q""", **_LAW)

_MONEY = ["relationship_value", "salary_base_annual", "pension_monthly", "business_distribution_annual"]
add("poisson_collision_bound", "variable, repeated, upper, ok", "expected", """SELECT variable, repeated, expected, upper, repeated <= upper AS ok FROM (SELECT e.variable, any_value(repeated) AS repeated, any_value(expected) AS expected, min(k) AS upper FROM ex e JOIN (
  SELECT variable, k, sum(exp(-expected + k * ln(expected) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY variable ORDER BY k) AS held FROM (
    SELECT *, unnest(range(0, CAST(expected + 20 * sqrt(expected + 1) + 50 AS BIGINT))) AS k FROM ex) a) b ON e.variable = b.variable WHERE held >= 0.999 GROUP BY 1) q""",
    lg=long(_MONEY, "{c} > 0"),
    wd="SELECT variable, count(*) AS n, count(DISTINCT x) AS d, stddev_samp(ln(x)) * pow(count(*)::DOUBLE, -0.2) AS h FROM lg GROUP BY 1",
    dealt="SELECT variable, x, floor(ln(x) / h * 16) AS c, ln(x) / h * 16 - floor(ln(x) / h * 16) AS r FROM lg JOIN wd USING (variable)",
    cells="""SELECT variable, c, sum(s) AS mass, sum(s / x) AS inverse FROM (SELECT variable, x, c, 1 - r AS s FROM dealt
      UNION ALL SELECT variable, x, c + 1, r FROM dealt) q GROUP BY 1, 2""",
    ex="""SELECT a.variable, any_value(n) - any_value(d) AS repeated, (any_value(n) - 1) / (2 * any_value(n)::DOUBLE) * 0.01::DOUBLE / (any_value(h) * sqrt(2 * pi()))
      * sum(a.inverse * b.mass * exp(-(a.c - b.c) * (a.c - b.c) / 512)) AS expected FROM cells a JOIN cells b ON a.variable = b.variable AND abs(a.c - b.c) <= 96 JOIN wd ON wd.variable = a.variable GROUP BY 1""")

_KS_P = """CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x))))) END"""
add("ks_distribution", "series, n", "statistic p_value", f"""SELECT 'return' AS series, n, statistic, {_KS_P} AS p_value FROM (
  SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * statistic AS x FROM (SELECT CAST(max(n) AS BIGINT) AS n, max(greatest(i / n - u, u - (i - m) / n)) AS statistic FROM (
    SELECT m, {_phi('z')} AS u, sum(m) OVER (ORDER BY z) AS i, sum(m) OVER () AS n FROM (
      SELECT portfolio_return / 0.0121::DOUBLE AS z, count(*) AS m FROM monthly_return GROUP BY 1) v) w) g) q""")
add("p_values", "variable", "p_kurtosis p_jarque_bera", f"""SELECT k.variable, 2 * {_phi('(-abs(kurtosis_z))')} AS p_kurtosis,
  exp(-m.n / 6 * (skew * skew + m.excess * m.excess / 4) / 2) AS p_jarque_bera FROM kz k JOIN mom m ON k.variable = m.variable""",
    lg=long(_MON), mom=_MOM.format("lg"), kz=_KZ)
add("truncnorm_body_kurtosis", "n", "excess theory statistic", """SELECT n, excess, theory, (excess - theory) / sqrt(24 / n::DOUBLE) AS statistic FROM (
  SELECT count(*) AS n, kurtosis_pop(ln(relationship_value)) AS excess FROM household WHERE relationship_value >= 20000 AND relationship_value < 250000) o, (
  SELECT (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / ((m2 - m1 * m1) * (m2 - m1 * m1)) - 3 AS theory FROM (
    SELECT *, 3 * m2 + (a * a * a * pa - b * b * b * pb) / mass AS m4, 2 * m1 + (a * a * pa - b * b * pb) / mass AS m3 FROM (
      SELECT *, (pa - pb) / mass AS m1, 1 + (a * pa - b * pb) / mass AS m2 FROM cut) c) d) t""",
    ends="SELECT (ln(20000) - 11.5::DOUBLE) / 0.6::DOUBLE AS a, (ln(250000) - 11.5::DOUBLE) / 0.6::DOUBLE AS b",
    cut=f"SELECT a, b, exp(-a * a / 2) / sqrt(2 * pi()) AS pa, exp(-b * b / 2) / sqrt(2 * pi()) AS pb, {_phi('b')} - {_phi('a')} AS mass FROM ends")
add("mardia", "dof", "skewness_stat kurtosis_z p_skewness p_kurtosis", f"""SELECT s AS skewness_stat, 10 AS dof, z AS kurtosis_z,
  exp(-s / 2) * (1 + s / 2 + pow(s / 2, 2) / 2 + pow(s / 2, 3) / 6 + pow(s / 2, 4) / 24) AS p_skewness, 2 * {_phi('(-abs(z))')} AS p_kurtosis FROM (
  SELECT count(*) / 6.0::DOUBLE * (pow(avg(u * u * u), 2) + pow(avg(v * v * v), 2) + pow(avg(w * w * w), 2)
    + 3 * (pow(avg(u * u * v), 2) + pow(avg(u * u * w), 2) + pow(avg(u * v * v), 2) + pow(avg(v * v * w), 2) + pow(avg(u * w * w), 2) + pow(avg(v * w * w), 2))
    + 6 * pow(avg(u * v * w), 2)) AS s, (avg(pow(u * u + v * v + w * w, 2)) - 15) / sqrt(120.0::DOUBLE / count(*)) AS z FROM white) q""",
    xs="SELECT ln(relationship_value) AS x1, tenure_years::DOUBLE AS x2, age_primary::DOUBLE AS x3 FROM household",
    cov="""SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13,
      covar_pop(x2, x2) AS c22, covar_pop(x2, x3) AS c23, covar_pop(x3, x3) AS c33 FROM xs""",
    l1="SELECT *, sqrt(c11) AS l11, c12 / sqrt(c11) AS l21, c13 / sqrt(c11) AS l31, sqrt(c22 - c12 * c12 / c11) AS l22 FROM cov",
    l2="SELECT *, (c23 - l21 * l31) / l22 AS l32 FROM l1",
    white="""SELECT u, v, (x3 - m3 - l31 * u - l32 * v) / sqrt(c33 - l31 * l31 - l32 * l32) AS w FROM (
      SELECT *, (x2 - m2 - l21 * u) / l22 AS v FROM (SELECT *, (x1 - m1) / l11 AS u FROM xs, l2) a) b""")

_TAIL_MONEY = ["relationship_value", "deposit_balance", "aum", "salary_base_annual", "bonus_annual", "pension_monthly", "dividend_annual", "business_distribution_annual", "recurring_income_monthly"]
_MEASURES = [("mean", "mom", "mean"), ("excess", "mom", "excess"), ("excess_log", "moml", "excess"), ("l_kurtosis", "lm", "l_kurtosis"), ("hill_alpha", "hl", "hill_alpha")]
_ATYPICAL = dict(
    hi=_HI, lg=" UNION ALL ".join(f"SELECT (('0x' || substr(md5(household_id::VARCHAR), 1, 8))::BIGINT % 21) || '|{c}' AS variable, {c}::DOUBLE AS x FROM hi WHERE {c} > 0" for c in _TAIL_MONEY),
    lgl="SELECT variable, ln(x) AS x FROM lg", mom=_MOM.format("lg"), moml=_MOM.format("lgl"), lm=_LM.format("lg"), hl=_HILL.format("lg"),
    vals=" UNION ALL ".join(f"SELECT CAST(split_part(variable, '|', 1) AS INTEGER) AS run, split_part(variable, '|', 2) || ' {m}' AS test, round({c}, 6) AS v FROM {t} WHERE isfinite({c})" for m, t, c in _MEASURES),
    rk="""SELECT *, 2 * least(percentile, 1 - percentile) AS p_value FROM (SELECT r.test, max(p.v) AS production, count(*) AS runs,
      (sum(CASE WHEN r.v < p.v THEN 1.0 WHEN r.v = p.v THEN 0.5 ELSE 0 END) + 0.5::DOUBLE) / (count(*) + 1) AS percentile FROM vals r JOIN vals p ON r.test = p.test AND p.run = 0 WHERE r.run > 0 GROUP BY 1) q""")
add("run_atypicality", "test, runs", "production percentile p_value p_bh", """SELECT test, runs, production, percentile, p_value,
  least(1, min(p_value * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM (
  SELECT *, row_number() OVER (ORDER BY p_value, test) AS i, count(*) OVER () AS n FROM rk) q""", **_ATYPICAL)
add("atypicality_uniformity", "family, n", "statistic p_value", f"""SELECT 'tails' AS family, n, statistic, {_KS_P} AS p_value FROM (
  SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * statistic AS x FROM (SELECT count(*) AS n, max(greatest(i / n - p_value, p_value - (i - 1) / n)) AS statistic FROM (
    SELECT p_value, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM rk) v HAVING count(*) > 0) g) q""", **_ATYPICAL)
add("binomial_exact", "check_name, n, k", "expected p_value", """SELECT any_value(t.check_name) AS check_name, any_value(t.n) AS n, any_value(t.k) AS k, any_value(t.p) AS expected,
  CASE WHEN any_value(t.k) = any_value(t.p * t.n) THEN 1.0 ELSE least(1.0, sum(exp(l)) FILTER (WHERE l <= o + 1e-7::DOUBLE)) END AS p_value FROM pmf t JOIN (SELECT check_name, l AS o FROM pmf WHERE j = k) b ON t.check_name = b.check_name GROUP BY t.check_name""",
    checks="""SELECT 'credit anchor' AS check_name, count(*) AS n, count(*) FILTER (WHERE has_credit_anchor) AS k, 0.35::DOUBLE AS p FROM household
      UNION ALL SELECT 'trust, HNW', count(*), count(*) FILTER (WHERE has_trust), 0.30::DOUBLE FROM household WHERE segment = 'HNW'
      UNION ALL SELECT 'advisory with investments', count(*), count(*) FILTER (WHERE has_advisory), 0.70::DOUBLE FROM household WHERE has_investments""",
    pmf="""SELECT *, lgamma(n + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(n - j + 1.0::DOUBLE) + j * ln(p) + (n - j) * ln(1 - p) AS l FROM (
      SELECT *, unnest(range(0, n + 1)) AS j FROM checks) q""")
