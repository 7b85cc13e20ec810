"""Queries of the statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.contract import BUSINESS_BANDS, MONEY_COLUMNS
from ebbtide.functions import pvalues
from ebbtide.operators import ordering, profiles, statistics as st
from ebbtide.params import IncomeLaws
from ebbtide.plans.registry import query
from ebbtide.sources import adapters as src

#: The configured laws at the scale of the adapters' relationship values.
LAWS = IncomeLaws(value_median=80_000.0, value_sigma=0.7, value_min=1_000.0, tail_start=150_000.0, tail_end=1e9)


def _pit(spark, sf):
    """Probability transforms with closed forms: uniform and exponential models."""
    h = src.household(spark, sf)
    wide = h.select("household_id", (F.col("tenure_years") / 30).alias("tenure"),
                    (1 - F.exp(-F.col("relationship_value") / 150000)).alias("value"))
    return profiles.unpivot(wide, ["household_id"], ["tenure", "value"]).withColumnRenamed(
        "value", "pit")


@query("ks_uniform")
def ks_uniform(spark, sf):
    return st.ks_uniform(_pit(spark, sf), "pit", ["variable"])


@query("ks_distribution")
def ks_distribution(spark, sf):
    """KS of standardized monthly returns against the normal, with its p-value."""
    r = src.monthly_return(spark, sf).select(
        F.lit("return").alias("series"),
        pvalues.normal_cdf_column(F.col("portfolio_return") / 0.0121).alias("pit"))
    d = st.ks_uniform(r, "pit", ["series"])
    return d.withColumn("p_value", pvalues.p_value(F.lit("ks"), F.col("statistic"), F.col("n")))


@query("cramer_von_mises")
def cramer_von_mises(spark, sf):
    return st.cramer_von_mises(_pit(spark, sf), "pit", ["variable"])


@query("pit_transform")
def pit_transform(spark, sf):
    return st.pit_columns(src.household(spark, sf), LAWS)


@query("pit_uniformity")
def pit_uniformity(spark, sf):
    """KS distance of each column's transforms to the uniform law, with its p-value."""
    d = st.ks_uniform(st.pit_columns(src.household(spark, sf), LAWS), "pit", ["column_name"])
    return d.withColumn("p_value", pvalues.p_value(F.lit("ks"), F.col("statistic"), F.col("n")))


@query("chi_square_gof")
def chi_square_gof(spark, sf):
    return st.chi_square_gof(src.household(spark, sf), "pay_frequency",
                             {"biweekly": .40, "semimonthly": .45, "monthly": .15})


@query("chi_square_independence")
def chi_square_independence(spark, sf):
    h = src.household(spark, sf).filter("NOT churn_excluded")
    return st.chi_square_independence(h, "segment", "soft_churn_3m")


@query("binomial_exact")
def binomial_exact(spark, sf):
    every = F.lit(True)
    return st.binomial_tests(src.household(spark, sf), {
        "credit anchor": (every, F.col("has_credit_anchor"), .35),
        "trust, HNW": (F.col("segment") == "HNW", F.col("has_trust"), .30),
        "advisory with investments": (F.col("has_investments"), F.col("has_advisory"), .70)})


def _probabilities(spark, sf):
    return src.scores(spark, sf).filter("model = 'statistical'")


@query("hosmer_lemeshow")
def hosmer_lemeshow(spark, sf):
    return st.hosmer_lemeshow(_probabilities(spark, sf), "label", "prob", estimated=1)


@query("poisson_binomial_z")
def poisson_binomial_z(spark, sf):
    return st.poisson_binomial_z(_probabilities(spark, sf), "label", "prob")


@query("mardia")
def mardia(spark, sf):
    return st.mardia(src.household(spark, sf).withColumn("lv", F.log("relationship_value")),
                     ["lv", "tenure_years", "age_primary"])


@query("fisher_z_corr")
def fisher_z(spark, sf):
    return st.fisher_z(src.household(spark, sf), "relationship_value", "tenure_years", 0.1)


def _money_long(spark, sf):
    return profiles.unpivot(src.household(spark, sf), [], ["relationship_value", "aum",
                                                           "pension_monthly", "tenure_years"])


@query("kurtosis_test")
def kurtosis_test(spark, sf):
    return st.moments(_money_long(spark, sf), "value", ["variable"]).select(
        "variable", "n", "excess", "kurtosis_z")


@query("jarque_bera")
def jarque_bera(spark, sf):
    return st.moments(_money_long(spark, sf), "value", ["variable"]).select(
        "variable", "skew", "jarque_bera")


@query("l_moments")
def l_moments(spark, sf):
    return st.l_moments(_money_long(spark, sf), "value", ["variable"])


@query("hill_alpha")
def hill_alpha(spark, sf):
    return st.hill_alpha(_money_long(spark, sf).filter("value > 0"), "value", ["variable"])


@query("tail_table", mean=4, sd=3, median=4)
def tail_table(spark, sf):
    h = src.household(spark, sf).withColumn("recurring_income_monthly", profiles.recurring_income())
    return st.tail_table(h, MONEY_COLUMNS)


@query("pareto_trunc_mle")
def pareto(spark, sf):
    return st.pareto_tail_alpha(src.household(spark, sf), "relationship_value", 150_000.0, 1e9)


@query("student_t_fit")
def student_t_fit(spark, sf):
    r = src.monthly_return(spark, sf).select((F.col("portfolio_return") / 0.0121).alias("z"))
    return st.student_t_fit(r, "z")


@query("truncnorm_body_kurtosis")
def body_kurtosis(spark, sf):
    return st.body_kurtosis(src.household(spark, sf), "relationship_value", 20_000.0, 250_000.0,
                            11.5, 0.6)


@query("mean_vs_theory", mean=4)
def mean_vs_theory(spark, sf):
    return st.mean_vs_theory(src.household(spark, sf), {"age_primary": 61.0, "tenure_years": 9.0,
                                                        "relationship_value": 150_000.0})


@query("business_bands", value=4)
def business_bands(spark, sf):
    h = src.household(spark, sf).withColumn("recurring_income_monthly", profiles.recurring_income())
    long = profiles.unpivot(h, [], ["relationship_value", "salary_base_annual", "pension_monthly",
                                    "recurring_income_monthly"]).filter("value > 0")
    medians = ordering.exact_quantiles(long, "value", {"median": .5}, ["variable"])
    median_row = medians.agg(*[F.max(F.when(F.col("variable") == v, F.col("median")))
                               .alias(f"{v}_median") for v in (
        "relationship_value", "salary_base_annual", "pension_monthly", "recurring_income_monthly")])
    means = h.agg(
        F.avg("relationship_value").alias("relationship_value_mean"),
        F.avg(F.when(F.col("has_investments"), F.col("deposit_balance") / F.col("relationship_value")))
         .alias("deposit_share_mean"),
        F.avg(F.col("bonus_annual") / F.col("salary_base_annual")).alias("bonus_to_salary_mean"),
        F.avg(F.col("dividend_annual") / F.col("aum")).alias("dividend_yield_mean"),
        F.avg("age_primary").alias("age_primary_mean"),
        F.avg("tenure_years").alias("tenure_years_mean"),
        F.avg("hard_churn_6m").alias("hard_churn_6m_rate"),
        F.avg("soft_churn_3m").alias("soft_churn_3m_rate"))
    one = means.select("*", *[median_row.select(c).scalar().alias(c) for c in median_row.columns])
    return st.in_bands(one, BUSINESS_BANDS)


@query("spearman_test")
def spearman_test(spark, sf):
    return st.spearman_test(src.household(spark, sf), [
        ("relationship_value", "tenure_years"), ("salary_base_annual", "age_primary")],
        "household_id")


@query("welch_ttest")
def welch(spark, sf):
    return st.welch(src.household(spark, sf), "relationship_value", F.col("has_credit_anchor"))


@query("poisson_collision_bound")
def collision(spark, sf):
    return st.collision_bound(src.household(spark, sf), [
        "relationship_value", "salary_base_annual", "pension_monthly", "business_distribution_annual"])


def _runs(spark, sf):
    """Metrics of the panel by month; the snapshot month is the production run."""
    return src.monthly(spark, sf).groupBy("month").agg(
        F.avg("deposit_avg_balance").alias("value")).select(
        F.lit("mean deposit").alias("metric"), "month", F.round("value", 4).alias("value"))


@query("empirical_percentile_rank")
def empirical_rank(spark, sf):
    runs = _runs(spark, sf)
    return st.empirical_rank(runs.filter("month < 0"), runs.filter("month = 0"), "value", "metric")


@query("reference_run_atypicality")
def atypicality(spark, sf):
    runs = src.monthly(spark, sf).groupBy("month").agg(
        F.avg("deposit_avg_balance").alias("deposit"), F.avg("aum_month_end").alias("aum"),
        F.avg((F.col("aum_withdrawals") > 0).cast("int")).alias("withdrawal_rate"))
    long = profiles.unpivot(runs, ["month"], ["deposit", "aum", "withdrawal_rate"]).withColumn(
        "value", F.round("value", 4))
    return st.empirical_rank(long.filter("month < 0"), long.filter("month = 0"), "value", "variable")


def _run_tests(spark, sf):
    """Tails of a production run of households against twenty reference runs of other households."""
    h = src.household(spark, sf).withColumn("recurring_income_monthly", profiles.recurring_income())
    return st.run_atypicality(h, MONEY_COLUMNS, st.run_of(F.col("household_id"), 20))


@query("run_atypicality")
def run_atypicality(spark, sf):
    return _run_tests(spark, sf)


@query("atypicality_uniformity")
def atypicality_uniformity(spark, sf):
    """The p-values of a typical run are uniform: their KS distance and its p-value."""
    d = st.ks_uniform(_run_tests(spark, sf).withColumn("family", F.lit("tails")), "p_value", ["family"])
    return d.withColumn("p_value", pvalues.p_value(F.lit("ks"), F.col("statistic"), F.col("n")))


def _tests(spark, sf):
    """A list of tests: one p-like value per banker book, from its share of trusts."""
    h = src.household(spark, sf)
    return h.groupBy("banker_id").agg(F.round(F.avg(F.col("has_trust").cast("int")) / 10, 4)
                                      .alias("p_value"))


@query("bh_adjust")
def bh_adjust(spark, sf):
    return st.bh_adjust(_tests(spark, sf), "p_value", "banker_id")


@query("cummin_reverse_bh")
def cummin(spark, sf):
    return st.bh_adjust(_tests(spark, sf), "p_value", "banker_id")


@query("p_values")
def p_values(spark, sf):
    """Two-sided normal and chi-square p-values of aggregated statistics."""
    m = st.moments(_money_long(spark, sf), "value", ["variable"])
    return m.select("variable", pvalues.p_value(F.lit("normal"), F.col("kurtosis_z"), F.lit(1))
                    .alias("p_kurtosis"),
                    pvalues.p_value(F.lit("chi2"), F.col("jarque_bera"), F.lit(2))
                    .alias("p_jarque_bera"))
