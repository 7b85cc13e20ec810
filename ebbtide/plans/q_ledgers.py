"""Queries of exports, row-level operators, joins, aggregates, reconciliation and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide.contract import (ALERT_GROUPS, EXCLUDED_PAYMENTS, EXCLUDED_PRODUCT_REASONS,
                              EXTERNAL_OUT, HOUSEHOLD_FLAGS, MONEY_COLUMNS)
from ebbtide.functions.columns import (day_offset, in_window, is_true,
                                       month_of, routing_is_valid, safe_pct, text_rule)
from ebbtide.operators import accounts, labels, ledger, near_duplicates, nearest, ordering, profiles
from ebbtide.operators.transfers import semi_join_category
from ebbtide.plans import features as plan
from ebbtide.plans.registry import query
from ebbtide.sources import adapters as src

P = plan.DEFAULT
DECILES = {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95}


def _eligible(spark, sf):
    return src.household(spark, sf).filter(~F.col("churn_excluded"))


# ---------------------------------------------------------------- exports
@query("export_monthly_long", deposit_avg_balance=2, aum_month_end=2)
def export_monthly_long(spark, sf):
    return src.monthly(spark, sf).filter("available").select(
        "household_id", F.date_add(F.lit(src.SNAPSHOT), F.ceil(F.col("month") * 30.44).cast("int"))
        .alias("month_end"), "deposit_avg_balance", "aum_month_end")


@query("export_transactions_long", amount=2)
def export_transactions(spark, sf):
    return src.recurring_tx(spark, sf).drop("day").orderBy("household_id", "date", "stream")


@query("export_transfers_enriched", amount=2)
def export_transfers(spark, sf):
    return accounts.enrich_transfers(src.transfer(spark, sf), src.institution(spark, sf)).select(
        "household_id", "date", "category", "amount", "inst_id", "dest_id", "aba", "inst_type",
        "competitor_bank", "broker_wealth")


@query("export_accounts")
def export_accounts(spark, sf):
    rows = accounts.account_number(src.account(spark, sf))
    return accounts.with_date(rows, "close_day", "close_date", src.SNAPSHOT).drop("account_id")


@query("export_interactions", minutes=3)
def export_interactions(spark, sf):
    return src.interaction(spark, sf).drop("day").orderBy("household_id", "date")


@query("export_complaints")
def export_complaints(spark, sf):
    rows = accounts.with_date(src.complaint(spark, sf), "open_day", "open_date", src.EVENT_SNAPSHOT)
    return accounts.with_date(rows, "close_day", "close_date", src.EVENT_SNAPSHOT).drop(
        "elapsed_days")


@query("export_catalog_join")
def export_catalog(spark, sf):
    return src.institution_aba(spark, sf).join(src.institution(spark, sf), "inst_id")


@query("read_features_labels")
def read_features_labels(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "n_chars")
    return docs.join(src.table(spark, sf, "labels"), "doc_id")


@query("write_manifest")
def write_manifest(spark, sf):
    return profiles.fingerprint(src.household(spark, sf), "defaults", True)


# ---------------------------------------------------------------- projections
def _derived(spark, sf):
    return profiles.derive_household(src.household(spark, sf), P.replace(uhnw_threshold=150_000.0))


@query("assign_segment")
def assign_segment(spark, sf):
    return _derived(spark, sf).select("household_id", "segment")


@query("split_relationship_value", aum_split=2, value_sum=2)
def split_value(spark, sf):
    return _derived(spark, sf).select("household_id", "aum_split", "value_sum")


@query("history_months")
def history_months(spark, sf):
    return _derived(spark, sf).select("household_id", "history_from_tenure")


@query("cap_tenure")
def cap_tenure(spark, sf):
    return _derived(spark, sf).select("household_id", "tenure_capped")


@query("any_recurring_flag")
def any_recurring_flag(spark, sf):
    return _derived(spark, sf).select("household_id", "has_any_recurring_stream")


@query("recurring_income_monthly", recurring_income_monthly=4)
def recurring_income(spark, sf):
    return _derived(spark, sf).select("household_id", "recurring_income_monthly")


@query("null_unless_applicable")
def null_unless(spark, sf):
    h = src.household(spark, sf)
    return h.select("household_id", F.when(F.col("has_trust"), F.col("relationship_value"))
                    .alias("trust_value"),
                    F.when(F.col("has_advisory"), F.col("aum")).alias("advised_aum"))


@query("safe_pct")
def safe_pct_query(spark, sf):
    m = src.monthly(spark, sf)
    return m.select("household_id", "month", safe_pct(
        F.col("aum_withdrawals"), F.col("deposit_avg_balance"), P.min_balance_for_pct).alias("pct"))


@query("month_of")
def month_of_query(spark, sf):
    return src.transfer(spark, sf).groupBy(month_of("day").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("day_offset")
def day_offset_query(spark, sf):
    return src.transfer(spark, sf).groupBy("date").agg(
        F.max(day_offset("date", F.lit(src.SNAPSHOT))).alias("days"))


@query("open_day")
def open_day_query(spark, sf):
    h = src.household(spark, sf)
    return h.select("household_id", accounts.open_day("history_months", 24).alias("detector_open"),
                    accounts.open_day("history_months", 24, 548).alias("ledger_open"))


@query("filter_ledger_range", amount=2)
def filter_range(spark, sf):
    return accounts.filter_ledger_range(src.transfer(spark, sf), src.household(spark, sf), P).select(
        "household_id", "day", "category", "amount", "inst_id")


@query("exclude_ineligible")
def exclude_ineligible(spark, sf):
    return _eligible(spark, sf).select("household_id", "segment", "hard_churn_6m")


@query("alert_rule")
def alert_rule(spark, sf):
    b = plan.balances(spark, sf)
    rules = {"aum_outflow_pct_90d": "> 0.10", "deposit_balance_change_pct_90d": "<= -0.25",
             "aum_vs_baseline_pct": "<= -0.20", "deposit_balance_vs_6m_avg_pct": "<= -0.30"}
    return b.select("household_id", *[text_rule(r, c).cast("int").alias(f"alert_{c}")
                                      for c, r in rules.items()])


@query("alert_rule_compound")
def alert_rule_compound(spark, sf):
    t = plan.transfer_flows(spark, sf)
    rules = ALERT_GROUPS["transfers"]
    return t.select("household_id", is_true(F.expr(rules[3])).cast("int").alias("accel"),
                    is_true(F.expr(rules[5])).cast("int").alias("hhi"))


IMPUTED = ["aum", "salary_base_annual", "pension_monthly"]


@query("median_impute_with_indicator", aum=4, salary_base_annual=4, pension_monthly=4)
def impute(spark, sf):
    h = src.household(spark, sf).select("household_id", *IMPUTED)
    q = profiles.column_quantiles(h, IMPUTED, {"m": .5})
    return profiles.impute_with_indicator(h, {c: q[c]["m"] for c in IMPUTED})


@query("winsorize", relationship_value=4, aum=4)
def winsorize(spark, sf):
    cols = ["relationship_value", "aum"]
    h = src.household(spark, sf).select("household_id", *cols)
    return profiles.winsorize(h, profiles.column_quantiles(h, cols, {"low": .01, "high": .99}))


@query("standardize")
def standardize(spark, sf):
    h = src.household(spark, sf).select("household_id", "relationship_value", "tenure_years",
                                        F.lit(1.0).alias("constant"))
    return profiles.standardize(h, ["relationship_value", "tenure_years", "constant"])


@query("log_relative_sequence")
def sequence(spark, sf):
    return profiles.log_relative_sequence(src.monthly(spark, sf))


@query("strip_stream_suffix")
def strip_suffix(spark, sf):
    tx = src.recurring_tx(spark, sf)
    return tx.groupBy(F.regexp_replace("stream", "_new$", "").alias("stream_family")).agg(
        F.count(F.lit(1)).alias("payments"))


@query("risk_band")
def risk_band(spark, sf):
    s = src.scores(spark, sf).filter("model = 'expert'")
    return profiles.risk_bands(s, "score", "label")


# ---------------------------------------------------------------- joins
@query("join_left_dim")
def join_left_dim(spark, sf):
    rows = accounts.enrich_transfers(src.transfer(spark, sf), src.institution(spark, sf))
    return rows.groupBy("inst_type").agg(F.count(F.lit(1)).alias("rows"))


@query("join_inner_dim")
def join_inner_dim(spark, sf):
    return src.institution_aba(spark, sf).join(src.institution(spark, sf), "inst_id").groupBy(
        "inst_type").agg(F.count(F.lit(1)).alias("routing_numbers"))


@query("join_feature_tables")
def join_feature_tables(spark, sf):
    return plan.relations(spark, sf).join(plan.banker(spark, sf), "household_id").join(
        plan.complaints(spark, sf), "household_id").select(
        "household_id", "products_closed_90d", "share_of_wallet", "contact_gap_ratio",
        "complaints_12m")


@query("join_base_truth")
def join_base_truth(spark, sf):
    truth = src.scores(spark, sf).filter("model = 'statistical'").select("household_id", "prob")
    return src.household(spark, sf).select("household_id", "segment").join(truth, "household_id")


@query("semi_join_category", total=2)
def semi_join(spark, sf):
    return semi_join_category(src.transfer(spark, sf), EXTERNAL_OUT).groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total"))


@query("anti_join_reason")
def anti_join(spark, sf):
    closed = src.account(spark, sf).filter("close_day IS NOT NULL")
    kept = closed.filter(~F.col("close_reason").isin(*EXCLUDED_PRODUCT_REASONS))
    return kept.groupBy("close_reason").agg(F.count(F.lit(1)).alias("accounts"))


@query("left_join_fill")
def left_join_fill(spark, sf):
    counts = src.complaint(spark, sf).groupBy("household_id").agg(F.count(F.lit(1)).alias("n"))
    return src.household(spark, sf).select("household_id").join(counts, "household_id", "left") \
        .select("household_id", F.coalesce("n", F.lit(0)).alias("complaints"))


@query("map_lookup")
def map_lookup(spark, sf):
    h = src.household(spark, sf)
    return h.select("household_id", accounts.lookup({"HNW": 90, "UHNW": 30}, "segment")
                    .alias("cadence_days"), profiles.pays_per_year("pay_frequency").alias("pays"))


@query("cross_join_months")
def cross_join_months(spark, sf):
    return src.monthly_cash(spark, sf).groupBy("household_id").agg(
        F.count(F.lit(1)).alias("months"), F.min("month").alias("first_month"))


@query("range_join_dynamic_window")
def range_join(spark, sf):
    """Payments inside a window that ends at each stream's own threshold day."""
    tx = src.recurring_tx(spark, sf)
    keys = ["household_id", "stream"]
    ends = tx.groupBy(*keys).agg((F.max("day") - 2).alias("end_day"))
    inside = tx.join(ends, keys).filter(in_window("day", F.col("end_day") - 14, F.col("end_day")))
    return inside.groupBy(*keys, "end_day").agg(F.count(F.lit(1)).alias("payments"))


@query("asof_business_day")
def asof_business_day(spark, sf):
    dates = src.transfer(spark, sf).select("date").distinct()
    return accounts.roll_to_business_day(dates, "date")


@query("monthly_due_dates")
def monthly_due_dates(spark, sf):
    """Quarterly due date, rolled to a business day, of each month with transfers."""
    months = src.transfer(spark, sf).select(F.trunc("date", "month").alias("month_start")).distinct()
    due = accounts.monthly_due_dates(months, 31, step=3, phase=2)
    return accounts.roll_to_business_day(due, "due_date")


NEAR = ["log_value", "deposit_share", "tenure", "age", "log_income", "log_salary", "log_bonus", "log_pension", "log_business"]
NEAR_RADIUS = 0.01


def _near_points(spark, sf):
    """Nine standardised dimensions of every household."""
    h = src.household(spark, sf)
    flags = F.concat_ws("|", *[F.col(c).cast("string") for c in HOUSEHOLD_FLAGS], F.col("segment"))
    log = lambda c: F.log1p(F.coalesce(c, F.lit(0.0)))
    values = [F.log("relationship_value"), F.col("deposit_balance") / F.col("relationship_value"), F.col("tenure_years"),
              F.col("age_primary"), log(profiles.recurring_income()), *[log(F.col(c)) for c in (
                  "salary_base_annual", "bonus_annual", "pension_monthly", "business_distribution_annual")]]
    rows = h.select("household_id", flags.alias("flags"), *[v.alias(n) for v, n in zip(values, NEAR)])
    return profiles.standardize(rows, NEAR, population=False)


@query("near_duplicate_join")
def near_duplicate_join(spark, sf):
    return near_duplicates.near_neighbours(_near_points(spark, sf), "household_id", NEAR, "flags", NEAR_RADIUS)


@query("near_duplicate_summary")
def near_duplicate_summary(spark, sf):
    return near_duplicates.near_duplicate_summary(near_duplicates.near_neighbours(
        _near_points(spark, sf), "household_id", NEAR, "flags", NEAR_RADIUS))


@query("nearest_distance", nearest=4)
def nearest_distance(spark, sf):
    """Exact distance of every household to its nearest neighbour with the same flags."""
    return nearest.nearest_distances(_near_points(spark, sf), "household_id", NEAR, "flags")


@query("nearest_distance_quantiles")
def nearest_distance_quantiles(spark, sf):
    """First percentile, median and least of those distances, near pairs, and the flag combinations."""
    points = _near_points(spark, sf)
    found = nearest.nearest_distances(points, "household_id", NEAR, "flags")
    combos = points.groupBy("flags").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("flag_combinations"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return nearest.distance_quantiles(found, NEAR_RADIUS).crossJoin(F.broadcast(combos))  # one row each


@query("align_index_agg", recent=2, earlier=2)
def align_index(spark, sf):
    t = src.transfer(spark, sf)
    recent = t.filter("day > -90").groupBy("household_id", "dest_id").agg(F.sum("amount").alias("recent"))
    earlier = t.filter("day <= -90").groupBy("household_id", "dest_id").agg(F.sum("amount").alias("earlier"))
    return recent.join(earlier, ["household_id", "dest_id"], "full")


# ---------------------------------------------------------------- aggregations
@query("group_count_max_min")
def group_count(spark, sf):
    return src.interaction(spark, sf).groupBy("household_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("day").alias("last_day"), F.min("day").alias("first_day"))


@query("count_distinct")
def count_distinct(spark, sf):
    return src.transfer(spark, sf).filter("dest_id >= 0").groupBy("household_id").agg(
        F.countDistinct("dest_id").alias("destinations"))


@query("bool_any_all")
def bool_any_all(spark, sf):
    return src.complaint(spark, sf).groupBy("household_id").agg(
        F.bool_or("out_of_sla").alias("any_late"), F.bool_and(F.col("status") == "closed").alias("all_closed"))


@query("median_agg", median_amount=4)
def median_agg(spark, sf):
    return ordering.exact_quantiles(src.transfer(spark, sf), "amount", {"median_amount": .5},
                                    ["category"])


@query("describe_percentiles", mean=4, std=4, p05=4, p25=4, p50=4, p75=4, p95=4)
def describe(spark, sf):
    return profiles.describe_percentiles(
        src.household(spark, sf), ["relationship_value", "deposit_balance", "aum", "age_primary",
                                   "tenure_years", "history_months"], DECILES)


@query("group_stats_by_category", total=2, median_amount=4)
def group_stats(spark, sf):
    t = src.transfer(spark, sf)
    sums = t.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total"))
    return sums.join(ordering.exact_quantiles(t, "amount", {"median_amount": .5}, ["category"]),
                     "category")


@query("segment_summary", median_value=4)
def segment_summary(spark, sf):
    e = _eligible(spark, sf)
    rates = e.groupBy("segment").agg(F.count(F.lit(1)).alias("households"),
                                     F.avg("hard_churn_6m").alias("hard_churn"),
                                     F.avg("soft_churn_3m").alias("soft_churn"))
    return rates.join(ordering.exact_quantiles(e, "relationship_value", {"median_value": .5},
                                               ["segment"]), "segment")


@query("flag_shares")
def flag_shares(spark, sf):
    flags = profiles.unpivot(src.household(spark, sf), ["segment"], HOUSEHOLD_FLAGS)
    return flags.groupBy("segment", "variable").agg(F.avg("value").alias("share"))


@query("decile_summary")
def decile_summary(spark, sf):
    e = _eligible(spark, sf).select("household_id", "relationship_value", "hard_churn_6m",
                                    "soft_churn_3m")
    deciles = ordering.equal_freq_buckets(e, "relationship_value", "household_id", 10, out="decile")
    return deciles.groupBy("decile").agg(F.count(F.lit(1)).alias("households"),
                                         F.avg("hard_churn_6m").alias("hard_churn"),
                                         F.avg("soft_churn_3m").alias("soft_churn"))


def _contributions(h):
    return h.select("*", (F.col("household_id") % 13 * 0.6).alias("outflow"),
                    (F.col("household_id") % 17 * 0.45).alias("neglect"),
                    (F.col("household_id") % 11 * 0.75).alias("service"))


@query("driver_mix")
def driver_mix(spark, sf):
    rows = _contributions(_eligible(spark, sf)).withColumn(
        "driver", profiles.primary_driver(["outflow", "neglect", "service"]))
    return rows.groupBy("driver").agg(F.count(F.lit(1)).alias("households"),
                                      F.avg("hard_churn_6m").alias("hard_churn"))


@query("logo_vs_value_churn")
def logo_vs_value(spark, sf):
    v, hard = F.col("relationship_value"), F.col("hard_churn_6m") == 1
    return _eligible(spark, sf).agg(
        F.avg("hard_churn_6m").alias("logo"),
        (F.sum(F.when(hard, v).otherwise(0.0)) / F.sum(v)).alias("value_share"),
        (F.sum(F.when(F.col("soft_churn_3m") == 1, F.col("value_lost_6m")).otherwise(0.0))
         / F.sum(v)).alias("soft_value_share"))


@query("crosstab")
def crosstab(spark, sf):
    return src.complaint(spark, sf).groupBy("category").pivot("status", ["open", "closed"]).count() \
        .na.fill(0)


@query("value_share")
def value_share(spark, sf):
    return profiles.value_share(src.household(spark, sf), "relationship_value", 0.05)


@query("portfolio_summary", total_value=2, median_value=4)
def portfolio_summary(spark, sf):
    h = src.household(spark, sf)
    median = ordering.exact_quantiles(h, "relationship_value", {"median_value": .5})
    return h.agg(F.count(F.lit(1)).alias("households"),
                 F.count_if(F.col("segment") == "UHNW").alias("uhnw"),
                 F.sum("relationship_value").alias("total_value"),
                 F.avg("hard_churn_6m").alias("hard_rate"), F.avg("soft_churn_3m").alias("soft_rate"),
                 F.count_if("churn_excluded").alias("excluded")).withColumn(
        "median_value", median.scalar())


@query("multi_signal_profile")
def multi_signal_profile(spark, sf):
    c = plan.composite_features(spark, sf).join(
        src.household(spark, sf).select("household_id", "hard_churn_6m"), "household_id")
    return c.groupBy("multi_signal_count").agg(
        F.count(F.lit(1)).alias("households"), F.avg("hard_churn_6m").alias("hard_churn"),
        *[F.avg(f"group_alert_{g}").alias(f"share_{g}") for g in ALERT_GROUPS])


@query("flag_combinations")
def flag_combinations(spark, sf):
    return profiles.flag_combinations(src.household(spark, sf))


@query("book_quality")
def book_quality(spark, sf):
    return profiles.book_quality(src.household(spark, sf), F.col("tenure_years") / 10)


@query("weighted_risk_index")
def weighted_risk_index(spark, sf):
    rows = _contributions(src.household(spark, sf))
    structural = (F.log1p("tenure_years") * -0.15 + F.col("has_credit_anchor").cast("int") * -0.2
                  + (F.col("segment") == "UHNW").cast("int") * 0.1)
    return profiles.weighted_index(rows, "household_id",
                                   {"outflow": .6, "neglect": .45, "service": .35}, structural)


@query("value_counts")
def value_counts(spark, sf):
    return profiles.value_counts(src.account(spark, sf).filter("close_reason IS NOT NULL"),
                                 "close_reason")


@query("collect_set_agg")
def collect_set(spark, sf):
    """Products held per household, as a sorted list of at most one entry per product."""
    held = src.account(spark, sf).groupBy("household_id", "product").agg(F.lit(1).alias("x"))
    return held.groupBy("household_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("product"))).alias("products"))


@query("exact_duplicates")
def exact_duplicates(spark, sf):
    return profiles.exact_duplicates(src.interaction(spark, sf), ["household_id", "date", "kind"])


@query("repeated_amounts")
def repeated_amounts(spark, sf):
    return profiles.repeated_amounts(src.household(spark, sf), [
        c for c in MONEY_COLUMNS if c != "recurring_income_monthly"])  # derived, not a column here


@query("seed_band_summary", p10=4, p50=4, p90=4, low=4, high=4)
def seed_band_summary(spark, sf):
    """Bands of a variable over many runs; here a run is a month of the panel."""
    runs = src.monthly(spark, sf).groupBy("month").agg(
        F.avg("deposit_avg_balance").alias("deposit"), F.avg("aum_month_end").alias("aum"))
    long = profiles.unpivot(runs, ["month"], ["deposit", "aum"])
    bands = ordering.exact_quantiles(long, "value", {"p10": .1, "p50": .5, "p90": .9}, ["variable"])
    return bands.join(long.groupBy("variable").agg(F.min("value").alias("low"),
                                                   F.max("value").alias("high")), "variable")


# ---------------------------------------------------------------- windows, sort, sets
@query("rank_average")
def rank_average(spark, sf):
    return ordering.average_ranks(src.scores(spark, sf), "score", ["model"]).select(
        "model", "score", F.col("_k").alias("ties"), "avg_rank")


@query("rank_first")
def rank_first(spark, sf):
    return ordering.row_ranks(src.scores(spark, sf).filter("model = 'expert'"), "score",
                              "household_id").select("household_id", "score", "row_rank")


@query("equal_freq_bucket")
def equal_freq_bucket(spark, sf):
    s = src.scores(spark, sf).select("household_id", "model", "score")
    return ordering.equal_freq_buckets(s, "score", "household_id", 7, ["model"])


@query("cumcount")
def cumcount(spark, sf):
    return accounts.account_number(src.account(spark, sf)).select("account_id", "account_n")


@query("partition_total", amount=2, key_sum=2, key_max=2)
def partition_total(spark, sf):
    rows = src.transfer(spark, sf).select("household_id", "day", "amount")
    return profiles.partition_total(rows, "household_id", "amount")


@query("cumulative_sum")
def cumulative_sum(spark, sf):
    totals = ordering.running_totals(src.scores(spark, sf), "score",
                                     {"n": F.lit(1), "pos": F.col("label")}, ["model"])
    above_pos = F.col("tot_pos") - F.col("lt_pos")
    return totals.select("model", "score", F.try_divide(above_pos, F.col("tot_pos")).alias("tpr"),
                         F.try_divide(F.col("tot_n") - F.col("lt_n") - above_pos,
                                      F.col("tot_n") - F.col("tot_pos")).alias("fpr"))


@query("cumulative_product_index")
def cumulative_product(spark, sf):
    run = Window.partitionBy("household_id").orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return src.monthly_return(spark, sf).select(
        "household_id", "month",
        F.exp(F.sum(F.log1p("portfolio_return")).over(run)).alias("index_value"))


@query("previous_value", previous=2)
def previous_value(spark, sf):
    order = Window.partitionBy("household_id").orderBy("month")
    return src.monthly(spark, sf).select("household_id", "month", F.lag("deposit_avg_balance")
                                         .over(order).alias("previous"))


@query("balanced_books")
def balanced_books(spark, sf):
    return profiles.balanced_books(src.household(spark, sf), "tenure_years", {"HNW": 60, "UHNW": 25})


@query("first_crossing")
def first_crossing(spark, sf):
    m = src.monthly(spark, sf)
    return m.groupBy("household_id").agg(
        F.min(F.when(F.col("deposit_avg_balance") < 10000, F.col("month"))).alias("first_low_month"))


@query("stable_sort", amount=2)
def stable_sort(spark, sf):
    return src.transfer(spark, sf).select(
        "household_id", "day", "category", "amount", "inst_id").orderBy(
        "household_id", "day", "category", "amount", "inst_id")


@query("head_n", total=2)
def head_n(spark, sf):
    return src.transfer(spark, sf).groupBy("inst_id").agg(F.sum("amount").alias("total")).orderBy(
        F.desc("total"), "inst_id").limit(15)


@query("union_all")
def union_all(spark, sf):
    parts = [src.interaction(spark, sf).select("household_id", "day", F.lit("interaction").alias("log")),
             src.complaint(spark, sf).select("household_id", F.col("open_day").alias("day"),
                                             F.lit("complaint").alias("log")),
             src.transfer(spark, sf).select("household_id", "day", F.lit("transfer").alias("log"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("log").agg(
        F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"))


@query("distinct_key")
def distinct_key(spark, sf):
    """First institution of each routing number of the ledger."""
    return src.transfer(spark, sf).filter("aba IS NOT NULL").groupBy("aba").agg(
        F.min("inst_id").alias("inst_id"))


@query("distinct_values")
def distinct_values(spark, sf):
    allowed = F.array(*[F.lit(c) for c in ["incoming", *EXTERNAL_OUT]])
    return src.transfer(spark, sf).select("category").distinct().filter(
        ~F.array_contains(allowed, F.col("category")))


@query("aba_checksum")
def aba_checksum(spark, sf):
    return src.transfer(spark, sf).filter("aba IS NOT NULL").select("aba").distinct().select(
        "aba", routing_is_valid("aba").alias("valid"))


# ---------------------------------------------------------------- reconciliation
def _identity(spark, sf):
    return ledger.ledger_identity(src.monthly(spark, sf), src.transfer(spark, sf),
                                  src.recurring_tx(spark, sf), src.household(spark, sf), P,
                                  F.col("household_id") % 4 / 10 + 0.2)


@query("ledger_identity", change=2, income=2, internal_in=2, internal_out=2, deposits_out=2)
def ledger_identity(spark, sf):
    return _identity(spark, sf)


@query("internal_flow_netting", internal_in=2)
def internal_flow_netting(spark, sf):
    return _identity(spark, sf).select("household_id", "month", "internal_in")


@query("unexplained_share", max_gap=3)
def unexplained_share(spark, sf):
    return ledger.unexplained_share(_identity(spark, sf))


@query("series_reconciles_flow", max_gap=3)
def series_reconciles(spark, sf):
    m = src.monthly(spark, sf)
    diff = m.groupBy("household_id").agg(
        (F.max(F.when(F.col("month") == 0, F.col("deposit_avg_balance")))
         - F.max(F.when(F.col("month") == -3, F.col("deposit_avg_balance")))).alias("difference"))
    flows = plan.balances(spark, sf).select("household_id", "net_deposit_flow_90d").filter(
        "net_deposit_flow_90d IS NOT NULL")
    return ledger.reconciles(flows, diff, ["household_id"], "net_deposit_flow_90d", "difference")


@query("twr_reconciles_returns")
def twr_reconciles(spark, sf):
    year = src.monthly_return(spark, sf).filter("month > -12")
    both = year.groupBy("household_id").agg(
        (F.product(F.col("portfolio_return") + 1) - 1).alias("product_return"),
        (F.exp(F.sum(F.log1p("portfolio_return"))) - 1).alias("index_return"))
    return ledger.reconciles(both, both, ["household_id"], "product_return", "index_return")


@query("counterfactual_rule")
def counterfactual_rule(spark, sf):
    """Alert rate and lift with each of six business rules on and off."""
    h = src.household(spark, sf)
    t, off = src.transfer(spark, sf), P.replace(new_destination_min_cumulative=10_000.0,
                                                 outflow_baseline_floor_monthly=1_000.0)
    seven, nine = F.col("external_transfer_pct_of_balance_60d") > 0.15, \
        F.col("investment_redemption_pct") > 0.20
    eight = F.col("new_external_destinations_90d") >= 1
    relabelled = ledger.relabel_excluded(t, EXCLUDED_PAYMENTS)
    effects = [
        ledger.rule_effect(plan.transfer_flows(spark, sf), h, "exclusions", "on", seven),
        ledger.rule_effect(plan.transfer_flows(spark, sf, ledger=relabelled), h, "exclusions", "off", seven),
        ledger.rule_effect(plan.transfer_flows(spark, sf), h, "destination_floor", "on", eight),
        ledger.rule_effect(plan.transfer_flows(spark, sf, off), h, "destination_floor", "off", eight),
        ledger.rule_effect(plan.portfolio(spark, sf), h, "rmd", "on", nine),
        ledger.rule_effect(plan.portfolio(spark, sf, count_rmd=True), h, "rmd", "off", nine)]
    fall, salary = F.col("recurring_deposit_change_pct") <= -0.30, F.col("salary_deposit_stopped_flag") == 1
    mortgage = F.col("bureau_new_mortgage_elsewhere") == 1
    detected = plan.recurring_flows(spark, sf)
    bonus_counts = plan.recurring_flows(spark, sf, plan.EVENT_PARAMS.replace(bonus_multiple=1e12))
    unreported = plan.recurring_flows(spark, sf, events=src.recurring_event(spark, sf).withColumns(
        {c: F.lit(False) for c in ("retire_reported", "leave_reported", "death_reported", "business_sale")}))
    effects += [
        ledger.rule_effect(detected, h, "bonus", "on", fall), ledger.rule_effect(bonus_counts, h, "bonus", "off", fall),
        ledger.rule_effect(detected, h, "reported_events", "on", salary),
        ledger.rule_effect(unreported, h, "reported_events", "off", salary),
        ledger.rule_effect(plan.bureau(spark, sf), h, "legal_clearance", "on", mortgage),
        ledger.rule_effect(plan.bureau(spark, sf, P.replace(legal_cleared=False)), h, "legal_clearance", "off", mortgage)]
    return reduce(lambda a, b: a.unionByName(b), effects)


# ---------------------------------------------------------------- labels
def churn(spark, sf):
    return labels.construct_churn(src.outcome(spark, sf), P)


@query("construct_hard_churn")
def hard_churn(spark, sf):
    return churn(spark, sf).select("household_id", "churn_hard_6m")


@query("construct_soft_churn")
def soft_churn(spark, sf):
    return churn(spark, sf).select("household_id", "churn_soft_3m")


@query("churn_labels", churn_value_lost=2, relationship_value_t=2, relationship_value_t6=2)
def churn_labels(spark, sf):
    return churn(spark, sf)


@query("value_at_risk", value_at_risk=2)
def value_at_risk(spark, sf):
    return churn(spark, sf).select("household_id", (F.col("relationship_value_t")
                                                    * F.col("churn_any")).alias("value_at_risk"))


@query("label_agreement")
def label_agreement(spark, sf):
    return labels.label_agreement(churn(spark, sf), src.household(spark, sf), "churn_soft_3m",
                                  "soft_churn_3m")


@query("stratified_split")
def stratified_split(spark, sf):
    rows = _eligible(spark, sf).select("household_id", "hard_churn_6m")
    return labels.stratified_split(rows, "hard_churn_6m", "household_id", P)
