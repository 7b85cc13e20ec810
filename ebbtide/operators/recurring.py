"""Recurring-stream detector and the stop variables (#3, #4, #5, #19, #20).

Two plans give the same rows: medians are half the sum of the two middle values and the spread of
the gaps is a function of whole-number sums in both.  Households of ordinary size take the *array plan*: one shuffle by
household, then every detector pass is array arithmetic on the payments of one stream.  Households
whose payments exceed a checked limit take the *relational plan*: payments are folded to one row
per distinct day before any ordering, so a stream that holds a third of the ledger has at most one
row per day of its look-back in the gap window, and amount medians use the block plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.contract import BUSINESS_PAYROLL, STREAM_PRIORITY
from ebbtide.functions.columns import flag_or_null, in_window, is_true, sum_when
from ebbtide.operators.lineage import cut_lineage
from ebbtide.operators.ordering import exact_medians
from ebbtide.params import AVG_MONTH_DAYS, Params


def drop_bonuses(payments: DataFrame, keys: Sequence[str], params: Params) -> DataFrame:
    """Remove credits above the bonus multiple of their stream median where ``bonus_rule`` is set."""
    keys = list(keys)
    medians = exact_medians(payments.filter("bonus_rule"), "amount", "_median", keys)
    bonus = F.col("bonus_rule") & (F.col("amount") > F.col("_median") * params.bonus_multiple)
    return payments.join(medians, keys, "left").filter(~is_true(bonus)).drop("_median")


def gap_statistics(payments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation and median of the gaps between sorted payment days."""
    keys = list(keys)
    by_day = payments.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("day")
    gap = F.col("day") - F.lag("day").over(order)
    # n payments on one day give n - 1 gaps of zero besides the gap to the previous day
    gaps = by_day.withColumn("gap", gap).select(
        *keys, "n", F.explode(F.array(
            F.struct(F.col("gap").alias("gap"), F.when(F.col("gap").isNotNull(), 1).otherwise(0)
                     .cast("long").alias("times"), F.lit(1).alias("first")),
            F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("times"),
                     F.lit(0).alias("first")))).alias("g"))
    size, times = F.col("g.gap").cast("double"), F.col("g.times")
    stats = gaps.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("g.first")).alias("payments"),
        F.sum(times).alias("gap_count"), F.sum(size * times).alias("_s1"),
        F.sum(size * size * times).alias("_s2"),
        F.percentile(size, F.lit(0.5), times).alias("interval"))
    mean = F.try_divide(F.col("_s1"), F.col("gap_count"))
    return stats.select(*keys, "payments", "gap_count", mean.alias("gap_mean"),
                        gap_variation(F.col("gap_count"), F.col("_s1"), F.col("_s2")).alias("gap_cv"),
                        F.try_divide(F.sqrt(F.greatest(F.col("gap_count") * F.col("_s2") - F.col("_s1") * F.col("_s1"),
                                                       F.lit(0.0))), F.col("gap_count")).alias("gap_std"),
                        F.when(F.col("gap_count") > 0, F.col("interval")).alias("interval"))


def gap_variation(count: Column, total: Column, squares: Column) -> Column:
    """Deviation over mean of whole-day gaps.

    The sums are whole numbers, so they are exact in any order and both plans decide alike.
    """
    return F.try_divide(F.sqrt(F.greatest(count * squares - total * total, F.lit(0.0))), total)


def detect_recurring(payments: DataFrame, keys: Sequence[str], params: Params) -> DataFrame:
    """Pattern per key over ``(end - length, end]``.

    ``payments`` carries day, amount, end, length and bonus_rule.  A pattern exists with enough
    payments and a coefficient of variation of the gaps under the limit.
    """
    keys = list(keys)
    inside = payments.filter(in_window("day", F.col("end") - F.col("length"), F.col("end")))
    regular = drop_bonuses(inside, keys, params)
    gaps = gap_statistics(regular, keys)
    medians = exact_medians(regular, "amount", "median_amount", keys)
    found = (F.col("payments") >= params.min_occurrences) & is_true(F.col("gap_cv") < params.cv_max)
    return gaps.join(medians, keys).select(
        *keys, "payments", found.alias("exists"), "interval", "median_amount")


def last_credit(payments: DataFrame, keys: Sequence[str], cap: Column | None = None) -> DataFrame:
    counted = F.lit(True) if cap is None else is_true(F.col("amount") <= cap)
    return payments.groupBy(*keys).agg(F.max(F.when(counted, F.col("day"))).alias("last_day"))


def stop_threshold(interval: Column, params: Params) -> Column:
    return F.greatest(F.lit(float(params.stop_days_min)),
                      F.coalesce(interval, F.lit(params.default_interval))
                      * params.stop_interval_multiple)


KEYS = ["household_id", "case", "stream"]


def _cases(params: Params) -> Column:
    """Evaluation cases of a payment: which look-back, end and bonus rule apply to its stream."""
    stream = F.col("stream")
    pay, flows = stream.isin("payroll", "payroll_new"), stream.isin(*STREAM_PRIORITY)
    business = stream == BUSINESS_PAYROLL

    def case(applies: Column, name: str, length: int, end: int) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("case"), F.lit(length).alias("length"),
                                        F.lit(-float(end)).alias("end")))

    cases = F.array(
        case(pay, "salary", params.payroll_lookback_days, params.stop_days_min),
        case(flows, "flows", params.recurring_lookback_days, params.stop_days_min),
        case(flows, "change", params.recurring_lookback_days, params.change_gap_days),
        case(business, "business", params.payroll_lookback_days, params.business_stop_days))
    return F.filter(cases, lambda c: c.isNotNull())


def expand_cases(ledger: DataFrame, params: Params) -> DataFrame:
    """Payments once per evaluation case; bonuses join the payroll stream they belong to."""
    family = F.when(F.col("stream") == "bonus", "payroll").otherwise(F.col("stream"))
    return (ledger.select("household_id", family.alias("stream"), "day", "amount")
                  .withColumn("bonus_rule", F.col("stream") == "payroll")
                  .select("household_id", "stream", "day", "amount", "bonus_rule",
                          F.explode(_cases(params)).alias("c"))
                  .select("household_id", "c.case", "stream", "day", "amount", "bonus_rule",
                          "c.length", "c.end"))


def evaluate_stops(ledger: DataFrame, params: Params) -> DataFrame:
    """One row per (household, case, stream): pattern, stop decision, interval, median, last day."""
    payments = expand_cases(ledger, params)
    first = cut_lineage(detect_recurring(payments, KEYS, params))
    two_pass = F.col("case").isin("salary", "flows")
    thresholds = payments.filter(two_pass).select(*KEYS).distinct().join(
        first.select(*KEYS, "interval"), KEYS, "left").select(
        *KEYS, (-stop_threshold(F.col("interval"), params)).alias("end"))
    again = payments.filter(two_pass).drop("end").join(thresholds, KEYS)
    second = detect_recurring(again, KEYS, params).join(thresholds, KEYS)
    single = first.filter(~two_pass).withColumn("end", F.when(
        F.col("case") == "change", -float(params.change_gap_days)).otherwise(-float(params.business_stop_days)))
    patterns = cut_lineage(second.unionByName(single))
    capped = payments.join(patterns.select(*KEYS, "median_amount"), KEYS)
    cap = F.when(F.col("bonus_rule"), F.col("median_amount") * params.bonus_multiple) \
           .otherwise(F.lit(float("inf")))
    last = last_credit(capped, KEYS, cap)
    return patterns.join(last, KEYS, "left").select(
        *KEYS, "exists", "interval", "median_amount", "last_day",
        (F.col("exists") & F.coalesce(F.col("last_day") <= F.col("end"), F.lit(True)))
        .alias("stopped"))


def payroll_replacement(ledger: DataFrame, stops: DataFrame, params: Params) -> DataFrame:
    """Households whose old payroll is replaced by a new originator paying at least half of it."""
    old = stops.filter((F.col("case") == "salary") & (F.col("stream") == "payroll"))
    fresh = ledger.filter(F.col("stream") == "payroll_new").select("household_id", "day", "amount")
    later = F.coalesce(F.col("day") > F.col("last_day"), F.lit(True))
    enough = is_true(F.col("amount") >= F.col("median_amount") * params.replacement_min_ratio)
    return (fresh.join(old.select("household_id", "last_day", "median_amount"), "household_id")
                 .groupBy("household_id").agg(F.bool_or(later & enough).alias("replaced")))


def stream_weights(stops: DataFrame) -> DataFrame:
    """Monthly equivalent of each detected stream and its share of the household total."""
    flows = stops.filter(F.col("case") == "flows").withColumn(
        "monthly_equivalent",
        F.when(F.col("exists"), F.try_divide(F.col("median_amount") * AVG_MONTH_DAYS,
                                             F.col("interval"))).otherwise(0.0))
    total = F.sum("monthly_equivalent").over(Window.partitionBy("household_id"))
    return flows.withColumn("total_equivalent", total).withColumn(
        "weight", F.coalesce(F.try_divide(F.col("monthly_equivalent"), total), F.lit(0.0)))


def stopped_streams(weights: DataFrame, events: DataFrame, replaced: DataFrame,
                    params: Params) -> DataFrame:
    """Flow flag and type per household: the first stopped stream in the fixed order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STREAM_PRIORITY]), F.col("stream"))
    stream = F.col("stream")
    reported = F.col("retire_reported") | F.col("leave_reported") | F.col("death_reported")
    excluded = (F.when(stream == "payroll", reported | is_true(F.col("replaced")))
                 .when(stream == "payroll_new", reported)
                 .when(stream == "business_distribution",
                       F.col("death_reported") | F.col("business_sale"))
                 .otherwise(F.col("death_reported")))
    hit = (F.col("stopped") & (F.col("weight") >= params.min_stream_weight) & ~is_true(excluded))
    rows = weights.join(events, "household_id", "left").join(replaced, "household_id", "left")
    name = F.regexp_replace(stream, "_new$", "")
    return rows.groupBy("household_id").agg(
        F.max("total_equivalent").alias("total_equivalent"), F.bool_or(hit).alias("any_stop"),
        F.min_by(F.when(hit, name), F.when(hit, rank)).alias("stopped_type"))


def change_sums(ledger: DataFrame, stops: DataFrame, params: Params) -> DataFrame:
    """Recent and baseline monthly income over the streams that had a pattern before the gap."""
    known = stops.filter((F.col("case") == "change") & F.col("exists"))
    payments = expand_cases(ledger, params).filter(F.col("case") == "change")
    quarterly = F.col("interval") > params.quarterly_interval_days
    capped = ~F.col("bonus_rule") | (F.col("amount") <= F.col("median_amount")
                                     * params.bonus_multiple)
    recent = F.when(quarterly, in_window("day", -params.quarterly_window_days)) \
              .otherwise(in_window("day", -params.change_gap_days))
    baseline = in_window("day", -params.change_baseline_days, -params.change_gap_days)
    scaled = F.when(quarterly, F.col("amount") / 3).otherwise(F.col("amount"))
    joined = payments.join(known.select(*KEYS, "interval", "median_amount"), KEYS)
    return joined.groupBy("household_id").agg(
        sum_when(is_true(capped) & recent, scaled).alias("recent"),
        (sum_when(is_true(capped) & baseline, "amount") / params.change_baseline_months)
        .alias("baseline"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression: a transform over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _array_median(values: Column) -> Column:
    def middle(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        return (F.get(ordered, F.floor(last / 2).cast("int"))
                + F.get(ordered, F.ceil(last / 2).cast("int"))) / 2.0
    return _let(F.array_sort(values), middle)


def _pattern(end: Column, params: Params) -> Column:
    """Struct (interval, median_amount, exists) of the payment array over (end - length, end]."""
    bonus = F.col("bonus_rule")

    def decide(regular: Column, gaps: Column) -> Column:
        count, steps = F.size(regular), F.size(gaps)
        spread = gap_variation(steps, F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g),
                               F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g))
        found = (count >= params.min_occurrences) & is_true(spread < params.cv_max)
        return F.struct(_array_median(gaps).alias("interval"),
                        _array_median(F.transform(regular, lambda p: p.amount))
                        .alias("median_amount"), found.alias("exists"))

    def gaps_of(days: Column) -> Column:
        steps = F.greatest(F.size(days) - 1, F.lit(0))
        return F.zip_with(F.slice(days, 2, steps), F.slice(days, 1, steps), lambda b, a: b - a)

    def regular_of(inside: Column) -> Column:
        usual = F.when(bonus, _array_median(F.transform(inside, lambda p: p.amount)))
        return _let(usual, lambda u: F.when(bonus, F.filter(
            inside, lambda p: p.amount <= u * params.bonus_multiple)).otherwise(inside))

    def from_end(last: Column) -> Column:
        inside = F.filter("payments", lambda p: (p.day > last - F.col("length")) & (p.day <= last))
        return _let(_let(inside, regular_of), lambda reg: _let(
            gaps_of(F.array_sort(F.transform(reg, lambda p: p.day))),
            lambda gaps: decide(reg, gaps)))

    return _let(end, from_end)


def _array_sum(payments: str, keep, value) -> Column:
    return F.aggregate(F.filter(payments, keep), F.lit(0.0), lambda acc, p: acc + value(p))


def array_stops(ledger: DataFrame, params: Params) -> DataFrame:
    """Rows of `evaluate_stops` plus recent / baseline sums, from one shuffle by household."""
    rows = (expand_cases(ledger.repartition("household_id"), params)
            .groupBy(*KEYS, "bonus_rule", "length", "end")
            .agg(F.collect_list(F.struct(F.col("day"), F.col("amount"))).alias("payments")))
    two_pass = F.col("case").isin("salary", "flows")
    first = rows.withColumn("first", _pattern(F.col("end"), params))
    known = first.withColumn("end", F.when(two_pass, -stop_threshold(F.col("first.interval"), params))
                             .otherwise(F.col("end")))
    known = known.withColumn("p", F.when(two_pass, _pattern(F.col("end"), params))
                             .otherwise(F.col("first")))
    cap = F.col("p.median_amount") * params.bonus_multiple
    known = known.withColumn("counted", F.filter(
        "payments", lambda p: ~F.col("bonus_rule") | is_true(p.amount <= cap)))
    last_day = F.array_max(F.transform("counted", lambda p: p.day))
    quarterly = F.col("p.interval") > params.quarterly_interval_days
    reach = F.when(quarterly, params.quarterly_window_days).otherwise(params.change_gap_days)
    recent = _array_sum("counted", lambda p: (p.day > -reach) & (p.day <= 0), lambda p: p.amount)
    baseline = _array_sum("counted", lambda p: in_window(p.day, -params.change_baseline_days,
                                                         -params.change_gap_days),
                          lambda p: p.amount)
    change = (F.col("case") == "change") & F.col("p.exists")
    return known.select(
        *KEYS, F.col("p.exists").alias("exists"), F.col("p.interval").alias("interval"),
        F.col("p.median_amount").alias("median_amount"), last_day.alias("last_day"), "payments",
        (F.col("p.exists") & F.coalesce(last_day <= F.col("end"), F.lit(True))).alias("stopped"),
        F.when(change, recent / F.when(quarterly, 3).otherwise(1)).alias("recent"),
        F.when(change, baseline / params.change_baseline_months).alias("baseline"))


def _case_folds() -> list[Column]:
    """Per-household view of the decisions that need no weight."""
    def over(case: str, streams: list[str], what: str) -> Column:
        chosen = (F.col("case") == case) & F.col("stream").isin(*streams)
        return F.coalesce(F.bool_or(F.when(chosen, F.col(what))), F.lit(False))

    pensions = ["pension", "pension_new"]
    return [over("salary", ["payroll", "payroll_new"], "exists").alias("pay_known"),
            over("salary", ["payroll"], "stopped").alias("old_pay_stopped"),
            over("salary", ["payroll_new"], "stopped").alias("new_pay_stopped"),
            over("flows", pensions, "exists").alias("pension_known"),
            over("flows", pensions, "stopped").alias("pension_stopped"),
            over("business", [BUSINESS_PAYROLL], "exists").alias("business_known"),
            over("business", [BUSINESS_PAYROLL], "stopped").alias("business_stopped")]


def _array_plan(ledger: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    """All decisions per household: one fold of its at most thirteen stream rows."""
    stops = array_stops(ledger, params)
    salary = F.col("case") == "salary"
    old, fresh = salary & (F.col("stream") == "payroll"), salary & (F.col("stream") == "payroll_new")
    equivalent = F.when((F.col("case") == "flows") & F.col("exists"), F.try_divide(
        F.col("median_amount") * AVG_MONTH_DAYS, F.col("interval")))
    flow = F.struct("stream", F.col("stopped").alias("stopped"), equivalent.alias("equivalent"))
    folded = stops.groupBy("household_id").agg(
        *_case_folds(), F.sum("recent").alias("recent"), F.sum("baseline").alias("baseline"),
        F.max(F.when(old, F.col("last_day"))).alias("old_last"),
        F.max(F.when(old, F.col("median_amount"))).alias("old_median"),
        F.first(F.when(fresh, F.col("payments")), ignorenulls=True).alias("fresh"),
        F.coalesce(F.sum(equivalent), F.lit(0.0)).alias("total_equivalent"),
        F.collect_list(F.when(F.col("case") == "flows", flow)).alias("flows"))
    replaces = lambda p: (F.coalesce(p.day > F.col("old_last"), F.lit(True))
                          & is_true(p.amount >= F.col("old_median") * params.replacement_min_ratio))
    joined = folded.join(events, "household_id", "left").withColumn(
        "replaced", is_true(F.exists("fresh", replaces)))
    reported = F.col("retire_reported") | F.col("leave_reported") | F.col("death_reported")
    excluded = {"payroll": reported | F.col("replaced"), "payroll_new": reported,
                "business_distribution": F.col("death_reported") | F.col("business_sale")}

    def hit(stream: str) -> Column:
        heavy = lambda f: ((f.stream == stream) & f.stopped & is_true(
            F.try_divide(f.equivalent, F.col("total_equivalent")) >= params.min_stream_weight))
        return F.exists("flows", heavy) & ~is_true(excluded.get(stream, F.col("death_reported")))

    first_stop = F.coalesce(*[F.when(hit(s), F.lit(s.removesuffix("_new")))
                              for s in STREAM_PRIORITY])
    return (joined.withColumn("stopped_type", first_stop)
                  .withColumn("any_stop", F.col("stopped_type").isNotNull())
                  .select(*DECISIONS))


DECISIONS = ["household_id", "retire_reported", "leave_reported", "death_reported",
             "business_sale", "pay_known", "old_pay_stopped", "new_pay_stopped", "pension_known",
             "pension_stopped", "business_known", "business_stopped", "replaced",
             "total_equivalent", "any_stop", "stopped_type", "recent", "baseline"]


def _relational_plan(ledger: DataFrame, events: DataFrame, params: Params) -> DataFrame:
    stops = evaluate_stops(ledger, params)
    replaced = payroll_replacement(ledger, stops, params)
    wide = stops.groupBy("household_id").agg(*_case_folds())
    flows = stopped_streams(stream_weights(stops), events, replaced, params)
    for part in (events, replaced, flows, change_sums(ledger, stops, params)):
        wide = wide.join(part, "household_id", "left")
    return wide.withColumn("replaced", is_true(F.col("replaced"))).select(*DECISIONS)


# Payments per household up to which one household fits comfortably in one row of arrays.
ARRAY_PLAN_PAYMENTS = 200_000


def by_size(ledger: DataFrame, limit: int = ARRAY_PLAN_PAYMENTS) -> tuple[DataFrame, DataFrame | None]:
    """The ledger of the households with up to ``limit`` payments, and that of the others, if any."""
    hot = cut_lineage(ledger.groupBy("household_id").count().filter(F.col("count") > limit).select("household_id"))
    if hot.isEmpty():
        return ledger, None
    return ledger.join(hot, "household_id", "left_anti"), ledger.join(hot, "household_id", "left_semi")


def stream_stops(ledger: DataFrame, params: Params, limit: int = ARRAY_PLAN_PAYMENTS) -> DataFrame:
    """Pattern and stop decision of every (household, case, stream), whatever the size of a household."""
    columns = [*KEYS, "exists", "interval", "median_amount", "last_day", "stopped"]
    usual, heavy = by_size(ledger, limit)
    rows = array_stops(usual, params).select(*columns)
    return rows if heavy is None else rows.unionByName(evaluate_stops(heavy, params).select(*columns))


def recurring_decisions(ledger: DataFrame, events: DataFrame, params: Params,
                        limit: int = ARRAY_PLAN_PAYMENTS) -> DataFrame:
    """Array plan below the checked payment limit, relational plan for the households above it."""
    usual, heavy = by_size(ledger, limit)
    rows = _array_plan(usual, events, params)
    return rows if heavy is None else rows.unionByName(_relational_plan(heavy, events, params))


def recurring_variables(ledger: DataFrame, events: DataFrame, household: DataFrame,
                        params: Params, limit: int = ARRAY_PLAN_PAYMENTS) -> DataFrame:
    wide = household.select("household_id").join(
        recurring_decisions(ledger, events, params, limit), "household_id", "left")
    reported = F.col("retire_reported") | F.col("leave_reported") | F.col("death_reported")
    death, sale = is_true(F.col("death_reported")), is_true(F.col("business_sale"))
    any_flow = is_true(F.col("total_equivalent") > 0)
    salary = ((F.col("old_pay_stopped") & ~is_true(F.col("replaced")))
              | F.col("new_pay_stopped")) & ~is_true(reported)
    return wide.select(
        "household_id",
        flag_or_null(is_true(F.col("pay_known")), salary).alias("salary_deposit_stopped_flag"),
        flag_or_null(any_flow, F.col("any_stop")).alias("recurring_deposit_stopped_flag"),
        F.when(any_flow & is_true(F.col("any_stop")), F.col("stopped_type"))
         .alias("recurring_deposit_stopped_type"),
        F.when(F.col("baseline") > 0, F.col("recent") / F.col("baseline") - 1)
         .alias("recurring_deposit_change_pct"),
        flag_or_null(is_true(F.col("pension_known")), F.col("pension_stopped") & ~death)
         .alias("pension_deposit_stopped_flag"),
        flag_or_null(is_true(F.col("business_known")), F.col("business_stopped") & ~sale & ~death)
         .alias("business_payroll_stopped_flag"))
