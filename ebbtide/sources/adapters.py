"""Canonical attrition tables derived from the star-schema parquet files.

Each function reads only the columns it needs, so projections and date ranges reach the scan.
Amounts are truncated to whole cents, which keeps sums exact to the cent.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.columns import as_flag, day_offset, month_of, routing_check_digit
from ebbtide.operators.accounts import complaint_lifecycle
from ebbtide.plans.memo import plan_memo

SNAPSHOT = datetime.date(1999, 12, 31)
EVENT_SNAPSHOT = datetime.date(2024, 1, 30)
FIRST_MONTH, LAST_MONTH = -23, 6
#: Households whose months one task lays out.
PANEL_HOUSEHOLDS = 25_000

# SLA days on the one-month event history.
EVENT_SLA_DAYS = {"fees_pricing": 7, "process_delay": 10, "banker_attention": 5, "digital": 5,
                  "transfers_wires": 5, "statement_error": 6, "investment_performance": 10,
                  "fraud_dispute": 15}
# Detector settings scaled to the one-month event history.
EVENT_DETECTOR = dict(cv_max=0.97, payroll_lookback_days=30, recurring_lookback_days=30,
                      stop_days_min=2, default_interval=2.0, business_stop_days=4,
                      change_gap_days=7, change_baseline_days=28, change_baseline_months=3.0,
                      quarterly_interval_days=6.0, quarterly_window_days=14)


# Declared schemas: no inference job per read.
SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int) -> Column:
    return F.col(column) % n


def _truncate_cents(value: Column) -> Column:
    return F.floor(value * 100) / 100


def _day_range(date_column: str, first: int, last: int) -> Column:
    """Timestamp bounds written as literals so that parquet row groups can be skipped."""
    start = datetime.datetime.combine(SNAPSHOT, datetime.time()) + datetime.timedelta(days=first)
    stop = datetime.datetime.combine(SNAPSHOT, datetime.time()) + datetime.timedelta(days=last + 1)
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")
    return (F.col(date_column) >= low) & (F.col(date_column) < high)


@plan_memo
def household(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, balance = F.col("household_id"), F.abs(F.col("c_acctbal"))
    invests = _mod("household_id", 7) != 0
    base = (c.select(F.col("c_custkey").alias("household_id"), "c_acctbal",
                     F.col("c_nationkey").alias("banker_id"))
             .withColumn("relationship_value",
                         F.round(balance * 20 + (key % 97 + 1) * 1000, 2))
             .withColumn("deposit_balance",
                         F.when(invests, F.floor(F.col("relationship_value") * 25) / 100)
                          .otherwise(F.col("relationship_value")))
             .withColumn("aum", F.when(invests, F.round(F.col("relationship_value")
                                                        - F.col("deposit_balance"), 2)))
             .withColumn("age_primary", ((key * 7 + F.col("banker_id")) % 67 + 28).cast("int"))
             .withColumn("salary_base_annual",
                         F.when(key % 5 < 3, F.round(balance * 40 + 150000, 2)))
             .withColumn("churn_excluded", _mod("household_id", 150) == 0))
    hard = as_flag(F.col("c_acctbal") < -350)
    soft = as_flag((F.col("c_acctbal") >= 0) & (F.col("c_acctbal") < 1000))
    eligible = ~F.col("churn_excluded")
    return base.select(
        "household_id", F.lit(SNAPSHOT).alias("snapshot_date"),
        F.when(F.col("c_acctbal") >= 8000, "UHNW").otherwise("HNW").alias("segment"),
        "relationship_value", "deposit_balance", "aum",
        invests.alias("has_investments"), (invests & (key % 10 < 7)).alias("has_advisory"),
        (key % 4 == 0).alias("has_linked_business"), (key % 3 == 0).alias("has_trust"),
        (key % 20 < 7).alias("has_credit_anchor"), (key % 5 < 3).alias("has_payroll_stream"),
        (key % 5 == 3).alias("has_pension_stream"),
        (invests & (key % 2 == 0)).alias("has_dividend_stream"),
        "age_primary",
        F.least((key % 300) / 10, F.greatest(F.col("age_primary") - 18.0, F.lit(0.5)),
                F.lit(50.0)).alias("tenure_years"),
        F.least(F.lit(24), key % 40 + 1).cast("int").alias("history_months"),
        "salary_base_annual",
        F.when(key % 5 < 3, F.when(key % 8 == 0, F.lit(0.0)).otherwise(
            F.floor(F.col("salary_base_annual") * (key % 50 + 10)) / 100)).alias("bonus_annual"),
        F.when(key % 5 == 3, F.round(balance + 2500, 2)).alias("pension_monthly"),
        F.when(invests & (key % 2 == 0), F.floor(F.col("aum") * 2) / 100).alias("dividend_annual"),
        F.when(key % 4 == 0, F.round(balance * 50 + 1000, 2)).alias("business_distribution_annual"),
        F.when(key % 5 < 3, F.element_at(F.array(F.lit("biweekly"), F.lit("semimonthly"),
                                                 F.lit("monthly")), (key % 3 + 1).cast("int")))
         .alias("pay_frequency"),
        "banker_id", "churn_excluded",
        F.when(eligible, hard).alias("hard_churn_6m"), F.when(eligible, soft).alias("soft_churn_3m"),
        F.when(eligible, F.when(hard == 1, F.col("relationship_value"))
               .when(soft == 1, F.floor(F.col("relationship_value") * 30) / 100)
               .otherwise(0.0)).alias("value_lost_6m"))


@plan_memo
def institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    kind = (F.when(F.col("s_nationkey") < 5, "private_bank")
             .when(F.col("s_nationkey") < 12, "regional_bank")
             .when(F.col("s_nationkey") < 20, "title_escrow").otherwise("broker_wealth"))
    return s.select(F.col("s_suppkey").alias("inst_id"), kind.alias("inst_type"),
                    (F.col("s_nationkey") < 12).alias("competitor_bank"),
                    (F.col("s_nationkey") >= 20).alias("broker_wealth"))


def _routing_number(inst: Column, slot: Column) -> Column:
    first = F.lpad((inst * 2 + slot).cast("string"), 8, "0")
    return F.concat(first, routing_check_digit(first).cast("string"))


@plan_memo
def institution_aba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One routing number per institution, two for the even ones."""
    inst = institution(spark, sf_dir).select("inst_id")
    slots = F.when(F.col("inst_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    rows = inst.select("inst_id", F.explode(slots).alias("slot"))
    return rows.select(_routing_number(F.col("inst_id"), F.col("slot")).alias("aba"), "inst_id")


@plan_memo
def _ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(_day_range("l_shipdate", -547, 0))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                 .withColumn("date", F.to_date("l_shipdate"))
                 .withColumn("day", day_offset("date", F.lit(SNAPSHOT))))


@plan_memo
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    category = (F.when(line == 1, "background").when(line == 2, "incoming").when(line == 3, "biller")
                 .when(line == 4, "move_acats").when(line == 5, "one_off")
                 .when(line == 6, "move_deposit").otherwise("irs_tax"))
    has_institution = ~line.isin(3, 7)
    slot = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_orderkey") % 2).otherwise(0)
    return _ledger_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("household_id"), "date", "day", category.alias("category"),
        F.round("l_extendedprice", 2).alias("amount"),
        F.when(has_institution, F.col("l_suppkey")).otherwise(F.lit(-1)).alias("inst_id"),
        F.when(has_institution, F.col("l_partkey") % 50).otherwise(F.lit(-1)).alias("dest_id"),
        F.when(has_institution, _routing_number(F.col("l_suppkey"), slot)).alias("aba"))


@plan_memo
def portfolio_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    kind = (F.when((flag == "A") & (line <= 2), "liq").when((flag == "A") & (line <= 4), "prop")
             .when(flag == "A", "fsale").when(flag == "N", "mat")
             .when(line == 7, "rmd").otherwise("reinv"))
    return _ledger_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("household_id"), kind.alias("kind"), "day",
        _truncate_cents(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("amount"),
        (F.col("l_discount") * 5).alias("full_share"))


@plan_memo
def monthly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household x month panel -23..6.

    Month flows are summed first.  A household has a row that opens the panel and one for each month
    with flows; each stands for the months up to the next one, so the sums run over these rows only
    and the panel is laid out last.  The number of partitions follows the households, so that a task
    lays out a bounded part of the panel.
    """
    customers = table(spark, sf_dir, "customer")
    parts = max(spark.sparkContext.defaultParallelism, -(-customers.count() // PANEL_HOUSEHOLDS))
    opening = customers.select(
        F.col("c_custkey").alias("household_id"), F.abs(F.col("c_acctbal")).alias("balance"),
        F.lit(FIRST_MONTH).alias("start"), F.lit(0.0).alias("signed"), F.lit(0.0).alias("contrib"),
        F.lit(0.0).alias("withdraw"))
    amount = F.floor(F.col("o_totalprice") * 10) / 100
    flows = (table(spark, sf_dir, "orders").filter(_day_range("o_orderdate", -730, 182))
             .select(F.col("o_custkey").alias("household_id"),
                     F.lit(None).cast("double").alias("balance"),
                     month_of(day_offset(F.to_date("o_orderdate"), F.lit(SNAPSHOT))).alias("start"),
                     F.when(F.col("o_orderkey") % 2 == 0, amount).otherwise(-amount).alias("signed"),
                     F.when(F.col("o_orderpriority") == "1-URGENT", amount).otherwise(0.0)
                      .alias("contrib"),
                     F.when(F.col("o_orderpriority") == "2-HIGH", amount).otherwise(0.0)
                      .alias("withdraw"))
             .filter(F.col("start").between(FIRST_MONTH, LAST_MONTH)))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("household_id", "start").agg(
            F.max("balance").alias("balance"),
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("signed", "contrib", "withdraw")])

    rows = summed(opening.unionByName(summed(flows)).repartition(parts, "household_id"))
    household = Window.partitionBy("household_id").orderBy("start")
    run = household.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The opening row is a household's first and alone has the balance.
    balance = F.first("balance").over(run)
    invests = _mod("household_id", 7) != 0
    net = F.sum(F.col("contrib") - F.col("withdraw")).over(run)
    history = F.least(F.lit(24), F.col("household_id") % 40 + 1)
    runs = rows.withColumn("known", balance).select(
        "household_id", "known", "start", "contrib", "withdraw",
        F.sequence("start", F.lead("start", 1, LAST_MONTH + 1).over(household) - 1).alias("months"),
        F.round(F.greatest(F.lit(500.0), F.col("known") * 5 + F.sum("signed").over(run)), 2)
         .alias("deposit_avg_balance"),
        F.when(invests, F.round(F.col("known") * 10 + 20000.0 + F.greatest(F.lit(0.0), net), 2))
         .alias("aum_month_end"))
    panel = runs.filter(F.col("known").isNotNull()).withColumn("month", F.explode("months"))
    own = lambda c: F.when(invests & (F.col("month") == F.col("start")), F.round(c, 2)).otherwise(0.0)
    return panel.select(
        "household_id", "month", "deposit_avg_balance", "aum_month_end",
        own("contrib").alias("aum_contributions"), own("withdraw").alias("aum_withdrawals"),
        (F.lit(1.0) + (F.col("month") + 23) * 4 / 1000).alias("twr_index"),
        (F.col("month") > -history).alias("available"))


@plan_memo
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_all(spark, sf_dir).filter(F.col("month") <= 0)


@plan_memo
def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = monthly_all(spark, sf_dir).filter(F.col("month") >= 0)
    return panel.select("household_id", F.col("month").alias("k"),
                        F.col("deposit_avg_balance").alias("deposit"),
                        F.coalesce("aum_month_end", F.lit(0.0)).alias("aum"),
                        F.col("twr_index").alias("twr"),
                        (_mod("household_id", 150) == 0).alias("excluded"))


@plan_memo
def _household_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id",
                    F.explode(F.sequence(F.lit(FIRST_MONTH), F.lit(0))).alias("month")))


@plan_memo
def monthly_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ((F.col("household_id") * 31 + (F.col("month") + 23) * 17) % 95) / 100
    return _household_months(spark, sf_dir).withColumn("cash_pct", share)


@plan_memo
def monthly_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, m = F.col("household_id"), F.col("month") + 23
    return _household_months(spark, sf_dir).select(
        "household_id", "month", (((key + m * 7) % 21 - 10) / 500).alias("portfolio_return"),
        ((m * 13 % 17 - 8) / 400).alias("market_return"),
        (key % 70 / 100 + 0.3).alias("equity_share"))


@plan_memo
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .select("event_id", F.col("user_id").alias("household_id"), "event_type", "value",
                    F.to_date("ts").alias("date"),
                    F.get_json_object("props", "$.k").cast("int").alias("k"))
            .withColumn("day", day_offset("date", F.lit(EVENT_SNAPSHOT))))


@plan_memo
def recurring_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, kind = F.col("household_id") % 2 == 0, F.col("event_type")
    nine = F.col("k") % 10 == 9
    stream = (F.when(kind == "click", F.when(nine, "payroll_new").otherwise("payroll"))
               .when(kind == "signup", F.when(even, "bonus").otherwise("payroll_new"))
               .when(kind == "purchase", F.when(nine, "pension_new").otherwise("pension"))
               .when(kind == "view", F.when(even, "dividend").otherwise("business_distribution"))
               .otherwise("business_payroll"))
    debit = kind == "error"
    return _events(spark, sf_dir).select(
        "household_id", "date", "day", stream.alias("stream"),
        F.when(debit, "debit").otherwise("credit").alias("direction"),
        F.when(debit, "CCD").otherwise("PPD").alias("sec_code"), F.col("value").alias("amount"))


@plan_memo
def recurring_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("household_id")
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id", (key % 29 == 0).alias("retire_reported"),
                    (key % 31 == 0).alias("leave_reported"),
                    (key % 150 == 0).alias("death_reported"),
                    (key % 37 == 0).alias("business_sale")))


@plan_memo
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    mapped = (F.when(kind == "click", "call").when(kind == "view", "email")
               .when(kind == "signup", "message").when(kind == "purchase", "meeting")
               .otherwise("meeting_cancelled_by_client"))
    return _events(spark, sf_dir).select(
        "household_id", "date", "day", mapped.alias("kind"),
        (F.col("k") % 2 == 0).alias("replied_7d"), (F.col("value") / 10).alias("minutes"))


@plan_memo
def complaint_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in EVENT_SLA_DAYS])
    level = F.element_at(F.array(F.lit("management"), F.lit("ombudsman"), F.lit("regulator"),
                                 F.lit("legal"), *[F.lit("none")] * 6), F.col("k") % 10 + 1)
    rows = _events(spark, sf_dir).filter(F.col("event_type") == "error")
    return rows.select(
        F.col("event_id").alias("complaint_id"), "household_id",
        F.element_at(names, F.col("k") % 8 + 1).alias("category"), F.col("day").alias("open_day"),
        (F.col("day") + 1 + F.floor(F.col("value") / 20)).cast("int").alias("resolved_day"),
        level.alias("escalation_level"), (F.col("k") % 13 == 0).alias("reopened"))


@plan_memo
def complaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complaint_lifecycle(complaint_raw(spark, sf_dir), EVENT_SLA_DAYS)


@plan_memo
def assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("household_id")
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id", (key % 10 < 3).alias("assistant_pilot"),
                    (key % 10 == 1).alias("classifier_flag"),
                    (key % 20 == 1).alias("human_confirmed")))


@plan_memo
def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array(*[F.lit(r) for r in ("client_request", "cd_renewed", "conversion",
                                           "consolidation", "loan_paid_at_term",
                                           "moved_relationship")])
    day = day_offset(F.to_date("o_orderdate"), F.lit(SNAPSHOT))
    closed = (F.col("o_orderstatus") != "O") & (day <= 0)
    return (table(spark, sf_dir, "orders")
            .select(F.col("o_orderkey").alias("account_id"), F.col("o_custkey").alias("household_id"),
                    F.col("o_orderpriority").alias("product"),
                    F.when(closed, day).alias("close_day"),
                    F.when(closed, F.element_at(reasons, (F.col("o_orderkey") % 6 + 1).cast("int")))
                     .alias("close_reason")))


@plan_memo
def wealth_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = (monthly_all(spark, sf_dir).filter(F.col("month") == -6)
           .select("household_id", (F.col("deposit_avg_balance")
                                    + F.coalesce("aum_month_end", F.lit(0.0))).alias("value_6m")))
    key, value = F.col("household_id"), F.col("relationship_value")
    return (household(spark, sf_dir).select("household_id", "relationship_value")
            .join(six, "household_id")
            .select("household_id", value.alias("value_t"), "value_6m",
                    F.when(key % 5 == 0, value * 1.5).alias("declared"),
                    F.when(key % 5 <= 2, value * 2.25).alias("vendor"),
                    (value * 1.25 + 50000).alias("model"),
                    (value * (key % 5 + 8) / 8).alias("wealth_old")))


@plan_memo
def trust_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("household_id")
    kinds = F.filter(F.array(F.when(key % 12 == 0, F.lit("trustee_move")),
                             F.when(key % 17 == 0, F.lit("trustee_service")),
                             F.when(key % 23 == 0, F.lit("trustee_noise")),
                             F.when(key % 29 == 0, F.lit("death_succession"))),
                     lambda k: k.isNotNull())
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id", F.explode(kinds).alias("kind")))


@plan_memo
def banker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per banker with the departure day, if any, and whether cancellations are logged."""
    key = F.col("banker_id")
    return (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("banker_id"))
            .select("banker_id", F.when(key % 5 == 0, -(key * 3 + 20)).alias("departure_day"),
                    (key % 5 < 2).alias("cancelled_by_captured")))


@plan_memo
def household_banker_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("household_id")
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id",
                    F.when(key % 23 == 0, -(key % 170 + 1)).cast("int").alias("client_request_day"),
                    F.when(key % 19 == 0, -(key % 150 + 1)).cast("int").alias("rebalance_day"),
                    F.when(key % 31 == 0, -(key % 100 + 1)).cast("int").alias("temporary_day"),
                    F.when(key % 31 == 0, (key % 45).cast("int")).alias("temporary_length")))


@plan_memo
def tradeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("household_id")
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .filter((key % 13 == 0) | (key % 11 == 0))
            .select("household_id", (key % 11 == 0).alias("own_lender"),
                    (-(key % 240)).cast("int").alias("open_day")))


@plan_memo
def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("household_id"))
            .select("household_id", (F.col("household_id") % 20 != 0).alias("permissible_purpose")))


@plan_memo
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table (household, model) with the label, a probability and the value at stake."""
    key = F.col("household_id")
    noise = (key * 7919 % 1000) / 1000
    signal = F.when(F.col("hard_churn_6m") == 1, 0.25).otherwise(0.0)
    base = household(spark, sf_dir).filter(~F.col("churn_excluded"))
    return (base.select("household_id", "segment", F.col("hard_churn_6m").alias("label"),
                        F.col("relationship_value").alias("value"),
                        F.explode(F.create_map(
                            F.lit("rules"), F.when(key % 9 == 0, 1.0).otherwise(0.0),
                            F.lit("expert"), F.floor((noise + signal) * 8) * 10.0,
                            F.lit("statistical"), (noise + signal) / 1.25)).alias("model", "score"))
                .withColumn("prob", F.when(F.col("model") == "statistical", F.col("score") / 8)))
