"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import pvalues
from ebbtide.operators import profiles, quality, relationship, statistics as st, transfers
from ebbtide.operators.models import wald
from ebbtide.plans import features as plan
from ebbtide.plans.registry import query
from ebbtide.sources import adapters as src

P = plan.DEFAULT


@query("dq_household")
def dq_household(spark, sf):
    return quality.dq_household(src.household(spark, sf), P)


@query("dq_columns_declared")
def dq_columns(spark, sf):
    h = src.household(spark, sf)
    return quality.schema_checks(h, ["household_id", "segment", "relationship_value"], "schema") \
        .unionByName(quality.gate(h, "schema", {"value positive": F.col("relationship_value") > 0}))


@query("dq_money")
def dq_money(spark, sf):
    return quality.dq_money(src.household(spark, sf))


@query("dq_balances")
def dq_balances(spark, sf):
    return quality.dq_balances(src.monthly(spark, sf), plan.balances(spark, sf),
                               src.household(spark, sf))


@query("dq_recurring")
def dq_recurring(spark, sf):
    return quality.dq_recurring(src.recurring_tx(spark, sf), plan.recurring_flows(spark, sf),
                                src.recurring_event(spark, sf))


@query("dq_transfers")
def dq_transfers(spark, sf):
    ledger = src.transfer(spark, sf)
    recent = transfers.semi_join_category(ledger, transfers.EXTERNAL_OUT).filter("day > -90")
    by_routing = transfers.concentration(recent, "household_id", "aba", "amount")
    return quality.dq_transfers(ledger, plan.transfer_flows(spark, sf), src.household(spark, sf),
                                by_routing)


@query("dq_investments")
def dq_investments(spark, sf):
    return quality.dq_investments(src.monthly_cash(spark, sf), plan.portfolio(spark, sf),
                                  src.household(spark, sf))


@query("dq_relationship")
def dq_relationship(spark, sf):
    accounts, h = src.account(spark, sf), src.household(spark, sf)
    return quality.dq_relationship(accounts, plan.relations(spark, sf), h,
                                   relationship.closure_variables(accounts, h, exclude=False))


@query("dq_banker")
def dq_banker(spark, sf):
    h = src.household(spark, sf)
    books = profiles.balanced_books(h, "tenure_years", {"HNW": 60, "UHNW": 25})
    changes = relationship.banker_changes(h, src.banker(spark, sf),
                                          src.household_banker_event(spark, sf), P)
    return quality.dq_banker(books, changes, plan.banker(spark, sf))


@query("dq_complaints")
def dq_complaints(spark, sf):
    return quality.dq_complaints(src.complaint(spark, sf), plan.complaints(spark, sf),
                                 src.assistant(spark, sf))


@query("dq_composite")
def dq_composite(spark, sf):
    return quality.dq_composite(plan.composite_features(spark, sf), plan.bureau(spark, sf),
                                src.bureau(spark, sf))


@query("dq_final_base")
def dq_final_base(spark, sf):
    return quality.dq_final_base(plan.core_base(spark, sf))


@query("dq_no_leak_columns")
def dq_no_leak(spark, sf):
    h = src.household(spark, sf).withColumn("z_outflow", F.lit(0.0))
    leaks = quality.leak_columns(h)
    return h.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(leaks)).alias("leak_columns"))


@query("set_difference_columns")
def set_difference(spark, sf):
    h = src.household(spark, sf).withColumn("note", F.lit("x"))
    names = quality.undeclared_columns(h)
    return h.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(names)).alias("undeclared"))


@query("leakage_tests")
def leakage_tests(spark, sf):
    """Noise columns must carry no risk: rank correlations and a Wald test, BH-adjusted."""
    h = src.household(spark, sf).filter("NOT churn_excluded").withColumn(
        "noise", (F.col("household_id") * 7919 % 1009).cast("double"))
    ranks = st.spearman_test(h, [("noise", "relationship_value"), ("noise", "tenure_years")],
                             "household_id")
    tests = ranks.select(F.lit("leakage").alias("section"), F.col("pair").alias("check_name"),
                         pvalues.p_value(F.lit("t"), F.col("t_statistic"), F.col("n") - 2)
                         .alias("p_value"))
    logit = wald(h, "soft_churn_3m", ["noise", "tenure_years"]).filter("term = 'noise'").select(
        F.lit("leakage").alias("section"), F.lit("noise in logit").alias("check_name"), "p_value")
    checks = quality.gate(h, "leakage", {"noise present": F.col("noise").isNotNull()})
    return quality.check_frame(checks, tests.unionByName(logit), P)


@query("check_frame")
def check_frame(spark, sf):
    """Gate rows plus tests whose p is a function of a book's share of trusts."""
    h = src.household(spark, sf)
    tests = h.groupBy("banker_id").agg(F.round(F.avg(F.col("has_trust").cast("int")) / 10, 4)
                                       .alias("p_value")).select(
        F.lit("books").alias("section"), F.concat(F.lit("book "), F.col("banker_id").cast("string"))
        .alias("check_name"), "p_value")
    return quality.check_frame(quality.dq_money(h), tests, P)
