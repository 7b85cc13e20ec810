import datetime

import pytest
from pyspark.sql import functions as F

from ebbtide.contract import EXCLUDED_PAYMENTS, PRIMARY_COLUMNS
from ebbtide.operators import accounts, balances, labels, relationship, transfers
from ebbtide.params import Params
from ebbtide.plans import features as plan
from ebbtide.sources import adapters as src
from tests.conftest import SF

P = Params()
PANEL = ("household_id long, month int, deposit_avg_balance double, aum_month_end double, "
         "aum_contributions double, aum_withdrawals double, twr_index double, available boolean")


def panel(spark, deposits, missing=()):
    rows = [(1, m, float(deposits), 50_000.0, 0.0, 1000.0 if m == 0 else 0.0, 1.0, m not in missing)
            for m in range(-23, 1)]
    return spark.createDataFrame(rows, PANEL)


def household(spark, ids=(1,), invests=True, history=24):
    return spark.createDataFrame([(i, invests, history) for i in ids],
                                 "household_id long, has_investments boolean, history_months int")


@pytest.mark.parametrize("deposits,known", [(9_999.99, False), (10_000.0, True)])
def test_deposit_floor(spark, deposits, known):
    row = balances.balance_variables(panel(spark, deposits), household(spark), P).first()
    assert (row.deposit_balance_change_pct_90d is not None) == known
    assert row.aum_outflow_30d == 1000.0 and row.aum_outflow_pct_30d == pytest.approx(0.02)


def test_missing_month_and_no_investments_are_null(spark):
    gap = balances.balance_variables(panel(spark, 20_000, missing=(-1,)), household(spark), P).first()
    assert gap.aum_outflow_90d is None and gap.aum_outflow_30d == 1000.0
    none = balances.balance_variables(panel(spark, 20_000), household(spark, invests=False), P).first()
    assert none.aum_outflow_30d is None and none.aum_vs_baseline_pct is None


def ledger(spark, rows):
    return spark.createDataFrame(rows, "household_id long, day int, category string, amount double, "
                                       "inst_id long, dest_id long")


def institutions(spark):
    return spark.createDataFrame([(1, True), (2, False)], "inst_id long, competitor_bank boolean")


def test_transfer_windows_edges_concentration_and_empty_ledger(spark):
    rows = ledger(spark, [(1, 0, "one_off", 60_000.0, 1, 7), (1, -60, "one_off", 500.0, 2, 8),
                          (1, -10, "biller", 9_000.0, -1, -1), (1, -20, "incoming", 4_000.0, 2, 9)])
    out = transfers.transfer_variables(rows, institutions(spark), panel(spark, 100_000),
                                       household(spark, (1, 2)), P, F.lit(0.0))
    got = {r.household_id: r for r in out.collect()}
    assert got[1].external_transfer_amount_60d == 60_000.0  # day -60 is outside (t-60, t]
    assert got[1].net_external_flow_30d == 4_000.0 - 60_000.0
    assert got[1].transfer_to_competitor_bank_amount_90d == 60_000.0
    assert got[1].external_destination_concentration == pytest.approx(
        (60_000 ** 2 + 500 ** 2) / 60_500 ** 2)
    assert got[1].new_external_destinations_30d == 1
    assert got[2].external_transfer_amount_60d == 0.0
    assert got[2].external_destination_concentration is None


def test_lower_floor_finds_more_destinations(spark):
    def total(params):
        return plan.transfer_flows(spark, SF, params).agg(
            F.sum("new_external_destinations_90d")).first()[0]
    assert total(P.replace(new_destination_min_cumulative=10_000.0)) > total(P)


def test_windows_are_monotone_and_independent_of_partitioning(spark):
    rows = src.transfer(spark, SF)
    windows = {"a": (-30, 0), "b": (-60, 0), "c": (-90, 0)}
    one = transfers.windowed_sums(rows, windows)
    assert one.filter("a > b + 1e-9 OR b > c + 1e-9").count() == 0
    two = transfers.windowed_sums(rows.repartition(13), windows)
    r = lambda d: d.select("household_id", *[F.round(c, 2) for c in windows])
    assert r(one).exceptAll(r(two)).count() == 0


def test_excluded_payments_raise_the_alert_rate(spark):
    from ebbtide.operators.ledger import relabel_excluded
    off = plan.transfer_flows(spark, SF, ledger=relabel_excluded(src.transfer(spark, SF),
                                                                 EXCLUDED_PAYMENTS))
    rate = lambda d: d.filter("external_transfer_pct_of_balance_60d > 0.15").count()
    assert rate(off) > rate(plan.transfer_flows(spark, SF))


def test_first_reason_wins_and_short_cover(spark):
    day, reason = accounts.first_reason_wins([("a", F.col("x")), ("b", F.col("y"))])
    rows = spark.createDataFrame([(None, -3), (-9, -3), (None, None)], "x int, y int")
    assert [tuple(r) for r in rows.select(day, reason).collect()] == [
        (-3, "b"), (-9, "a"), (None, None)]


def test_meaningful_contact_edges(spark):
    log = spark.createDataFrame([("call", 5.0, False), ("call", 4.9, False), ("email", 0.0, True),
                                 ("email", 0.0, False), ("mass_mailing", 9.0, True)],
                                "kind string, minutes double, replied_7d boolean")
    got = [r[0] for r in log.select(relationship.is_meaningful(P)).collect()]
    assert got == [True, False, True, False, False]
    reply = spark.range(1).select(relationship.reply_within(F.lit(-7), F.lit(0), P),
                                  relationship.reply_within(F.lit(-8), F.lit(0), P),
                                  relationship.reply_within(F.lit(-2), F.lit(1), P)).first()
    assert tuple(reply) == (True, False, False)


def test_complaint_closed_on_the_snapshot(spark):
    raw = spark.createDataFrame([(1, 1, "digital", -20, 0, "none", True),
                                 (2, 1, "digital", -20, 1, "none", True)],
                                "complaint_id int, household_id long, category string, open_day int, "
                                "resolved_day int, escalation_level string, reopened boolean")
    got = {r.complaint_id: r for r in accounts.complaint_lifecycle(raw, {"digital": 10}).collect()}
    assert got[1].status == "closed" and got[1].reopened and got[1].out_of_sla
    assert got[2].status == "open" and got[2].close_day is None and not got[2].reopened


def test_business_days(spark):
    days = {"2025-07-04": "2025-07-03", "2025-07-06": "2025-07-03", "2025-12-31": "2025-12-31",
            "2022-01-01": "2021-12-30", "2023-11-23": "2023-11-22"}
    df = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in days], "date date")
    got = {str(r.date): str(r.business_day) for r in accounts.roll_to_business_day(df, "date").collect()}
    assert got == days


def test_churn_labels(spark):
    def path(i, values, excluded=False):
        return [(i, k, v, 0.0, 1.0, excluded) for k, v in enumerate(values)]
    rows = (path(1, [100, 90, 4, 4, 4, 4, 4.0]) + path(2, [100, 3, 90, 90, 90, 90, 90.0])
            + path(3, [100, 100, 79, 100, 100, 100, 100.0]) + path(4, [100] * 7, True))
    df = spark.createDataFrame([(i, k, float(v), a, t, e) for i, k, v, a, t, e in rows],
                               "household_id long, k int, deposit double, aum double, twr double, "
                               "excluded boolean")
    got = {r.household_id: r for r in labels.construct_churn(df, P).collect()}
    assert (got[1].churn_hard_6m, got[1].churn_exit_month, got[1].churn_value_lost) == (1, 2, 96.0)
    assert (got[2].churn_hard_6m, got[2].churn_soft_3m) == (0, 1)  # recovers: contraction only
    assert (got[3].churn_soft_3m, got[3].churn_value_lost) == (1, 21.0)
    assert got[4].churn_any is None and got[4].churn_value_lost is None


def test_every_catalogue_variable_has_a_column(spark):
    core = plan.core_base(spark, SF)
    assert len(PRIMARY_COLUMNS) == 37 and set(PRIMARY_COLUMNS.values()) <= set(core.columns)
    groups = sum((F.col(c) for c in core.columns if c.startswith("group_alert_")), F.lit(0))
    assert core.filter(groups != F.col("multi_signal_count")).count() == 0


def test_legal_switch_clears_the_bureau_variable(spark):
    off = plan.bureau(spark, SF, P.replace(legal_cleared=False))
    assert off.filter("bureau_new_mortgage_elsewhere IS NOT NULL").count() == 0
