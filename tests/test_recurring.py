import pytest
from pyspark.sql import functions as F

from ebbtide.operators import recurring as r
from ebbtide.params import Params
from ebbtide.plans import features as plan
from ebbtide.sources import adapters as src
from tests.conftest import SF

REGULAR = [-140, -126, -112, -98, -84, -70, -56]
IRREGULAR = [-140, -130, -60, -58, -20]
BONUS = [-150, -120, -90, -85, -60, -30]


def detect(spark, days, amounts, bonus=False, multiple=2.0):
    rows = [(1, d, float(a), 0.0, 180, bonus) for d, a in zip(days, amounts)]
    df = spark.createDataFrame(rows, "k int, day int, amount double, end double, length int, "
                                     "bonus_rule boolean")
    p = Params(bonus_multiple=multiple)
    relational = r.detect_recurring(df, ["k"], p).first()
    grouped = df.groupBy("k", "end", "length", "bonus_rule").agg(
        F.collect_list(F.struct("day", "amount")).alias("payments"))
    array = grouped.select(r._pattern(F.col("end"), p).alias("p")).select("p.*").first()
    assert (relational.exists, relational.interval) == (array.exists, array.interval)
    return relational


def test_regular_stream(spark):
    row = detect(spark, REGULAR, [1000] * 7)
    assert row.exists and row.interval == 14 and row.median_amount == 1000


def test_irregular_stream(spark):
    assert not detect(spark, IRREGULAR, [1000] * 5).exists


def test_bonus_breaks_the_pattern_unless_removed(spark):
    amounts = [1000, 1000, 1000, 9000, 1000, 1000]
    assert not detect(spark, BONUS, amounts).exists
    assert detect(spark, BONUS, amounts, bonus=True).exists


def test_same_day_payments_and_single_gap(spark):
    row = detect(spark, [-60, -60, -30, -30], [5.0, 7.0, 5.0, 7.0])
    assert row.interval == 0 and not row.exists
    assert not detect(spark, [-60, -30], [1.0, 1.0]).exists


@pytest.mark.parametrize("limit", [0, 60])
def test_array_and_relational_plans_agree(spark, limit):
    args = (src.recurring_tx(spark, SF), src.recurring_event(spark, SF), src.household(spark, SF),
            plan.EVENT_PARAMS)
    key = lambda rows: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float)
                                     else v for v in row) for row in rows), key=lambda t: t[0])
    usual = key(r.recurring_variables(*args).collect())
    split = key(r.recurring_variables(*args, limit=limit).collect())
    assert usual == split


def test_both_plans_decide_alike_at_the_bonus_limit(spark):
    """Medians at half a cent and spreads at the limit must not depend on the plan."""
    amounts = [37.08, 37.08, 226.03, 37.08, 188.95, 188.95]
    ledger = spark.createDataFrame(
        [(1, "payroll", -170 + 20 * i, a) for i, a in enumerate(amounts)],
        "household_id long, stream string, day int, amount double")
    events = spark.createDataFrame([(1, False, False, False, False)], "household_id long, "
                                   "retire_reported boolean, leave_reported boolean, "
                                   "death_reported boolean, business_sale boolean")
    rows = [r.recurring_decisions(ledger, events, Params(), limit).first() for limit in (1000, 1)]
    assert rows[0].asDict() == rows[1].asDict()


def test_stops_of_hot_households_equal_those_of_usual_ones(spark):
    ledger = src.recurring_tx(spark, SF)
    rows = [sorted(tuple(v) for v in r.stream_stops(ledger, plan.EVENT_PARAMS, limit).filter("median_amount IS NOT NULL").collect())
            for limit in (200_000, 40, 0)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 50
