"""The monthly panel: its rows by brute force, and where it grows."""

import collections
import datetime
import math
import random

import pytest

from ebbtide.sources import adapters as src


@pytest.fixture
def folder(spark, tmp_path):
    """Customers and orders with null and repeated keys, null balances and prices, and stray orders."""
    rng = random.Random(5)
    customers = [(k, float(rng.randint(-900, 9000))) for k in range(1, 41)]
    customers += [(3, 9999.0), (5, None), (41, None), (None, 77.0), (None, -88.0)]
    orders = []
    for n in range(400):
        day = datetime.datetime(1999, 12, 31) + datetime.timedelta(days=rng.randint(-760, 200), hours=5)
        orders.append((rng.choice([n, n, n, None]), rng.choice([None, 999, *range(1, 42)]),
                       rng.choice([None, *[rng.randint(100, 900_000) / 4] * 5]), rng.choice([None, *[day] * 9]),
                       rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", None])))
    spark.createDataFrame([(k, b, 1, "x", "y") for k, b in customers],
                          "c_custkey long, c_acctbal double, c_nationkey int, c_name string, c_mktsegment string"
                          ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(*o, "O") for o in orders],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path), customers, orders


def brute_panel(customers, orders):
    balances, flows = {}, collections.defaultdict(lambda: [0.0, 0.0, 0.0])
    for key, balance in customers:
        if balance is not None:
            balances[key] = max(abs(balance), balances.get(key, 0.0))
    for number, key, price, date, priority in orders:
        days = None if date is None else (date.date() - src.SNAPSHOT).days
        if days is None or price is None or not -730 <= days <= 182:
            continue
        amount, flow = math.floor(price * 10) / 100, flows[key, math.ceil(days / 30.44)]
        flow[0] += amount if number is not None and number % 2 == 0 else -amount
        flow[1] += amount if priority == "1-URGENT" else 0.0
        flow[2] += amount if priority == "2-HIGH" else 0.0
    out = {}
    for key, balance in balances.items():
        signed = net = 0.0
        invests = None if key is None else key % 7 != 0
        for month in range(-23, 7):
            flow = flows.get((key, month), (0.0, 0.0, 0.0))
            signed, net = signed + flow[0], net + flow[1] - flow[2]
            out[key, month] = (max(500.0, balance * 5 + signed),
                               balance * 10 + 20000 + max(0.0, net) if invests else None,
                               flow[1] if invests else 0.0, flow[2] if invests else 0.0,
                               month > -(24 if key is None else min(24, key % 40 + 1)))
    return out


def test_panel_by_brute_force(spark, folder):
    path, customers, orders = folder
    rows = src.monthly_all(spark, path).collect()
    want = brute_panel(customers, orders)
    assert len(rows) == len(want)
    for r in rows:
        *values, available = want[r.household_id, r.month]
        got = (r.deposit_avg_balance, r.aum_month_end, r.aum_contributions, r.aum_withdrawals)
        assert r.available == available
        assert got == tuple(None if v is None else pytest.approx(v, abs=0.011) for v in values)


def test_panel_grows_behind_its_exchanges(spark, folder, monkeypatch):
    """The months are laid out last, in partitions whose number follows the households."""
    monkeypatch.setattr(src, "PANEL_HOUSEHOLDS", 2, raising=False)
    panel = src.monthly_all(spark, folder[0])
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < min(plan.index("Exchange"), plan.index("HashAggregate"))
    assert panel.count() == 30 * 41 and ", 23), REPARTITION_BY_NUM" in plan  # 45 customers
