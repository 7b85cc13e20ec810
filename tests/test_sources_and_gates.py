import json
import os

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import quality
from ebbtide.operators.profiles import fingerprint
from ebbtide.params import Params, read_params
from ebbtide.sources import adapters as src, catalogue, sinks
from tests.conftest import SF


def test_params_overlay(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("step1:\n  min_balance_for_pct: 20_000\nstep2:\n  detection: {cv_max: 0.5}\n")
    p = read_params(str(path), cv_max=0.4)
    assert (p.min_balance_for_pct, p.cv_max, p.stop_days_min) == (20_000.0, 0.4, 45)


def test_catalogue_multiline(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id,group,variable,detailed_logic\n1,Transfers,a,"two\nlines ""quoted"""\n'
                    '2,Banker,trustee_change_flag,x\n')
    got = catalogue.catalog_controls(catalogue.read_catalog(spark, str(path)), ["a"])
    rows = {r.id: r for r in got.collect()}
    assert rows[1].detailed_logic == 'two\nlines "quoted"'
    assert (rows[1].build_step, rows[1].status, rows[1].applies_to) == (3, "built", "all")
    assert rows[2].applies_to == "has_trust" and rows[2].status == "pending"
    catalogue.check_catalog(got, 2)
    with pytest.raises(ValueError):
        catalogue.check_catalog(got.union(got), 2)


def test_sinks_round_trip(spark, tmp_path):
    h = src.household(spark, SF)
    sinks.write_table(h, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).exceptAll(h).count() == 0
    sinks.write_table(h.select("household_id", "relationship_value"), str(tmp_path / "c"), "csv",
                      digits=2)
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert back.filter(~F.col("relationship_value").rlike(r"^\d+\.\d{2}$")).count() == 0
    sinks.write_manifest(h, str(tmp_path / "m"), Params(), True)
    part = next(f for f in os.listdir(tmp_path / "m") if f.endswith(".json"))
    row = json.loads((tmp_path / "m" / part).read_text())
    assert row["rows"] == h.count() and row["columns"] == h.columns


def test_fingerprint_ignores_order_but_not_content(spark):
    h = src.household(spark, SF)
    key = lambda d: fingerprint(d, "x", True).first().content_hash
    assert key(h) == key(h.repartition(5))
    assert key(h) != key(h.withColumn("age_primary", F.col("age_primary") + 1))


def test_gates_fail_on_broken_input(spark):
    h = src.household(spark, SF)
    ok = quality.dq_household(h, Params())
    assert ok.filter("NOT ok").count() == 0
    broken = h.withColumn("aum", F.lit(None).cast("double")).unionByName(h.limit(1))
    bad = {r.check_name for r in quality.dq_household(broken, Params()).filter("NOT ok").collect()}
    assert {"assets null iff no investments", "deposits plus assets equal value",
            "household_id unique"} <= bad
    money = quality.dq_money(h.withColumn("aum", F.col("aum") + 0.001)).filter("NOT ok").collect()
    assert [r.check_name for r in money] == ["aum whole cents"]


def test_leak_and_undeclared_columns(spark):
    h = src.household(spark, SF).withColumn("z_service", F.lit(0.0))
    assert quality.leak_columns(h) == ["z_service"]
    assert quality.undeclared_columns(h) == ["z_service"]
