"""Composite multi-signal (#16) and the wide feature base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.contract import ALERT_GROUPS, PRIMARY_COLUMNS
from ebbtide.functions.columns import is_true
from ebbtide.params import Params


def group_condition(rules: list[str], params: Params) -> Column:
    """OR of text conditions, each NULL-safe."""
    conditions = [is_true(F.expr(r.format(material=params.material_not_reinvested_usd)))
                  for r in rules]
    return reduce(lambda a, b: a | b, conditions)


def composite_variables(features: DataFrame, params: Params) -> DataFrame:
    groups = features.select("household_id", *[
        group_condition(rules, params).cast("int").alias(f"group_alert_{name}")
        for name, rules in ALERT_GROUPS.items()])
    count = reduce(lambda a, b: a + b, [F.col(f"group_alert_{n}") for n in ALERT_GROUPS])
    return (groups.withColumn("multi_signal_count", count)
                  .withColumn("multi_signal_flag",
                              (count >= params.multi_signal_min_groups).cast("int")))


def join_features(household: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Equi join of the per-household feature tables; all share the partitioning of the key."""
    return reduce(lambda wide, part: wide.join(part, "household_id", "left"), parts, household)


def core_columns(full: DataFrame, household_columns: list[str],
                 extras: tuple[str, ...] = ()) -> DataFrame:
    primaries = [c for _, c in sorted(PRIMARY_COLUMNS.items())]
    keep = [*household_columns, *[c for c in primaries if c not in household_columns], *extras]
    return full.select(*dict.fromkeys(keep))


def missing_primaries(frame: DataFrame) -> list[str]:
    return [c for c in PRIMARY_COLUMNS.values() if c not in frame.columns]
