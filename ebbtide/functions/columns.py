"""Column expressions shared by all operators.  Everything here stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.params import AVG_MONTH_DAYS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_of(day: str | Column) -> Column:
    """Month bucket m <= 0 that covers ``(30.44 (m - 1), 30.44 m]`` days around the snapshot."""
    return F.ceil(col(day) / F.lit(AVG_MONTH_DAYS)).cast("int")


def day_offset(date: str | Column, snapshot: str | Column) -> Column:
    return F.datediff(col(date), col(snapshot))


def in_window(day: str | Column, low: int | Column, high: int | Column = 0) -> Column:
    """Half-open window ``(low, high]``."""
    return (col(day) > low) & (col(day) <= high)


def is_true(condition: Column) -> Column:
    """A NULL comparison never raises an alert."""
    return F.coalesce(condition, F.lit(False))


def as_flag(condition: Column) -> Column:
    return condition.cast("int")


def flag_or_null(applies: Column, condition: Column) -> Column:
    """1/0 where the population applies, NULL elsewhere (NULL is never 0)."""
    return F.when(applies, is_true(condition).cast("int"))


def sum_when(condition: Column, value: str | Column) -> Column:
    """Conditional sum that is 0.0, not NULL, when no row of the group matches."""
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0.0))


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def safe_pct(numerator: Column, denominator: Column, floor: float) -> Column:
    """Ratio that is NULL while the denominator is below its floor."""
    return F.when(denominator >= floor, numerator / denominator)


def ratio_when_positive(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def cents(value: Column) -> Column:
    return F.bround(value, 2)


def is_whole_cents(value: str | Column, tolerance: float = 1e-4) -> Column:
    return F.abs(col(value) * 100 - F.round(col(value) * 100)) < tolerance


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def routing_check_digit(first_eight: str | Column) -> Column:
    """Check digit of a routing number: weights 3, 7, 1 repeated, total a multiple of ten."""
    weights = (3, 7, 1, 3, 7, 1, 3, 7)
    text = col(first_eight)
    total = sum(F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights))
    return (F.lit(10) - total % 10) % 10


def routing_is_valid(aba: str | Column) -> Column:
    text = col(aba)
    return routing_check_digit(F.substring(text, 1, 8)) == F.substring(text, 9, 1).cast("int")


def equal_frequency_bucket(rank: Column, rows: Column, buckets: int | Column) -> Column:
    """Bucket 0..q-1 of a unique rank 1..n, cut at the linear quantiles of the ranks."""
    span = F.greatest(rows - 1, F.lit(1))
    raw = F.ceil((rank - 1) * buckets / span) - 1
    return F.greatest(F.lit(0), raw.cast("int"))


def bucket_of_edges(value: str | Column, edges: str | Column) -> Column:
    """Index of the last edge <= value, clipped to the first and last bin of an edge array."""
    below = F.size(F.filter(col(edges), lambda e: e <= col(value)))
    return F.greatest(F.lit(0), F.least(below - 1, F.size(col(edges)) - 2))


def text_rule(rule: str, column: str | Column) -> Column:
    """Condition of a text rule such as ``"> 0.15"`` or ``"= 1"``."""
    op, threshold = rule.split()
    value, limit = col(column), float(threshold)
    conditions = {">": value > limit, ">=": value >= limit, "<": value < limit,
                  "<=": value <= limit, "=": value == limit}
    return is_true(conditions[op])
