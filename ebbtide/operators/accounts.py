"""Ledger-row operators: calendar, life cycles, first reason wins, ledger exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import cents, col, in_window
from ebbtide.operators.ordering import row_ranks
from ebbtide.params import AVG_MONTH_DAYS, Params


def lookup(mapping: Mapping[str, object], key: str | Column) -> Column:
    """Small fixed dictionary as a map literal (no join)."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), col(key))


def complaint_lifecycle(raw: DataFrame, sla_days: Mapping[str, int]) -> DataFrame:
    """Status, elapsed days and SLA breach at the snapshot; a close after it is still unknown."""
    open_now = F.col("resolved_day") > 0
    elapsed = F.when(open_now, -F.col("open_day")).otherwise(F.col("resolved_day")
                                                             - F.col("open_day"))
    sla = lookup(sla_days, "category")
    return raw.select(
        "complaint_id", "household_id", "category", "open_day",
        F.when(~open_now, F.col("resolved_day")).alias("close_day"),
        F.when(open_now, "open").otherwise("closed").alias("status"),
        sla.alias("sla_days"), elapsed.alias("elapsed_days"), (elapsed > sla).alias("out_of_sla"),
        "escalation_level", (F.col("reopened") & ~open_now).alias("reopened"))


def first_reason_wins(candidates: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(day, reason) of the first candidate that has a day, in list order."""
    day = F.coalesce(*[d for _, d in candidates])
    reason = F.coalesce(*[F.when(d.isNotNull(), F.lit(name)) for name, d in candidates])
    return day, reason


def open_day(history: str | Column, cap: int | None = None, floor_day: int | None = None) -> Column:
    """First usable day of a relationship: unbounded at the cap, or clamped to the ledger start."""
    start = (-F.floor(col(history) * AVG_MONTH_DAYS)).cast("int")
    if floor_day is None:
        return F.when(col(history) < cap, start)
    return F.when(col(history) >= cap, F.lit(-floor_day)).otherwise(
        F.greatest(F.lit(-floor_day), start))


def filter_ledger_range(ledger: DataFrame, household: DataFrame, params: Params) -> DataFrame:
    """Rows inside the ledger history, after the opening, above half a cent; amounts in cents."""
    opening = household.select(
        "household_id", open_day("history_months", params.history_months_cap, params.history_days)
        .alias("open_day"))
    return (ledger.filter(in_window("day", -params.history_days)
                          & (F.col("amount") > params.min_amount))
                  .join(opening, "household_id").filter(F.col("day") >= F.col("open_day"))
                  .withColumn("amount", cents(F.col("amount"))).drop("open_day"))


def account_number(accounts: DataFrame) -> DataFrame:
    """0-based number of an account inside (household, product)."""
    ranked = row_ranks(accounts, "account_id", "account_id", ["household_id", "product"])
    return (ranked.withColumn("account_n", (F.col("row_rank") - 1).cast("int"))
                  .drop("row_rank", "row_count"))


def federal_holidays(year: Column) -> Column:
    """Observed US federal holidays of a year as an array of dates."""
    def fixed(month: int, day: int) -> Column:
        date = F.make_date(year, F.lit(month), F.lit(day))
        weekday = F.dayofweek(date)  # 1 = Sunday, 7 = Saturday
        return F.when(weekday == 7, F.date_add(date, -1)).when(weekday == 1, F.date_add(date, 1)) \
                .otherwise(date)

    def nth_weekday(month: int, weekday: str, n: int) -> Column:
        before = F.date_add(F.make_date(year, F.lit(month), F.lit(1)), -1)
        return F.date_add(F.next_day(before, weekday), 7 * (n - 1))

    def last_monday(month: int) -> Column:
        end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.date_add(F.next_day(end, "Mon"), -7)

    # The eleven federal holidays.
    return F.array(fixed(1, 1), nth_weekday(1, "Mon", 3), nth_weekday(2, "Mon", 3), last_monday(5),
                   fixed(6, 19), fixed(7, 4), nth_weekday(9, "Mon", 1), nth_weekday(10, "Mon", 2),
                   fixed(11, 11), nth_weekday(11, "Thu", 4), fixed(12, 25))


def is_business_day(date: Column) -> Column:
    year = F.year(date)
    holiday = F.array_contains(federal_holidays(year), date) | F.array_contains(
        federal_holidays(year + 1), date)  # a Saturday January 1st is observed the year before
    return ~F.dayofweek(date).isin(1, 7) & ~holiday


def business_calendar(dates: DataFrame, date: str) -> DataFrame:
    """Distinct dates with the last business day on or before each.

    A roll never passes more than six days, so the candidates are an array of seven dates per
    distinct calendar date and no ordered scan is needed.
    """
    window = F.transform(F.sequence(F.lit(0), F.lit(6)),
                         lambda back: F.date_sub(F.col(date), back.cast("int")))
    return (dates.select(date).distinct()
                 .select(date, F.explode(window).alias("candidate"))
                 .filter(is_business_day(F.col("candidate")))
                 .groupBy(date).agg(F.max("candidate").alias("business_day")))


def roll_to_business_day(rows: DataFrame, date: str) -> DataFrame:
    """Rows with the previous business day of ``date`` (as-of join on a calendar of its dates)."""
    return rows.join(business_calendar(rows, date), date, "left")


def monthly_due_dates(months: DataFrame, due_day: int, step: int = 1, phase: int = 0,
                      end_of_month: bool = False) -> DataFrame:
    """Due date of each first-of-month row ``month_start`` on a 1/3/6/12-month schedule."""
    start = F.col("month_start")
    in_phase = (F.month(start) - 1 - phase) % step == 0
    last = F.last_day(start)
    due = last if end_of_month else F.least(F.date_add(start, due_day - 1), last)
    return months.filter(in_phase).select("month_start", due.alias("due_date"))


def with_date(rows: DataFrame, day: str, date: str, snapshot) -> DataFrame:
    """Day offset to date; a NULL offset stays NULL."""
    return rows.withColumn(date, F.date_add(F.lit(snapshot), F.col(day))).drop(day)


def enrich_transfers(ledger: DataFrame, institutions: DataFrame) -> DataFrame:
    """Ledger rows with their institution; rows without one keep NULL attributes."""
    return ledger.join(institutions, "inst_id", "left")
