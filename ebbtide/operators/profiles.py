"""Descriptive aggregates, preparation of model inputs and small relational helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.contract import HOUSEHOLD_FLAGS, PAYS_PER_YEAR, RISK_BANDS
from ebbtide.operators.ordering import exact_quantiles, row_ranks, running_totals
from ebbtide.params import Params


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long (keys, variable, value) of numeric columns; one pass for any number of variables."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.variable", "_p.value")


def describe_percentiles(df: DataFrame, columns: Sequence[str],
                         probs: Mapping[str, float]) -> DataFrame:
    """count, mean, std, min, chosen percentiles and max of many columns."""
    long = unpivot(df, [], columns).filter(F.col("value").isNotNull())
    basic = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, "value", probs, ["variable"]), "variable")


def column_quantiles(df: DataFrame, columns: Sequence[str],
                     probs: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Quantiles of each column on the driver: one row per column, never more."""
    long = unpivot(df, [], columns)
    rows = exact_quantiles(long, "value", probs, ["variable"]).collect()
    return {row["variable"]: {p: row[p] for p in probs} for row in rows}


def impute_with_indicator(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_is_null") for c in medians]
    keep = [c for c in df.columns if c not in medians]
    return df.select(*keep, *[v.alias(c) for c, v in values.items()], *flags)


def winsorize(df: DataFrame, bounds: Mapping[str, Mapping[str, float]]) -> DataFrame:
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(b["low"]), F.least(
        F.lit(b["high"]), F.col(c).cast("double")))) for c, b in bounds.items()}
    return df.select(*[clipped[c].alias(c) if c in clipped else F.col(c) for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """z-scores; columns without variance are dropped.  Moments are one row on the driver."""
    spread = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[spread(F.col(c).cast("double")).alias(f"s_{c}") for c in columns]).first()
    kept = [c for c in columns if row[f"s_{c}"]]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[((F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"]).alias(c) for c in kept])


def log_relative_sequence(panel: DataFrame, months: int = 12) -> DataFrame:
    """Twelve log ratios of deposits and ex-market assets against the first month, as columns."""
    oldest = 1 - months
    ex_market = F.col("aum_month_end") / F.col("twr_index")
    series = {"dep": F.col("deposit_avg_balance"), "aumx": ex_market}
    aggs = []
    for name, value in series.items():
        start = F.max(F.when(F.col("month") == oldest, F.greatest(value, F.lit(1.0))))
        for m in range(oldest, 1):
            now = F.max(F.when((F.col("month") == m) & F.col("available") & value.isNotNull(),
                               F.greatest(value, F.lit(1.0))))
            aggs.append(F.log(now / start).alias(f"seq_{name}_m{m + months - 1}"))
    recent = panel.filter((F.col("month") >= oldest) & (F.col("month") <= 0))
    return recent.groupBy("household_id").agg(*aggs)


def derive_household(raw: DataFrame, params: Params) -> DataFrame:
    """Derived household columns: segment, value split, history, tenure cap, income, stream flag."""
    invests = F.col("has_investments")
    deposits = F.col("deposit_balance")
    value = deposits + F.coalesce(F.col("aum"), F.lit(0.0))
    tenure = F.least(F.col("tenure_years"), F.greatest(F.col("age_primary") - 18.0, F.lit(0.5)),
                     F.lit(params.tenure_cap_years))
    return raw.select(
        "household_id",
        F.when(F.col("relationship_value") >= params.uhnw_threshold, "UHNW").otherwise("HNW")
         .alias("segment"),
        F.when(invests, F.col("relationship_value") - deposits).alias("aum_split"),
        F.round(value, 2).alias("value_sum"),
        F.least(F.floor(tenure * 12), F.lit(params.history_months_cap)).cast("int")
         .alias("history_from_tenure"),
        tenure.alias("tenure_capped"),
        reduce(lambda a, b: a | b, [F.col(c) for c in (
            "has_payroll_stream", "has_pension_stream", "has_dividend_stream",
            "has_linked_business")]).alias("has_any_recurring_stream"),
        recurring_income().alias("recurring_income_monthly"))


def recurring_income() -> Column:
    """Null-safe monthly income of all streams."""
    parts = [F.col("salary_base_annual") / 12, F.col("pension_monthly"),
             F.col("dividend_annual") / 12, F.col("business_distribution_annual") / 12]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])


def pays_per_year(column: str) -> Column:
    pairs = [F.lit(v) for pair in PAYS_PER_YEAR.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def with_band(scores: DataFrame, score: str) -> DataFrame:
    band = F.coalesce(*[F.when((F.col(score) > low) & (F.col(score) <= high), F.lit(name))
                        for name, low, high in RISK_BANDS])
    return scores.withColumn("band", band)


def risk_bands(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Share of households and churn per band; bands without households stay in the result."""
    spark = scores.sparkSession
    bands = spark.createDataFrame([(name,) for name, _, _ in RISK_BANDS], "band string")
    folded = with_band(scores, score).groupBy("band").agg(
        F.count(F.lit(1)).alias("households"), (F.avg(label) * 100).alias("churn_pct"))
    total = F.sum("households").over(Window.partitionBy())  # three rows
    return (bands.join(folded, "band", "left")
                 .withColumn("households", F.coalesce("households", F.lit(0)))
                 .withColumn("household_pct", F.col("households") * 100 / total))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the values of a categorical column."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.select(column, "n", (F.col("n") / total.scalar()).alias("share"))


def partition_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the sum, size and maximum of their key (fold and join, no window per key)."""
    totals = df.groupBy(key).agg(F.sum(value).alias("key_sum"), F.count(F.lit(1)).alias("key_size"),
                                 F.max(value).alias("key_max"))
    return df.join(totals, key)


def exact_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur more than once, with their number of rows."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
              .filter(F.col("copies") > 1))


def repeated_amounts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values, distinct values and values that repeat an earlier one."""
    long = unpivot(df, [], columns).filter(F.col("value").isNotNull())
    per_value = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_k"))
    return per_value.groupBy("variable").agg(
        F.sum("_k").alias("rows"), F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.col("_k") - 1).alias("repeated"))


def flag_combinations(df: DataFrame) -> DataFrame:
    combo = F.concat_ws("|", *[F.col(c).cast("string") for c in HOUSEHOLD_FLAGS], F.col("segment"))
    return df.groupBy(combo.alias("combination")).agg(F.count(F.lit(1)).alias("households"))


def book_quality(household: DataFrame, risk: Column) -> DataFrame:
    """Mean risk of a banker's book, standardized over books and joined back to households."""
    rows = household.select("household_id", "banker_id", risk.alias("risk"))
    books = rows.groupBy("banker_id").agg(F.avg("risk").alias("book_risk"))
    mean = books.agg(F.avg("book_risk").alias("m")).scalar()
    spread = books.agg(F.stddev_samp("book_risk").alias("s")).scalar()
    scored = books.select("banker_id", F.try_divide(F.col("book_risk") - mean, spread).alias("book_risk_z"))
    return rows.join(scored, "banker_id").select("household_id", "banker_id", "book_risk_z")


def weighted_index(df: DataFrame, key: str, weights: Mapping[str, float],
                   structural: Column) -> DataFrame:
    """Weighted sum plus structural terms, standardized with the population deviation."""
    raw = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]) + structural
    rows = df.select(key, raw.alias("raw_index"))
    stats = rows.agg(F.avg("raw_index").alias("m"), F.stddev_pop("raw_index").alias("s"))
    return rows.select(key, F.try_divide(F.col("raw_index") - stats.select("m").scalar(),
                                         stats.select("s").scalar()).alias("risk_index"))


def primary_driver(contributions: Sequence[str]) -> Column:
    """Name of the largest contribution, the first one on ties."""
    top = F.greatest(*[F.col(c) for c in contributions])
    return F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in contributions])


def balanced_books(household: DataFrame, order: str, sizes: Mapping[str, int]) -> DataFrame:
    """Books of nearly equal size per segment, in order of a quality key; first books are larger."""
    ranked = row_ranks(household.select("household_id", "segment", order), order, "household_id",
                       ["segment"])
    size = F.coalesce(*[F.when(F.col("segment") == s, F.lit(float(k))) for s, k in sizes.items()])
    books = F.greatest(F.lit(1), F.bround(F.col("row_count") / size, 0)).cast("long")
    base = F.floor(F.col("row_count") / F.col("books"))
    extra = F.col("row_count") % F.col("books")
    position = F.col("row_rank") - 1
    head = extra * (base + 1)
    book = F.when(position < head, F.floor(position / (base + 1))).otherwise(
        extra + F.floor((position - head) / base))
    return (ranked.withColumn("books", books)
                  .select("household_id", "segment", book.cast("int").alias("book")))


def value_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Share of total value held by the top fraction of rows."""
    totals = running_totals(df, value, {"_k": F.lit(1)})
    top = F.bround(F.col("tot__k") * fraction, 0)
    above = F.col("tot__k") - F.col("lt__k") - F.col("_k")
    taken = F.greatest(F.lit(0), F.least(F.col("_k"), top - above))
    return totals.agg(F.sum("_k").alias("households"), F.max(top).cast("long").alias("top_households"),
                      (F.sum(taken * F.col(value)) / F.sum(F.col("_k") * F.col(value)))
                      .alias("value_share"))


def fingerprint(df: DataFrame, config_hash: str, passed: bool) -> DataFrame:
    """One manifest row: count, columns and an order-insensitive content hash."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"),
                  F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("hash_sum")).select(
        "rows", F.lit(len(df.columns)).alias("column_count"),
        F.concat_ws("-", F.hex("hash_xor"), F.col("hash_sum").cast("string")).alias("content_hash"),
        F.lit(config_hash).alias("config_hash"), F.lit(passed).alias("checks_passed"))
