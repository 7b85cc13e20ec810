"""Global and per-group order statistics without a single-task sort.

A window ordered over a whole table runs in one task, and so does a window over a hot group.
Every operator here cuts the ordered values of each group into blocks at splitters taken from the
data: the values whose hash falls under a share set by the size of the group, so about
``splitters`` of each group with more than ``LEAST_CUT`` values.  The choice depends on values only,
never on the layout of tasks, so every job cuts alike.  Block totals are few, so the prefix over
blocks is cheap, and the prefix inside a block is an ordinary distributed window.  The splitters
only deal out the work; results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.columns import equal_frequency_bucket

#: Groups with fewer different values stay one block.
LEAST_CUT = 2_000
#: Splitters per group and shuffle partition.
CUTS_PER_TASK = 4


def splitters(spark: SparkSession) -> int:
    """Expected splitters of a large group."""
    return CUTS_PER_TASK * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_blocks(points: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``_block``: a number that grows with (``order``) inside each group of ``by``.

    Rows that agree on ``by`` and ``order`` share a block.
    """
    by, wanted = list(by), splitters(points.sparkSession)
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    drawn = F.pmod(F.xxhash64(*by, *order), F.lit(1 << 30))
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAST_CUT)
    share = F.lit(1 << 30) * F.lit(float(wanted)) / F.col("_n")
    # Some ``wanted`` rows of a group, whatever its size.
    cuts = _matched(points, sizes, by, "inner").filter(drawn < share).groupBy(*by).agg(
        F.array_sort(F.collect_set(key)).alias("_cuts"))
    steps = F.array(*[F.lit(1 << k) for k in range((4 * wanted).bit_length(), -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(F.col("_cuts"), at + step - 1) <= key, at + step).otherwise(at))
    return _matched(points, cuts, by, "left").withColumn(
        "_block", F.when(F.col("_cuts").isNull(), 0).otherwise(place)).drop("_cuts")


def _matched(points: DataFrame, groups: DataFrame, by: Sequence[str], how: str,
             on: Column | None = None) -> DataFrame:
    """Join with a table of one row per group (and block); null groups match."""
    if not by and on is None:
        return points.join(F.broadcast(groups), F.lit(True), how)  # one row
    same = on
    for c in by:
        equal = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        same = equal if same is None else same & equal
    renamed = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    return points.join(renamed, same, how).drop(*[f"_g_{c}" for c in by])


def _offsets(blocks: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per block ``_off_m`` over earlier blocks and ``tot_m`` over the group."""
    group = Window.partitionBy(*by)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *by, F.col("_block").alias("_b"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(group).alias(f"tot_{m}") for m in measures])


def _joined(points: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    return _matched(points, offsets, by, "inner", F.col("_block") == F.col("_b")).drop("_b")


def running_totals(df: DataFrame, value: str, measures: Mapping[str, Column],
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct (group, value) with, for each additive measure ``m``:

    ``m`` at this value, ``lt_m`` over all smaller values and ``tot_m`` over the group.
    """
    by = list(by)
    points = with_blocks(df.filter(F.col(value).isNotNull())
                           .groupBy(*by, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()]), [value], by)
    blocks = points.groupBy(*by, "_block").agg(*[F.sum(m).alias(m) for m in measures])
    inside = (Window.partitionBy(*by, "_block").orderBy(value)
                    .rowsBetween(Window.unboundedPreceding, -1))
    return _joined(points, _offsets(blocks, list(measures), by), by).select(
        *by, value, *measures,
        *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"lt_{m}")
          for m in measures],
        *[f"tot_{m}" for m in measures])


def row_ranks(df: DataFrame, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` with a unique 1-based ``row_rank`` by (value, tie) and the group ``row_count``.

    Blocks are cut by (value, tie), so a value shared by a third of the rows never lands in one
    task while ``tie`` tells its rows apart.
    """
    by, order = list(by), list(dict.fromkeys([value, tie]))
    rows = with_blocks(df.filter(F.col(value).isNotNull()), order, by)
    blocks = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_k"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    return (_joined(rows, _offsets(blocks, ["_k"], by), by)
            .withColumn("row_rank", F.col("_off__k") + F.row_number().over(inside))
            .withColumnRenamed("tot__k", "row_count").drop("_off__k", "_block"))


def equal_freq_buckets(df: DataFrame, value: str, tie: str, buckets: int | Column,
                       by: Sequence[str] = (), out: str = "bucket") -> DataFrame:
    ranked = row_ranks(df, value, tie, by)
    return (ranked.withColumn(out, equal_frequency_bucket(F.col("row_rank"), F.col("row_count"),
                                                          buckets))
                  .drop("row_rank", "row_count"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (group, value) with the average rank shared by its ties."""
    totals = running_totals(df, value, {"_k": F.lit(1)}, by)
    return totals.select(*by, value, "_k",
                         (F.col("lt__k") + (F.col("_k") + 1) / 2).alias("avg_rank"),
                         F.col("tot__k").alias("row_count"))


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group, exact at any group size."""
    totals = running_totals(df, value, {"_k": F.lit(1)}, by)
    return _interpolate(totals, value, probs, by)


def _interpolate(totals: DataFrame, value: str, probs: Mapping[str, float],
                 by: Sequence[str]) -> DataFrame:
    def at(position: Column) -> Column:
        here = (F.col("lt__k") <= position) & (position < F.col("lt__k") + F.col("_k"))
        return F.max(F.when(here, F.col(value)))

    parts, outputs = [], []
    for name, p in probs.items():
        position = (F.col("tot__k") - 1) * F.lit(float(p))
        low = F.floor(position)
        high = F.least(low + 1, F.col("tot__k") - 1)
        parts += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
                  F.max(position - low).alias(f"_w_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((lo + (hi - lo) * F.col(f"_w_{name}")).alias(name))
    return totals.groupBy(*by).agg(*parts).select(*by, *outputs)


def exact_medians(df: DataFrame, value: str, name: str, by: Sequence[str]) -> DataFrame:
    """Medians per group as half the sum of the two middle values, exact at any group size."""
    totals = running_totals(df, value, {"_k": F.lit(1)}, by)
    def at(position: Column) -> Column:
        here = (F.col("lt__k") <= position) & (position < F.col("lt__k") + F.col("_k"))
        return F.max(F.when(here, F.col(value)))
    last = F.col("tot__k") - 1
    return totals.groupBy(*by).agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0).alias(name))
