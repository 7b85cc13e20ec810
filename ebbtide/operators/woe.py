"""Weight of evidence: binning, information value, trend, encoding and points.

All variables are binned together in long form.  Values are folded before they are ranked, so a
mass point (a hurdle variable's zero) never reaches one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.columns import bucket_of_edges, equal_frequency_bucket, is_true
from ebbtide.operators.ordering import exact_quantiles, row_ranks
from ebbtide.operators.profiles import unpivot

SMOOTHING = 0.5


def long_form(rows: DataFrame, variables: Sequence[str], label: str, key: str = "household_id",
              keep: Sequence[str] = ()) -> DataFrame:
    long = unpivot(rows, [key, label, *keep], variables)
    return long.withColumnRenamed(label, "y")


def mass_points(long: DataFrame, share: float) -> DataFrame:
    """Values holding more than ``share`` of a variable's non-null rows: at most 1/share each."""
    counts = long.filter(F.col("value").isNotNull()).groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    return (counts.join(totals, "variable").filter(F.col("n") > F.col("total") * share)
                  .select("variable", "value", F.lit(True).alias("is_mass")))


def _split(long: DataFrame, share: float) -> DataFrame:
    masses = mass_points(long, share)
    return long.join(F.broadcast(masses), ["variable", "value"], "left").withColumn(
        "is_mass", is_true(F.col("is_mass")))


def quantile_bins(long: DataFrame, bins: int, share: float, key: str = "household_id") -> DataFrame:
    """Rows with (kind, bin_key): mass points alone, equal-frequency ranks for the rest, NULL."""
    marked = _split(long, share)
    masses = mass_points(long, share).groupBy("variable").agg(F.count(F.lit(1)).alias("masses"))
    ranked = row_ranks(marked.filter(~F.col("is_mass")), "value", key, ["variable"])
    quantiles = F.greatest(F.lit(1), F.lit(bins) - F.coalesce("masses", F.lit(0)))
    bucket = F.when(F.col("row_count") >= quantiles,
                    equal_frequency_bucket(F.col("row_rank"), F.col("row_count"), quantiles)) \
              .otherwise(0)
    rest = ranked.join(F.broadcast(masses), "variable", "left").select(
        key, "variable", "y", "value", F.lit("q").alias("kind"),
        bucket.cast("double").alias("bin_key"))
    return rest.unionByName(_special(marked, key))


def _special(marked: DataFrame, key: str) -> DataFrame:
    alone = marked.filter("is_mass").select(key, "variable", "y", "value", F.lit("m").alias("kind"),
                                            F.col("value").alias("bin_key"))
    missing = marked.filter(F.col("value").isNull()).select(
        key, "variable", "y", "value", F.lit("null").alias("kind"), F.lit(0.0).alias("bin_key"))
    return alone.unionByName(missing)


def fit_edges(long: DataFrame, bins: int, share: float) -> DataFrame:
    """Distinct quantile edges of the non-mass values of each variable (one row per variable)."""
    rest = _split(long, share).filter(~F.col("is_mass") & F.col("value").isNotNull())
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(rest, "value", names, ["variable"])
    return edges.select("variable", F.array_distinct(F.array(*names)).alias("edges"))


def edge_bins(long: DataFrame, edges: DataFrame, masses: DataFrame,
              key: str = "household_id") -> DataFrame:
    """Bins of a fitted scorecard: the last edge at or below the value, keyed by index."""
    marked = long.join(F.broadcast(masses), ["variable", "value"], "left").withColumn(
        "is_mass", is_true(F.col("is_mass")))
    rest = marked.filter(~F.col("is_mass") & F.col("value").isNotNull()).join(
        F.broadcast(edges), "variable", "left")
    bucket = F.when(F.size("edges") > 1, bucket_of_edges("value", "edges")).otherwise(0)
    binned = rest.select(key, "variable", "y", "value", F.lit("q").alias("kind"),
                         bucket.cast("double").alias("bin_key"))
    return binned.unionByName(_special(marked, key))


def woe_table(binned: DataFrame) -> DataFrame:
    """Events, rate, WoE and IV of every bin of every variable, bins in order of value."""
    cells = binned.groupBy("variable", "kind", "bin_key").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum(F.lit(1) - F.col("y")).alias("non_events"), F.sum("y").alias("events"))
    variable = Window.partitionBy("variable")  # a few bins each
    count = F.count(F.lit(1)).over(variable)
    good = (F.col("non_events") + SMOOTHING) / (F.sum("non_events").over(variable)
                                                + count * SMOOTHING)
    bad = (F.col("events") + SMOOTHING) / (F.sum("events").over(variable) + count * SMOOTHING)
    order = variable.orderBy(F.col("kind") == "null", "low", "high", "kind", "bin_key")
    woe = F.log(bad / good)
    return cells.select(
        "variable", "kind", "bin_key", (F.row_number().over(order) - 1).alias("bin_index"), "low",
        "high", "non_events", "events",
        (F.col("events") / (F.col("events") + F.col("non_events"))).alias("event_rate"),
        woe.alias("woe"), ((bad - good) * woe).alias("iv"))


def information_value(table: DataFrame) -> DataFrame:
    return table.groupBy("variable").agg(F.sum("iv").alias("iv"))


def cochran_armitage(table: DataFrame) -> DataFrame:
    """Linear trend of the event rate over the ordered bins without the NULL bin."""
    rows = table.filter("kind <> 'null'").select(
        "variable", F.col("bin_index").cast("double").alias("s"),
        (F.col("events") + F.col("non_events")).cast("double").alias("n"),
        F.col("events").cast("double").alias("r"))
    sums = rows.groupBy("variable").agg(
        F.sum("n").alias("N"), F.sum("r").alias("R"), F.sum(F.col("s") * F.col("r")).alias("SR"),
        F.sum(F.col("s") * F.col("n")).alias("SN"),
        F.sum(F.col("s") * F.col("s") * F.col("n")).alias("SSN"))
    p = F.col("R") / F.col("N")
    spread = p * (1 - p) * (F.col("SSN") - F.col("SN") * F.col("SN") / F.col("N"))
    return sums.select("variable", F.try_divide(F.col("SR") - p * F.col("SN"), F.sqrt(spread))
                       .alias("trend_z"))


def bin_monotonicity(table: DataFrame) -> DataFrame:
    """Spearman correlation of the bin order with the event rate (a handful of rows per variable)."""
    rows = table.filter("kind <> 'null'")
    per_rate = Window.partitionBy("variable", "event_rate")
    rank = (F.rank().over(Window.partitionBy("variable").orderBy("event_rate"))
            + (F.count(F.lit(1)).over(per_rate) - 1) / 2)
    return rows.withColumn("rate_rank", rank).groupBy("variable").agg(
        F.corr(F.col("bin_index").cast("double"), F.col("rate_rank")).alias("monotonicity"))


def u_shape(table: DataFrame) -> DataFrame:
    """Both end bins above the mean rate of the bins between the two outer ones."""
    rows = table.filter("kind <> 'null'")
    last = F.max("bin_index").over(Window.partitionBy("variable"))
    folded = rows.withColumn("last_bin", last).groupBy("variable").agg(
        F.max(F.when(F.col("bin_index") == 0, F.col("event_rate"))).alias("first_rate"),
        F.max(F.when(F.col("bin_index") == F.col("last_bin"), F.col("event_rate")))
         .alias("last_rate"),
        F.avg(F.when((F.col("bin_index") >= 2) & (F.col("bin_index") <= F.col("last_bin") - 2),
                     F.col("event_rate"))).alias("middle_rate"))
    return folded.withColumn("u_shaped", is_true((F.col("first_rate") > F.col("middle_rate"))
                                                 & (F.col("last_rate") > F.col("middle_rate"))))


def woe_encode(binned: DataFrame, table: DataFrame, key: str = "household_id") -> DataFrame:
    """Rows with the WoE of their bin; a bin unseen in training counts 0."""
    weights = table.select("variable", "kind", "bin_key", "woe")
    return binned.join(F.broadcast(weights), ["variable", "kind", "bin_key"], "left").select(
        key, "variable", "y", F.coalesce("woe", F.lit(0.0)).alias("woe"))


def woe_wide(encoded: DataFrame, variables: Sequence[str], key: str = "household_id") -> DataFrame:
    return encoded.groupBy(key).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("variable") == v, F.col("woe"))).alias(v)
                                 for v in variables])


def points_table(table: DataFrame, betas: Mapping[str, float]) -> DataFrame:
    """beta x WoE shifted to a minimum of 0 per variable; the best total is 100 points."""
    pairs = [F.lit(v) for pair in betas.items() for v in pair]
    rows = table.filter(F.col("variable").isin(*betas)).withColumn(
        "raw", F.try_element_at(F.create_map(*pairs), F.col("variable")) * F.col("woe"))
    per_variable = Window.partitionBy("variable")
    shifted = rows.withColumn("raw", F.col("raw") - F.min("raw").over(per_variable))
    tops = shifted.groupBy("variable").agg(F.max("raw").alias("top"))
    scale = tops.agg(F.sum("top").alias("total")).scalar()
    return shifted.select("variable", "kind", "bin_key", "bin_index", "woe",
                          (F.col("events") + F.col("non_events")).alias("n_train"),
                          (F.col("raw") * 100 / scale).alias("points"))


def scorecard_score(binned: DataFrame, points: DataFrame, key: str = "household_id") -> DataFrame:
    small = F.broadcast(points.select("variable", "kind", "bin_key", "points"))
    variables = points.select("variable").distinct()
    scored = (binned.join(F.broadcast(variables), "variable", "left_semi")
                    .join(small, ["variable", "kind", "bin_key"], "left"))
    return scored.groupBy(key).agg(F.sum(F.coalesce("points", F.lit(0.0))).alias("score"))


def select_by_correlation(values: Mapping[str, float], correlation, min_iv: float,
                          max_corr: float) -> list[str]:
    """Greedy choice by IV with pairwise |correlation| under the limit (a matrix of names)."""
    order = sorted((v for v in values if values[v] >= min_iv), key=lambda v: -values[v])
    kept: list[str] = []
    for name in order:
        if all(abs(correlation[name, other]) < max_corr for other in kept):
            kept.append(name)
    return kept
