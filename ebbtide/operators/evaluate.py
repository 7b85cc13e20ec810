"""Score evaluation from value-folded score tables: AUC, KS, top lists, calibration, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.contract import EXPERT_POINTS
from ebbtide.functions.columns import is_true
from ebbtide.operators.lineage import cut_lineage
from ebbtide.operators.ordering import equal_freq_buckets, row_ranks, running_totals, with_blocks

#: Households whose draws are taken together.
RANK_BLOCK = 4096


def score_totals(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    label = F.col("label")
    return running_totals(scores.filter(label.isNotNull()), "score", {
        "n": F.lit(1), "pos": label, "lost": F.col("value") * label}, by)


def _area() -> Column:
    negatives = F.col("n") - F.col("pos")
    below = F.col("lt_n") - F.col("lt_pos")
    wins = F.sum(F.col("pos") * (below + negatives / 2.0))
    pairs = F.max(F.col("tot_pos").cast("double") * (F.col("tot_n") - F.col("tot_pos")))
    return F.try_divide(wins, pairs)


def _distance() -> Column:
    pos = F.try_divide("lt_pos", "tot_pos")
    neg = F.try_divide(F.col("lt_n") - F.col("lt_pos"), F.col("tot_n") - F.col("tot_pos"))
    return F.max(F.abs(pos - neg))


def auc(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties, Gini."""
    return totals.groupBy(*by).agg(_area().alias("auc"), (_area() * 2 - 1).alias("gini"))


def ks(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest distance of the two cumulative rates, ties taken together."""
    return totals.groupBy(*by).agg(_distance().alias("ks"))


def _list_of(fraction: float) -> Column:
    """What a list of ``round(n * fraction)`` rows holds of whole score levels, and the level that it cuts."""
    size = F.bround(F.col("tot_n") * fraction, 0)
    above = F.col("tot_n") - F.col("lt_n") - F.col("n")
    inside = above + F.col("n") <= size
    cut = (above < size) & ~inside
    return F.struct(F.lit(fraction).alias("fraction"), F.max(size).alias("size"),
                    *[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(c) for c in ("pos", "lost")],
                    F.max(F.when(cut, F.col("score"))).alias("score"),
                    F.max(F.when(cut, size - above)).alias("places"))


def list_metrics(scores: DataFrame, totals: DataFrame, by: Sequence[str], fractions: Sequence[float],
                 key: str = "household_id") -> DataFrame:
    """One row per group: AUC, Gini, KS and an array ``lists`` of what the riskiest rows of each fraction hold.

    The totals are folded once.  Whole score levels come from them; only rows tied at a cut are
    ranked by key.
    """
    by = list(by)
    one = totals.groupBy(*by).agg(
        _area().alias("auc"), _distance().alias("ks"), F.max("tot_n").alias("rows"), F.max("tot_pos").alias("tot_pos"),
        F.max("tot_lost").alias("tot_lost"), *[_list_of(f).alias(f"_l{k}") for k, f in enumerate(fractions)])
    # One row per group, read for the cuts and for the result.
    one = cut_lineage(one.withColumn("lists", F.array(*[f"_l{k}" for k in range(len(fractions))])).drop(
        *[f"_l{k}" for k in range(len(fractions))]))
    cuts = one.select(*by, F.explode("lists").alias("_l")).select(*by, "_l.fraction", "_l.score", "_l.places").filter(
        "places IS NOT NULL")
    tied = row_ranks(scores.join(cuts, [*by, "score"]), key, key, [*by, "fraction"])
    extra = tied.filter(F.col("row_rank") <= F.col("places")).groupBy(*by, "fraction").agg(
        F.sum("label").alias("extra_pos"), F.sum(F.col("value") * F.col("label")).alias("extra_lost"))
    named = extra.groupBy(*by).agg(F.map_from_entries(F.collect_list(  # an entry per fraction
        F.struct("fraction", F.struct("extra_pos", "extra_lost")))).alias("_extra"))

    def row(one_list: Column) -> Column:
        more = F.try_element_at(F.col("_extra"), one_list["fraction"])
        pos = one_list["pos"] + F.coalesce(more["extra_pos"], F.lit(0))
        lost = one_list["lost"] + F.coalesce(more["extra_lost"], F.lit(0.0))
        precision = F.try_divide(pos, one_list["size"])
        return F.struct(one_list["fraction"].alias("fraction"), one_list["size"].cast("long").alias("size"),
                        precision.alias("precision"), F.try_divide(pos, F.col("tot_pos")).alias("recall"),
                        F.try_divide(precision, F.col("tot_pos") / F.col("rows")).alias("lift"),
                        F.try_divide(lost, F.col("tot_lost")).alias("value_captured"))
    return one.join(named, by, "left").select(
        *by, "auc", (F.col("auc") * 2 - 1).alias("gini"), "ks", F.transform("lists", row).alias("lists"))


def top_lists(scores: DataFrame, totals: DataFrame, by: Sequence[str], fractions: Sequence[float],
              key: str = "household_id") -> DataFrame:
    """Precision, recall, lift and value captured by the ``round(n * fraction)`` riskiest rows."""
    found = list_metrics(scores, totals, by, fractions, key)
    return found.select(*by, F.explode("lists").alias("_l")).select(*by, "_l.*")


def top_list(scores: DataFrame, totals: DataFrame, by: Sequence[str], fraction: float,
             key: str = "household_id") -> DataFrame:
    return top_lists(scores, totals, by, [fraction], key)


def probability_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("prob") - F.col("label")
    return scores.filter(F.col("prob").isNotNull()).groupBy(*by).agg(
        F.avg("prob").alias("mean_prob"), F.avg("label").alias("observed"),
        F.avg(gap * gap).alias("brier"))


def calibration_deciles(scores: DataFrame, by: Sequence[str], key: str = "household_id",
                        groups: int = 10) -> DataFrame:
    known = scores.filter(F.col("prob").isNotNull())
    bucketed = equal_freq_buckets(known, "prob", key, groups, by, "decile")
    return bucketed.groupBy(*by, (F.col("decile") + 1).alias("decile")).agg(
        F.avg("prob").alias("mean_prob"), F.avg("label").alias("observed"),
        F.count(F.lit(1)).alias("n"))


def model_comparison(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    by = list(by)
    fractions = (0.05, 0.10)
    found = list_metrics(scores, score_totals(scores, by), by, fractions)
    lists = [F.col("lists")[k][c].alias(f"{c}_top_{round(f * 100)}") for k, f in enumerate(fractions)
             for c in ("precision", "recall", "lift", "value_captured")]
    return found.select(*by, "auc", "gini", "ks", *lists).join(probability_metrics(scores, by), by, "left")


def _drawn(block: int, rows: int, replicates: int, seed: int) -> np.ndarray:
    """Draws (replicates, rows of the block) of ``rows`` draws with replacement from ``rows`` rows.

    Binomials split each replicate's draws down a tree of rank ranges, so every block finds its own
    part of one multinomial sample without seeing the others.
    """
    lo, hi = 0, -(-rows // RANK_BLOCK)
    count = np.full(replicates, rows)
    edge = lambda k: min(k * RANK_BLOCK, rows)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).binomial(count, (edge(mid) - edge(lo)) / (edge(hi) - edge(lo)))
        lo, hi, count = (lo, mid, left) if block < mid else (mid, hi, count - left)
    size = edge(hi) - edge(lo)
    return np.random.default_rng([seed, lo, hi]).multinomial(count, np.full(size, 1.0 / size))


def resample(scores: DataFrame, replicates: int, seed: int, key: str = "household_id") -> DataFrame:
    """Paired bootstrap: (key, ``weights``), how often each replicate draws the household.

    One row per household carries its counts of all replicates as 16-bit numbers, so the draws
    themselves are never shuffled and all models share them.
    """
    def weigh(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_rank")
        drawn = _drawn(int(keys[0]), int(part["row_count"].iloc[0]), replicates, seed).astype("<u2").T
        return pd.DataFrame({key: part[key].to_numpy(), "weights": [w.tobytes() for w in drawn]})

    ids = row_ranks(scores.select(key).distinct(), key, key)
    blocks = ids.groupBy(F.floor((F.col("row_rank") - 1) / RANK_BLOCK).alias("block"))
    return blocks.applyInPandas(weigh, f"{key} {dict(scores.dtypes)[key]}, weights binary")


def _weight_chunks(part: pd.DataFrame, replicates: int):
    """Rows in order with their weights (rows, replicates), some thousands at a time."""
    for at in range(0, len(part), RANK_BLOCK):
        rows = part.iloc[at:at + RANK_BLOCK]
        yield rows, np.frombuffer(b"".join(rows["weights"]), "<u2").reshape(len(rows), replicates).astype(np.int64)


def _block_totals(replicates: int, key: str):
    """Per replicate: drawn rows, positives and value lost of one block, score level by level at its ends.

    Scores at the ends of a block may go on in the next one, so they stay apart; the levels between
    them are whole and give one part with the pairs won inside it.
    """
    def totals(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["risk", key])
        first, last = part["risk"].iloc[0], part["risk"].iloc[-1]
        sums = {}
        seen = level_pos = level_neg = np.zeros(replicates)  # positives before the running level, and the level so far
        level = None
        for rows, w in _weight_chunks(part, replicates):
            risk, label = rows["risk"].to_numpy(), rows["label"].to_numpy()[:, None]
            pos, lost = w * label, w * label * rows["value"].to_numpy()[:, None]
            place = np.where(risk == first, 0, np.where(risk == last, 2, 1))
            for p in np.unique(place):
                at = place == p
                total = sums.setdefault(int(p), np.zeros((4, replicates)))
                total[:3] += w[at].sum(axis=0), pos[at].sum(axis=0), lost[at].sum(axis=0)
            inner = place == 1
            if not inner.any():
                continue
            risk, pos, neg = risk[inner], pos[inner], (w - pos)[inner]
            starts = np.r_[0, np.flatnonzero(risk[1:] != risk[:-1]) + 1]
            pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
            if risk[0] != level:
                seen, level_pos, level_neg = seen + level_pos, 0.0, 0.0
            every_pos, every_neg = pos.copy(), neg.copy()
            every_pos[0] += level_pos
            every_neg[0] += level_neg
            before = seen + np.cumsum(every_pos, axis=0) - every_pos
            # A positive wins over the negatives met later, half over those of its own level.
            sums[1][3] += (neg * before).sum(axis=0) + ((every_pos * every_neg).sum(axis=0) - level_pos * level_neg) / 2
            seen, level_pos, level_neg, level = before[-1], every_pos[-1], every_neg[-1], risk[-1]
        return pd.concat([pd.DataFrame({
            "model": keys[0], "block": keys[1], "place": place, "risk": {0: first, 2: last}.get(place, 0.0),
            "replicate": np.arange(replicates), "n": t[0], "pos": t[1], "lost": t[2], "won": t[3]})
            for place, t in sums.items()])
    return totals


def _cut_block(replicates: int, key: str):
    """Value lost inside the cut of each replicate whose list ends in the block."""
    def captured(keys: tuple, part: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["risk", key])
        wanted = cuts["replicate"].to_numpy()
        left, total = cuts["places"].to_numpy().astype(np.int64), np.zeros(len(wanted))
        for rows, w in _weight_chunks(part, replicates):
            drawn = w[:, wanted]
            above = np.cumsum(drawn, axis=0) - drawn
            taken = np.clip(left[None, :] - above, 0, drawn)
            total += (taken * (rows["label"] * rows["value"]).to_numpy()[:, None]).sum(axis=0)
            left = left - drawn.sum(axis=0)
        return pd.DataFrame({"model": keys[0], "replicate": wanted, "extra": total})
    return captured


def bootstrap_metrics(scores: DataFrame, replicates: int, seed: int, fraction: float = 0.10,
                      key: str = "household_id") -> DataFrame:
    """AUC and value captured per (replicate, model) over the labelled rows.

    Rows are cut into blocks by (score, key).  A first pass leaves few totals per block and
    replicate, which give the AUC and the block where each list ends; only those blocks are read
    again.  Lists hold whole draws: ties are ranked by key, and a household drawn twice fills two
    places.  Replicates without a positive or without a negative have no row.
    """
    known = scores.filter("label IS NOT NULL AND score IS NOT NULL").select(
        key, "model", (-F.col("score").cast("double")).alias("risk"), F.col("label").cast("double").alias("label"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    known = cut_lineage(known)
    rows = cut_lineage(with_blocks(known, ["risk", key], ["model"]).withColumnRenamed("_block", "block")
                       .join(resample(known, replicates, seed, key), key))
    model = f"model {dict(known.dtypes)['model']}, "
    parts = cut_lineage(rows.groupBy("model", "block").applyInPandas(
        _block_totals(replicates, key), model + "block int, place int, risk double, replicate int, n double, pos double, "
                                                "lost double, won double"))
    by = ["model", "replicate"]
    # A level that runs on through several blocks is one step of the order.
    inner = F.when(F.col("place") == 1, F.col("block")).alias("inner")
    steps = parts.groupBy(*by, "risk", inner).agg(
        F.min(F.col("block") * 3 + F.col("place")).alias("order"), F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sum("won").alias("won"))
    earlier = Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    won = F.when(F.col("inner").isNull(), F.col("pos") * neg / 2).otherwise(F.col("won"))
    area = steps.withColumn("won", won + neg * F.coalesce(F.sum("pos").over(earlier), F.lit(0.0))).groupBy(*by).agg(
        F.try_divide(F.sum("won"), F.sum("pos") * F.sum(neg)).alias("auc"))
    whole = Window.partitionBy(*by)
    blocks = parts.groupBy(*by, "block").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).select(
        *by, "block", "n", "lost", F.bround(F.sum("n").over(whole) * fraction, 0).alias("size"),
        F.coalesce(F.sum("n").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))
    ends = (F.col("above") < F.col("size")) & (F.col("above") + F.col("n") > F.col("size"))
    cuts = cut_lineage(blocks.filter(ends).select(*by, "block", (F.col("size") - F.col("above")).alias("places")))
    extra = rows.join(cuts.select("model", "block").distinct(), ["model", "block"], "left_semi").groupBy("model", "block").cogroup(
        cuts.groupBy("model", "block")).applyInPandas(_cut_block(replicates, key), model + "replicate int, extra double")
    lists = blocks.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("above") + F.col("n") <= F.col("size"), F.col("lost"))), F.lit(0.0)).alias("inside"),
        F.sum("lost").alias("all_lost"))
    captured = lists.join(extra, by, "left").select(*by, F.try_divide(
        F.col("inside") + F.coalesce("extra", F.lit(0.0)), "all_lost").alias("value_captured"))
    return area.filter("auc IS NOT NULL").join(captured, by)


def bootstrap_intervals(metrics: DataFrame, reference: str) -> DataFrame:
    """95% intervals per model and of the AUC difference against the reference model."""
    def interval(c: str, tag: str) -> list:
        return [F.percentile(F.col(c), F.lit(p)).alias(f"{tag}_{n}")
                for n, p in (("low", 0.025), ("high", 0.975))]

    base = metrics.filter(F.col("model") == reference).select(
        "replicate", F.col("auc").alias("ref_auc"))
    joined = metrics.join(base, "replicate").withColumn("delta", F.col("auc") - F.col("ref_auc"))
    folded = joined.groupBy("model").agg(  # one row per replicate
        *interval("auc", "auc"), *interval("value_captured", "captured"),
        F.avg("delta").alias("delta_auc"), *interval("delta", "delta"))
    return folded.withColumn("real_difference",
                             (F.col("delta_low") > 0) | (F.col("delta_high") < 0))


def business_rules(features: DataFrame) -> DataFrame:
    fired = (is_true(F.col("relationship_dissatisfaction_flag") == 1)
             | is_true(F.col("complaint_age_days") > 30) | is_true(F.col("contact_gap_ratio") > 2.0))
    return features.select("household_id", fired.cast("double").alias("rules_score"))


def expert_scorecard(features: DataFrame) -> DataFrame:
    points = sum((F.when(is_true(F.expr(rule)), F.lit(float(p))).otherwise(0.0)
                  for p, rule in EXPERT_POINTS), F.lit(0.0))
    return features.select("household_id", F.least(points, F.lit(100.0)).alias("expert_score"))


def lift_of_alert(rows: DataFrame, alert: str, label: str) -> DataFrame:
    y = F.col(label).cast("double")
    return rows.agg(F.avg(F.when(F.col(alert), y)).alias("rate_in"),
                    F.avg(F.when(~F.col(alert), y)).alias("rate_out")).withColumn(
        "lift", F.try_divide("rate_in", "rate_out"))
