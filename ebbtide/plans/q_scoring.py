"""Queries of scorecards, weight of evidence, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.contract import CALIBRATION_TARGETS, PRIMARY_COLUMNS
from ebbtide.functions.columns import text_rule
from ebbtide.operators import boosting, calibration, evaluate, models, profiles, woe
from ebbtide.operators.labels import stratified_split
from ebbtide.operators.lineage import cut_lineage, stored
from ebbtide.plans import features as plan
from ebbtide.plans.registry import query
from ebbtide.sources import adapters as src

P = plan.DEFAULT
CONTEXT = ["log_relationship_value", "tenure_years", "age_primary", "is_uhnw", "has_investments", "has_trust",
           "has_credit_anchor", "has_linked_business"]
PRIMARIES = [c for c in PRIMARY_COLUMNS.values() if c != "multi_signal_flag"] + ["multi_signal_count"]
VARIABLES = PRIMARIES + CONTEXT


def frame(spark, sf, groups=None):
    """The model frame of the eligible households: all primaries and context columns, and the labels.

    Values are rounded so that equal ratios stay equal.  The frame is read several times (mass
    points, ranks, bins, models), so it is written once.
    """
    context = {"log_relationship_value": F.log("relationship_value"), "is_uhnw": F.col("segment") == "UHNW"}
    value = lambda c: F.round(context.get(c, F.col(c)).cast("double"), 9).alias(c)
    rows = plan.full_base(spark, sf, groups=groups).filter(~F.col("churn_excluded"))
    return cut_lineage(rows.select("household_id", "segment", "hard_churn_6m", "soft_churn_3m", "relationship_value",
                                   "external_outflow_pct_30d", "external_outflow_pct_90d", *map(value, VARIABLES)))


def _long(spark, sf):
    return woe.long_form(frame(spark, sf), VARIABLES, "hard_churn_6m")


def _binned(spark, sf):
    return woe.quantile_bins(_long(spark, sf), P.woe_bins, P.woe_mass_point)


def _edge_binned(spark, sf):
    long = _long(spark, sf)
    return cut_lineage(woe.edge_bins(long, woe.fit_edges(long, P.woe_bins, P.woe_mass_point),
                                     woe.mass_points(long, P.woe_mass_point)))


@query("woe_table")
def woe_table(spark, sf):
    return woe.woe_table(_binned(spark, sf)).drop("kind", "bin_key")


@query("woe_document_quality")
def woe_documents(spark, sf):
    """WoE of the text length against the toxicity label."""
    docs = src.table(spark, sf, "documents").select("doc_id", "n_chars").join(
        src.table(spark, sf, "labels"), "doc_id")
    long = woe.long_form(docs, ["n_chars"], "toxic", "doc_id")
    return woe.woe_table(woe.quantile_bins(long, 10, 0.05, "doc_id")).drop("kind", "bin_key")


@query("information_value")
def information_value(spark, sf):
    return woe.information_value(woe.woe_table(_binned(spark, sf)))


@query("cochran_armitage")
def cochran_armitage(spark, sf):
    return woe.cochran_armitage(woe.woe_table(_binned(spark, sf)))


@query("bin_monotonicity")
def bin_monotonicity(spark, sf):
    return woe.bin_monotonicity(woe.woe_table(_binned(spark, sf)))


@query("u_shape_check")
def u_shape_check(spark, sf):
    return woe.u_shape(woe.woe_table(_binned(spark, sf)))


@query("woe_bin_fit")
def woe_bin_fit(spark, sf):
    edges = woe.fit_edges(_long(spark, sf), P.woe_bins, P.woe_mass_point)
    return edges.select("variable", F.posexplode("edges").alias("position", "edge"))


@query("woe_encode")
def woe_encode(spark, sf):
    binned = _edge_binned(spark, sf)
    return woe.woe_encode(binned, woe.woe_table(binned)).select("household_id", "variable", "woe")


@query("points_table")
def points_table(spark, sf):
    table = woe.woe_table(_edge_binned(spark, sf))
    return woe.points_table(table, {v: 1.0 for v in VARIABLES}).select(
        "variable", "bin_index", "n_train", "points")


@query("scorecard_score")
def scorecard_score(spark, sf):
    binned = _edge_binned(spark, sf)
    points = woe.points_table(woe.woe_table(binned), {v: 1.0 for v in VARIABLES})
    return woe.scorecard_score(binned, points)


@query("pearson_pair")
def pearson_pair(spark, sf):
    h = src.household(spark, sf).filter("salary_base_annual IS NOT NULL")
    return h.agg(F.corr(F.log("salary_base_annual"), F.log("relationship_value")).alias("rho"))


@query("iv_corr_selection")
def iv_corr_selection(spark, sf):
    card = models.fit_scorecard(frame(spark, sf), VARIABLES, "hard_churn_6m", P)
    rows = [(i, v, float(card["iv"][v])) for i, v in enumerate(card["kept"])]
    return spark.createDataFrame(rows, "position int, variable string, iv double")


@query("woe_logistic")
def woe_logistic(spark, sf):
    rows = frame(spark, sf)
    card = models.fit_scorecard(rows, VARIABLES, "hard_churn_6m", P)
    return models.apply_scorecard(card, rows, "hard_churn_6m")


def _model_rows(spark, sf, groups=None):
    """The frame with the monthly sequence and the split, and the names of the sequence columns."""
    sequence = profiles.log_relative_sequence(src.monthly(spark, sf))
    rows = stratified_split(frame(spark, sf, groups), "hard_churn_6m", "household_id", P)
    return (cut_lineage(rows.join(sequence, "household_id", "left")),
            [c for c in sequence.columns if c.startswith("seq_")])


def fitted_scores(spark, sf, groups=None):
    """Every household of the frame with its split and the probabilities of the fitted models."""
    rows, sequence = _model_rows(spark, sf, groups)
    fitted = models.fit_models(rows.filter("split = 'train'"), VARIABLES, sequence, "hard_churn_6m")
    kept = rows.select("household_id", "split", "segment", F.col("hard_churn_6m").alias("label"),
                       F.col("relationship_value").alias("value"))
    return models.predict(fitted, rows).join(kept, "household_id")


@query("score_all_models")
def score_all_models(spark, sf):
    """Boosted trees, logistic and neural probabilities of every household with its split."""
    return fitted_scores(spark, sf).drop("segment", "label", "value")


@query("fitted_model_comparison")
def fitted_model_comparison(spark, sf):
    """The evaluation table of the fitted models on the test share, with the expert and rule scores.

    The models and the expert read the same features, so these are written once.
    """
    groups = stored(plan.seven_groups(spark, sf))
    scores = fitted_scores(spark, sf, groups).filter("split = 'test'")
    plain = evaluate.expert_scorecard(groups).join(business_rules(spark, sf), "household_id")
    names = {"trees": "trees_prob", "linear": "linear_prob", "neural": "neural_prob", "expert": "expert_score", "rules": "rules_score"}
    rows = scores.join(plain, "household_id", "left")
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"), (
        F.col(c) if c.endswith("_prob") else F.lit(None)).cast("double").alias("prob")) for m, c in names.items()])
    long = rows.select("household_id", "segment", "label", "value", F.explode(pairs).alias("p")).select(
        "household_id", "segment", "label", "value", "p.*")
    return evaluate.model_comparison(cut_lineage(long))


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows, _ = _model_rows(spark, sf)
    trees = boosting.fit(rows.filter("split = 'train'"), VARIABLES, "hard_churn_6m")
    return models.permutation_importance(trees, rows.filter("split = 'test'"), "hard_churn_6m")


@query("logit_wald")
def logit_wald(spark, sf):
    return models.wald(frame(spark, sf), "soft_churn_3m", ["tenure_years", "relationship_value"])


@query("ols_wald")
def ols_wald(spark, sf):
    return models.wald(src.household(spark, sf), "tenure_years", ["age_primary", "relationship_value"],
                       "gaussian")


@query("combined_auc")
def combined_auc(spark, sf):
    area = models.combined_auc(frame(spark, sf), PRIMARIES, "soft_churn_3m")
    return spark.createDataFrame([("soft_churn_3m", area)], "label string, auc double")


@query("sort_by_abs")
def sort_by_abs(spark, sf):
    """Strongest rank correlations first."""
    return spearman_matrix(spark, sf).filter(F.abs("rho") >= 0.01).orderBy(F.desc(F.abs("rho")))


@query("calibration_run_gate")
def calibration_run_gate(spark, sf):
    """Calibration repeated per run; here the runs are the two halves of the split."""
    rows = cut_lineage(stratified_split(frame(spark, sf), "hard_churn_6m", "household_id", P))
    runs = [calibration.variable_calibration(rows.filter(F.col("split") == s), CALIBRATION_TARGETS,
                                             "hard_churn_6m", P) for s in ("train", "test")]
    return calibration.run_gate(runs[0].unionByName(runs[1]), CALIBRATION_TARGETS, P)


@query("spearman_matrix")
def spearman_matrix(spark, sf):
    """Every pair of primaries over the households that have both."""
    return models.spearman_pairs(frame(spark, sf), PRIMARIES).drop("rows")


@query("model_frame")
def model_frame(spark, sf):
    """The 37 primaries (count instead of flag), eight context columns, the sequence and the labels."""
    from ebbtide.plans.q_ledgers import churn
    rows, sequence = _model_rows(spark, sf)
    return rows.select("household_id", "segment", *VARIABLES, *sequence).join(churn(spark, sf), "household_id")


# ---------------------------------------------------------------- evaluation
@query("business_rules")
def business_rules(spark, sf):
    wide = plan.complaints(spark, sf).join(plan.banker(spark, sf), "household_id")
    return evaluate.business_rules(wide)


@query("expert_scorecard")
def expert_scorecard(spark, sf):
    return evaluate.expert_scorecard(plan.seven_groups(spark, sf))


def _totals(spark, sf, by=("model",)):
    return evaluate.score_totals(src.scores(spark, sf), list(by))


@query("auc")
def auc(spark, sf):
    return evaluate.auc(_totals(spark, sf), ["model"]).select("model", "auc")


@query("gini")
def gini(spark, sf):
    return evaluate.auc(_totals(spark, sf), ["model"]).select("model", "gini")


@query("auc_by_segment")
def auc_by_segment(spark, sf):
    by = ["model", "segment"]
    return evaluate.auc(_totals(spark, sf, by), by).select(*by, "auc")


@query("ks_stat")
def ks_stat(spark, sf):
    return evaluate.ks(_totals(spark, sf), ["model"])


@query("brier")
def brier(spark, sf):
    return evaluate.probability_metrics(src.scores(spark, sf), ["model"]).select("model", "brier")


@query("mean_prob_vs_observed")
def mean_prob(spark, sf):
    return evaluate.probability_metrics(src.scores(spark, sf), ["model"]).drop("brier")


@query("top_k_list")
def top_k_list(spark, sf):
    s = src.scores(spark, sf)
    return evaluate.top_list(s, evaluate.score_totals(s, ["model"]), ["model"], 0.10)


@query("top_k_metrics")
def top_k_metrics(spark, sf):
    s = src.scores(spark, sf)
    totals = evaluate.score_totals(s, ["model"])
    return evaluate.top_lists(s, totals, ["model"], [0.05, 0.10])


@query("calibration_deciles")
def calibration_deciles(spark, sf):
    return evaluate.calibration_deciles(src.scores(spark, sf), ["model"])


@query("model_comparison")
def model_comparison(spark, sf):
    return evaluate.model_comparison(src.scores(spark, sf))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    metrics = evaluate.bootstrap_metrics(src.scores(spark, sf), 200, 11)
    return evaluate.bootstrap_intervals(metrics, "statistical")


@query("lift_alert")
def lift_alert(spark, sf):
    rows = frame(spark, sf).filter("aum_outflow_pct_90d IS NOT NULL").withColumn(
        "alert", text_rule("> 0.10", "aum_outflow_pct_90d"))
    return evaluate.lift_of_alert(rows, "alert", "hard_churn_6m")


def variable_calibration_frame(spark, sf):
    return calibration.variable_calibration(frame(spark, sf), CALIBRATION_TARGETS, "hard_churn_6m", P)


@query("variable_calibration")
def variable_calibration(spark, sf):
    return variable_calibration_frame(spark, sf)


@query("final_variable_report")
def final_variable_report(spark, sf):
    """Catalogue id, target, NULL share, alert share, IV, lift and trend of every primary variable."""
    ids = {c.replace("multi_signal_flag", "multi_signal_count"): i for i, c in PRIMARY_COLUMNS.items()}
    listed = spark.createDataFrame([(v, ids[v], *map(float, t[1:5])) for v, t in CALIBRATION_TARGETS.items()],
                                   "variable string, variable_id int, rate_low double, rate_high double, iv_low double, iv_high double")
    return variable_calibration_frame(spark, sf).join(F.broadcast(listed), "variable")


@query("calibration_gate")
def calibration_gate(spark, sf):
    return calibration.calibration_gate(variable_calibration_frame(spark, sf), CALIBRATION_TARGETS, P)
