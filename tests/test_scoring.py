import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import evaluate, models, near_duplicates, statistics as st, woe
from ebbtide.params import Params


def scores(spark, y, s):
    rows = [("m", i, int(a), float(b), 1.0) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "model string, household_id long, label int, score double, "
                                       "value double")


def test_perfect_score(spark):
    y = [0, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    df = scores(spark, y, y)
    totals = evaluate.score_totals(df, ["model"])
    assert evaluate.ks(totals, ["model"]).first().ks == 1
    assert evaluate.auc(totals, ["model"]).first().auc == 1
    top = evaluate.top_list(df, totals, ["model"], 0.3).first()
    assert (top.precision, top.recall, top.size) == (1.0, 1.0, 3)


def test_ties_at_the_cut_go_to_the_lowest_key(spark):
    df = scores(spark, [1, 0, 0, 1], [5, 5, 5, 5])
    top = evaluate.top_list(df, evaluate.score_totals(df, ["model"]), ["model"], 0.5).first()
    assert top.precision == 0.5 and top.recall == 0.5  # households 0 and 1


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200), np.round(rng.normal(size=200), 1)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    got = evaluate.auc(evaluate.score_totals(scores(spark, y, s), ["model"]), ["model"]).first().auc
    assert got == pytest.approx(np.mean(pairs))


def test_expert_score_is_capped(spark):
    row = spark.range(1).select(
        F.lit(1).alias("household_id"), F.lit(1).alias("relationship_dissatisfaction_flag"),
        F.lit(.2).alias("external_transfer_pct_of_balance_60d"),
        F.lit(1).alias("recurring_deposit_stopped_flag"),
        F.lit(None).cast("double").alias("recurring_deposit_change_pct"),
        F.lit(.3).alias("investment_redemption_pct"), F.lit(.0).alias("aum_outflow_pct_90d"),
        F.lit(31).alias("complaint_age_days"), F.lit(2.5).alias("contact_gap_ratio"),
        F.lit(1).alias("banker_change_6m_flag"))
    assert evaluate.expert_scorecard(row).first().expert_score == 100.0


def drawn_counts(df, replicates, seed):
    return {r.household_id: np.frombuffer(r.weights, "<u2").astype(int)
            for r in evaluate.resample(df, replicates, seed).collect()}


def test_bootstrap_draws_every_row_count(spark, monkeypatch):
    df = scores(spark, [0, 1] * 50, range(100))
    whole = drawn_counts(df, 5, 3)
    assert (sum(whole.values()) == 100).all() and len(whole) == 100
    assert all((whole[k] == w).all() for k, w in drawn_counts(df.repartition(3), 5, 3).items())
    assert evaluate.bootstrap_metrics(df, 5, 3).count() == 5
    # Ranges of several blocks share the draws by binomials: all add up, means and variances stay.
    monkeypatch.setattr(evaluate, "RANK_BLOCK", 16)
    parts = np.concatenate([evaluate._drawn(b, 100, 4000, 9) for b in range(7)], axis=1)
    assert parts.shape == (4000, 100) and (parts.sum(axis=1) == 100).all()
    assert np.abs(parts.mean(axis=0) - 1).max() < 0.08 and np.abs(parts.var(axis=0) - 0.99).max() < 0.12


def test_bootstrap_equals_brute_force_with_ties(spark, monkeypatch):
    """Ties across blocks and chunks, a level that holds most rows, two models, NULL labels."""
    from ebbtide.operators import ordering
    monkeypatch.setattr(ordering, "LEAST_CUT", 10)
    rng = np.random.default_rng(4)
    rows = []
    for model, score in (("even", rng.integers(0, 40, 600) / 40), ("hot", np.where(rng.random(600) < 0.7, 0.5, rng.random(600)))):
        rows += [(i, model, float(s), None if i % 50 == 7 else float(i % 3 == 0), float(i % 11)) for i, s in enumerate(score)]
    df = spark.createDataFrame(rows, "household_id long, model string, score double, label double, value double")
    known = df.filter("label IS NOT NULL")
    weights = drawn_counts(known, 6, 2)
    got = {(r.model, r.replicate): r for r in evaluate.bootstrap_metrics(df, 6, 2).collect()}
    assert len(got) == 12
    for (model, replicate), r in got.items():
        mine = [x for x in rows if x[1] == model and x[3] is not None]
        pos = [(s, weights[i][replicate]) for i, _, s, y, _ in mine if y]
        neg = [(s, weights[i][replicate]) for i, _, s, y, _ in mine if not y]
        wins = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in pos for t, b in neg)
        assert r.auc == pytest.approx(wins / (sum(a for _, a in pos) * sum(b for _, b in neg)))
        drawn = [x for x in sorted(mine, key=lambda x: (-x[2], x[0])) for _ in range(weights[x[0]][replicate])]
        top = drawn[:round(len(drawn) * 0.10)]
        assert r.value_captured == pytest.approx(sum(x[3] * x[4] for x in top) / sum(x[3] * x[4] for x in drawn))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 2000
    x = np.where(rng.random(n) < 0.4, 0.0, rng.gamma(2, 2, n))
    z = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(2.5 - 0.5 * x))).astype(int)
    pdf = pd.DataFrame({"household_id": np.arange(n), "x": x, "z": z, "y": y})
    pdf.loc[::17, "x"] = np.nan
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_woe_bins_and_trend(rows):
    long = woe.long_form(rows, ["x"], "y")
    table = woe.woe_table(woe.quantile_bins(long, 10, 0.05)).toPandas()
    assert (table.kind == "m").sum() == 1 and (table.kind == "null").sum() == 1
    assert table.events.sum() + table.non_events.sum() == 2000
    good = (table.non_events + .5) / (table.non_events.sum() + .5 * len(table))
    bad = (table.events + .5) / (table.events.sum() + .5 * len(table))
    np.testing.assert_allclose(table.woe, np.log(bad / good))
    z = woe.cochran_armitage(woe.woe_table(woe.quantile_bins(long, 10, 0.05))).first().trend_z
    assert z > 5


def test_scorecard_points_span_zero_to_hundred(rows):
    card = models.fit_scorecard(rows, ["x", "z"], "y", Params())
    assert "x" in card["kept"]
    out = models.apply_scorecard(card, rows, "y").toPandas()
    assert len(out) == 2000 and out.woe_score.between(0, 100 + 1e-9).all()
    assert out.woe_prob.between(0, 1).all()
    assert np.corrcoef(out.woe_score, out.woe_prob)[0, 1] > 0.9


def test_wald_recovers_the_slope(rows):
    got = models.wald(rows, "y", ["x", "z"]).toPandas().set_index("term")
    assert abs(got.loc["x", "coefficient"] - 0.5) < 3 * got.loc["x", "std_error"]
    assert got.loc["z", "p_value"] > 0.001


def test_mardia_equals_pairwise_form(spark):
    x = np.random.default_rng(1).normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = st.mardia(df, list("abc")).first()
    xc = x - x.mean(0)
    d = xc @ np.linalg.inv(np.cov(xc.T, bias=True)) @ xc.T
    assert got.skewness_stat == pytest.approx(300 * (d ** 3).sum() / 300 ** 2 / 6)


def test_bh_is_monotone_and_bounded(spark):
    p = [.001, .02, .03, .5, .9]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = [r.p_bh for r in st.bh_adjust(df, "p", "k").orderBy("k").collect()]
    assert all(a >= b for a, b in zip(got, p)) and got == sorted(got) and max(got) <= 1
    assert got[0] == pytest.approx(.005)


def test_pareto_and_t_fits(spark):
    rng = np.random.default_rng(2)
    u = rng.random(20_000)
    x = (1 - u * (1 - 10.0 ** (-3 * 1.5))) ** (-1 / 1.5)
    row = st.pareto_tail_alpha(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 1.0, 1000.0).first()
    assert abs(row.alpha - 1.5) < 4 * row.std_error
    assert st.pareto_tail_alpha(spark.createDataFrame([(500.0,), (900.0,)], "x double"), "x", 1.0, 1000.0).first().alpha is None
    n, m, r = len(x), np.log(x).mean(), math.log(1000.0)
    score = lambda a: 1 / a - r / math.expm1(a * r) - m
    assert abs(score(row.alpha)) < 1e-10
    assert row.std_error == pytest.approx(1 / math.sqrt(-n * (score(row.alpha + 1e-5) - score(row.alpha - 1e-5)) / 2e-5), rel=1e-4)
    assert st.truncated_normal_kurtosis(-30, 30) == pytest.approx(0, abs=1e-9)


def test_near_duplicates_with_copies_and_negative_cells(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(150, 3)), np.tile([0.1, 0.2, 0.3], (40, 1)),
                     [[0.1, 0.2, 0.309]], [[-1e-4, 5, 5]], [[1e-4, 5, 5]]])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=list("abc")).assign(
        id=range(len(pts)), flags="f"))
    got = near_duplicates.near_neighbours(df, "id", list("abc"), "flags", 0.05).toPandas()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = d.min(1)
    want = {i: near[i] for i in range(len(pts)) if near[i] < 0.05}
    assert dict(zip(got.id, got.nearest)).keys() == want.keys()
    np.testing.assert_allclose([want[i] for i in got.id], got.nearest, atol=1e-12)


def test_evaluation_and_moments_of_tiny_groups(spark):
    """One class, two or three rows, a constant column: NULL, never an error."""
    from ebbtide.operators import evaluate, statistics
    scores = spark.createDataFrame([("a", i, 0.1 * i, 0, 1.0, 0.2) for i in range(4)] + [("b", 9, 0.5, 1, 1.0, 0.4)],
                                   "model string, household_id long, score double, label int, value double, prob double")
    assert {r.model: r.ks for r in evaluate.model_comparison(scores).collect()} == {"a": None, "b": None}
    tiny = spark.createDataFrame([("two", 1.0), ("two", 2.0), ("three", 1.0), ("three", 2.0), ("three", 4.0),
                                  ("same", 3.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("same", 3.0)], "g string, x double")
    assert statistics.moments(tiny, "x", ["g"]).count() == 3
    assert statistics.l_moments(tiny, "x", ["g"]).count() == 3
    assert statistics.hill_alpha(tiny, "x", ["g"]).count() == 3
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(6)], "k long, a double, b double")
    assert statistics.spearman_test(line, [("a", "b")], "k").first().rho == 1.0


@pytest.mark.parametrize("nu, scale", [(3.0, 2.0), (6.0, 0.5), (60.0, 1.0)])
def test_t_fit_is_the_maximum(spark, nu, scale):
    z = np.random.default_rng(int(nu)).standard_t(nu, 20_000) * scale
    got = st.student_t_fit(spark.createDataFrame(pd.DataFrame({"z": z})).repartition(3), "z").first()

    def level(v, s):
        const = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(s)
        return len(z) * const - (v + 1) / 2 * np.log1p(z * z / (v * s * s)).sum()
    assert got.log_likelihood == pytest.approx(level(got.nu, got.scale), rel=1e-12)
    slopes = [(level(got.nu * (1 + e), got.scale * (1 + d)) - level(got.nu * (1 - e), got.scale * (1 - d))) for e, d in ((1e-4, 0), (0, 1e-4))]
    assert all(abs(x) < 1e-4 for x in slopes)
    assert abs(math.log(got.nu / nu)) < (0.1 if nu < 10 else 1.5) and abs(got.scale / scale - 1) < 0.05


def test_t_fit_of_odd_tables(spark):
    normal = np.random.default_rng(0).uniform(-1, 1, 500)
    assert st.student_t_fit(spark.createDataFrame(pd.DataFrame({"z": normal})), "z").first().nu == pytest.approx(1e6)
    assert st.student_t_fit(spark.createDataFrame([(None,), (0.0,)], "z double"), "z").first().nu is None
    assert st.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13) and st.trigamma(1.0) == pytest.approx(math.pi ** 2 / 6, abs=1e-13)


def test_models_and_expert_read_features_that_are_worked_out_once(spark, monkeypatch):
    from ebbtide.plans import features, q_scoring
    seen = []

    def groups(spark, sf):
        seen.append("groups")
        odd = F.col("id") % 2
        return spark.range(40).select(F.col("id").alias("household_id"), odd.alias("signal"))

    def frame(spark, sf, groups):
        rows = groups.withColumn("split", F.lit("test"))
        return rows.select("*", F.lit("HNW").alias("segment"), (F.col("signal").cast("int")).alias("hard_churn_6m"),
                           F.lit(1.0).alias("relationship_value")), []
    model = F.col("signal").cast("double")
    monkeypatch.setattr(features, "seven_groups", groups)
    monkeypatch.setattr(q_scoring, "_model_rows", lambda spark, sf, found=None: frame(
        spark, sf, groups(spark, sf) if found is None else found))
    monkeypatch.setattr(models, "fit_models", lambda *a, **k: None)
    monkeypatch.setattr(models, "predict", lambda fitted, rows: rows.select(
        F.col("household_id"), *[model.alias(f"{m}_prob") for m in ("trees", "linear", "neural")]))
    monkeypatch.setattr(evaluate, "expert_scorecard", lambda df: df.select("household_id", F.col("signal").alias("expert_score")))
    monkeypatch.setattr(q_scoring, "business_rules", lambda spark, sf: spark.range(40).select(
        F.col("id").alias("household_id"), F.lit(0.0).alias("rules_score")))
    found = {r["model"]: r["auc"] for r in q_scoring.fitted_model_comparison(spark, "none").collect()}
    assert seen == ["groups"]
    assert found == {"trees": 1.0, "linear": 1.0, "neural": 1.0, "expert": 1.0, "rules": 0.5}


def test_inputs_are_measured_once_for_all_models(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"household_id": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300), "s": rng.normal(size=300)})
    pdf["y"] = (pdf.a + rng.normal(size=300) > 0).astype(int)
    pdf.loc[::7, "b"] = np.nan
    rows = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    calls = []
    monkeypatch.setattr(models, "fit_inputs", lambda *a, fit=models.fit_inputs: calls.append(a[1]) or fit(*a))
    fitted = models.fit_models(rows, ["a", "b"], ["s"], "y", iterations=1, epochs=1)
    assert calls == [["a", "b", "s"]]
    alone = models.fit_linear(rows, ["a", "b"], "y", 0.5)
    assert fitted["linear"].inputs == alone.inputs and fitted["linear"].weights == alone.weights


def test_trees_grow_beside_the_other_models(spark, monkeypatch):
    import threading
    from ebbtide.operators import boosting, neural
    rows = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "household_id long, a double, y int")
    begun = threading.Event()
    monkeypatch.setattr(boosting, "fit", lambda *a, **k: "trees" if begun.wait(60) else "alone")
    monkeypatch.setattr(neural, "fit", lambda *a, **k: begun.set())
    assert models.fit_models(rows, ["a"], [], "y")["trees"] == "trees"
