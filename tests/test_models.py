"""Forests, explanation, PCA, logit and mixed models on simulated data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from understory.operators import glm
from understory.operators.explain import centered_logit, partial_dependence_exact, partial_dependence_fast
from understory.operators.forest import (CrossValidation, Fit, ModelSpec, assemble, holdout_metrics, holdout_predictions,
                                         permutation_importance, run_cv)
from understory.operators.mixed import fit_mixed, fit_zero_inflated_beta
from understory.operators.pca import pca
from understory.operators.resample import analysis
from understory.session import stored


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 600
    x, noise = rng.uniform(0, 10, n), rng.normal(size=n)
    y = 2.0 * x + rng.normal(size=n)
    pdf = pd.DataFrame({"plot_id": [f"p{k % 60}" for k in range(n)], "year": np.arange(n) // 60, "x": x, "noise": noise,
                        "y": y, "c": (x > 5).astype(int)})
    return spark.createDataFrame(pdf)


def test_forest_metrics_and_importance(sample):
    f = ("x", "noise")
    cv = run_cv(sample, [ModelSpec("r", "y", "reg", f), ModelSpec("c", "c", "class", f)], v=3, trees=15, max_depth=6, seed=1)
    preds = holdout_predictions(cv)
    assert preds.filter("response = 'r'").count() == 600
    est = {(r.response, r.fold): r.est for r in holdout_metrics(preds).collect()}
    assert len(est) == 6 and min(v for v in est.values()) > 0.8
    imp = permutation_importance(cv, seed=2).groupBy("response", "var").agg(F.avg("value").alias("v")).collect()
    imp = {(r.response, r["var"]): r.v for r in imp}
    assert imp["r", "x"] > 20 and abs(imp["r", "noise"]) < 1 and imp["c", "x"] > 0.2 and abs(imp["c", "noise"]) < 0.05


def test_partial_dependence_of_a_linear_model_is_its_slope(sample):
    spec = ModelSpec("r", "y", "reg", ("x", "noise"))
    folded = sample.withColumn("fold", (F.substring("plot_id", 2, 3).cast("int") % 2))
    data = stored(assemble(folded, spec.features).select("plot_id", "year", "fold", "y", "features"), "lin", "fold")
    fits = [Fit(k, spec, LinearRegression(featuresCol="features", labelCol="y").fit(analysis(data, k))) for k in (0, 1)]
    cv = CrossValidation(data, fits, spec.features, ("plot_id", "year"))
    slope = {f.fold: f.model.coefficients[0] for f in fits}
    for pdp in (partial_dependence_exact(cv, ["x"], points=5), partial_dependence_fast(cv, points=5).filter("name = 'x'")):
        for k, part in pdp.toPandas().groupby("rep"):
            part = part.sort_values("value")
            assert len(part) == 5
            assert np.allclose(np.diff(part.yhat) / np.diff(part.value), slope[k])


def test_centered_logit(spark):
    r = spark.range(1).select(centered_logit(F.lit(0.8), F.lit(0.2)).alias("a"), centered_logit(F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert r.a == pytest.approx(math.log(0.8) - (math.log(0.8) + math.log(0.2)) / 2) and r.b < -15


def test_pca_against_svd(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    d = spark.createDataFrame(pd.DataFrame(a, columns=list("abcd")).assign(k=range(200)))
    scores, load = pca(d, list("abcd"), 2, ["k"])
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    v = np.linalg.svd(z, full_matrices=False)[2][:2].T
    v = v * np.where(v[np.abs(v).argmax(0), range(2)] < 0, -1, 1)
    got = load.toPandas().set_index("var").loc[list("abcd"), ["pc1", "pc2"]].to_numpy()
    assert np.allclose(got, v)
    assert np.allclose(scores.toPandas().sort_values("k")[["pc1", "pc2"]].to_numpy(), z @ v)


@pytest.fixture(scope="module")
def nested(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(25):
        us = rng.normal(0, 0.7)
        for p in range(12):
            up = rng.normal(0, 0.5)
            for _ in range(8):
                x = rng.normal(3, 2)
                mu = 1 / (1 + math.exp(1 - 0.4 * x - us - up))
                b = float(np.clip(rng.beta(mu * 12, (1 - mu) * 12), 1e-6, 1 - 1e-6))
                rows.append((f"s{s}", f"s{s}p{p}", x, float(rng.random() < mu), b, b if rng.random() < 0.7 else 0.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["site", "plot_id", "x", "y", "b", "zib"]))


def test_binomial_mixed_model_recovers_parameters(nested):
    fit = fit_mixed(nested, "y", ["x"])
    assert fit.converged
    se = np.sqrt(np.diag(fit.vcov))
    assert abs(fit.coefs["x"] - 0.4) < 3 * se[1] and abs(fit.coefs["(Intercept)"] + 1) < 3 * se[0]
    assert 0.4 < fit.sigma_site < 1.1 and 0.2 < fit.sigma_plot < 0.8
    p = fit.predict(nested).agg(F.avg("predicted").alias("p"), F.avg("y").alias("y")).first()
    assert p.p == pytest.approx(p.y, abs=0.02)
    r2 = glm.r_squared(nested, fit.coefs, fit.random_variance).first()
    assert 0 < r2.r2_marginal < r2.r2_conditional < 1
    curve = glm.effect_curve(nested, "x", fit.coefs, fit.covariance).orderBy("x").toPandas()
    assert curve.predicted.is_monotonic_increasing and (curve.conf_low < curve.conf_high).all()


def test_zero_inflated_beta_splits_and_recovers(nested):
    fit = fit_zero_inflated_beta(nested, "zib", ["x"])
    assert abs(fit.cond.coefs["x"] - 0.4) < 0.05 and 8 < fit.cond.phi < 16
    assert 1 / (1 + math.exp(-fit.zero.coefs["(Intercept)"])) == pytest.approx(0.3, abs=0.04)
    with pytest.raises(ValueError):
        fit_mixed(nested, "zib", ["x"], family="beta")


def test_logit_residuals_and_collinearity(nested):
    model, coefs = glm.binomial_logit(nested, "y", ["x"])
    assert {r.term for r in coefs.collect()} == {"(Intercept)", "x"}
    w = glm.wald_tests(coefs).first()
    assert w.df == 1 and 0 <= w.p_value < 0.001
    b = {r.term: r.estimate for r in coefs.collect()}
    d = glm.predict_response(nested.withColumn("k", F.monotonically_increasing_id()), b)
    d = stored(d, "resid")
    res = glm.scaled_residuals(d, "k", "y", "predicted").agg(F.avg("scaled_residual").alias("m"), F.min("scaled_residual").alias("lo"),
                                                             F.max("scaled_residual").alias("hi")).first()
    assert res.m == pytest.approx(0.5, abs=0.03) and res.lo >= 0 and res.hi <= 1
    t = glm.dispersion_test(d, "k", "y", "predicted").first()
    assert 0.9 < t.dispersion < 1.1 and t.p_value > 0.01
    v = {r.term: r.vif for r in glm.collinearity(nested, ["x", "b"]).collect()}
    assert v["x"] == pytest.approx(v["b"]) and v["x"] > 1
    table = glm.coef_frame(nested.sparkSession, ["x"], [1.959963984540054], [1.0])
    w = glm.wald_tests(table).first()
    assert w.statistic == pytest.approx(3.841458820694124) and w.p_value == pytest.approx(0.05)


def test_gradient_is_the_slope_of_the_laplace_likelihood(nested):
    from understory.operators import mixed

    few = nested.filter("site IN ('s0', 's1', 's2', 's3', 's4')")
    for family, label, more in (("binomial", "y", []), ("beta", "b", [2.2])):
        prob = mixed._Problem(few, label, ["x"], "site", "plot_id", family)
        theta = np.array([-0.3, 0.5, -0.4, -0.9, *more])
        at, state = prob.settle(theta)
        m = len(theta)
        near = [sign * 1e-3 * np.eye(m)[i] for i in range(m) for sign in (1, -1)]
        found, _ = prob.totals([theta + n for n in near], prob.plot_sums(theta, state, near))
        slope = [(found[2 * i]["value"] - found[2 * i + 1]["value"]) / 2e-3 for i in range(m)]
        assert np.allclose(at["grad"], slope, rtol=0.01, atol=0.05), family


def test_plots_are_not_shuffled_and_frequent_ones_have_many_runs(nested, monkeypatch):
    from understory.operators import mixed

    few = nested.filter("site IN ('s0', 's1', 's2')")
    theta = np.array([-0.3, 0.5, -0.4, -0.9, 2.2])
    found = []
    for rows in (4096, 3):
        monkeypatch.setattr(mixed, "RUN_ROWS", rows)
        prob = mixed._Problem(few, "b", ["x"], "site", "plot_id", "beta")
        whole, large = prob.runs
        assert (large is None) == (rows == 4096)
        if large is None:
            assert whole.count() == few.select("site", "plot_id").distinct().count()  # one row a plot, however its rows came
        at, state = prob.settle(theta)
        plan = prob.plot_sums(theta, state, [0 * theta])._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(_p" in plan or "hashpartitioning(_s" in plan) == (large is not None)
        effects = sorted((*r,) for frame in state[:2] if frame is not None for r in frame.select("_s", "_p", "_u", "_v").collect())
        found.append((at["value"], at["grad"], prob.hessian(theta, state), [e[2:] for e in effects], [e[:2] for e in effects]))
    (v1, g1, h1, e1, k1), (v2, g2, h2, e2, k2) = found
    assert v1 == pytest.approx(v2) and np.allclose(g1, g2) and np.allclose(h1, h2) and np.allclose(e1, e2) and k1 == k2
