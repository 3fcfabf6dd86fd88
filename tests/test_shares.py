"""Zero-inflated beta models: diagnostics against simulation, saved fits, guards."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.operators import glm
from understory.operators.likelihood import bernoulli_rows, beta_rows, log_gamma
from understory.operators.mixed import MixedFit, ZeroInflatedFit, load_fit, save_fit
from understory.operators.simulate import gamma_draws, zero_beta_dispersion, zero_beta_draws, zero_beta_moments, zero_beta_residuals
from understory.operators.trees import hash64

KEYS = hash64(3, np.arange(60_000))


def test_row_derivatives_are_slopes():
    rng = np.random.default_rng(0)
    eta, y, phi, h = rng.normal(size=50) * 2, rng.uniform(0.02, 0.98, 50), 7.3, 1e-5
    assert np.allclose(log_gamma(np.array([0.01, 0.5, 3, 40.0])), [math.lgamma(v) for v in (0.01, 0.5, 3, 40.0)])
    for rows in (lambda e, p: beta_rows(y, e, p), lambda e, p: bernoulli_rows((y > 0.5) * 1.0, e)):
        at, up, down = rows(eta, phi), rows(eta + h, phi), rows(eta - h, phi)
        more, less = rows(eta, phi * math.exp(h)), rows(eta, phi * math.exp(-h))
        for name, of, sign in (("g", "l", 1), ("w", "g", -1), ("t", "w", 1)):
            assert np.allclose(at[name], sign * (up[of] - down[of]) / (2 * h), rtol=1e-5, atol=1e-6)
        for name, of in (("lk", "l"), ("gk", "g"), ("wk", "w")):
            assert np.allclose(at[name], (more[of] - less[of]) / (2 * h), rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("shape", [0.2, 1.0, 7.5])
def test_gamma_draws(shape):
    x = gamma_draws(KEYS, np.full(len(KEYS), shape), 0)
    assert x.mean() == pytest.approx(shape, rel=0.03) and x.var() == pytest.approx(shape, rel=0.05)
    assert (x == gamma_draws(KEYS, np.full(len(KEYS), shape), 0)).all()


def test_moments_against_a_long_simulation():
    for zero, mu, phi in ((0.3, 0.2, 12.0), (0.0, 0.7, 3.0), (0.8, 0.05, 30.0)):
        x = zero_beta_draws(KEYS, np.full(len(KEYS), zero), np.full(len(KEYS), mu), phi)
        mean, variance = zero_beta_moments(zero, mu, phi)
        assert x.mean() == pytest.approx(mean, rel=0.03) and x.var() == pytest.approx(variance, rel=0.05)
        assert (x == 0).mean() == pytest.approx(zero, abs=0.01)


@pytest.fixture(scope="module")
def shares(spark):
    rng = np.random.default_rng(4)
    n = 3000
    zero, mu, phi = rng.uniform(0.1, 0.6, n), rng.uniform(0.1, 0.7, n), 9.0
    y = np.where(rng.random(n) < zero, 0.0, rng.beta(mu * phi, (1 - mu) * phi))
    return spark.createDataFrame(pd.DataFrame({"k": [f"r{j}" for j in range(n)], "y": y, "z": zero, "mu": mu, "site": [f"s{j % 5}" for j in range(n)],
                                               "plot_id": [f"p{j % 50}" for j in range(n)], "x": rng.normal(size=n)})).repartition(7)


def test_residuals_are_uniform_under_the_model(shares):
    res = zero_beta_residuals(shares, ["k"], "y", "z", "mu", 9.0, sims=100).toPandas()
    assert len(res) == 3000 and res.scaled_residual.between(0, 1).all()
    at = np.sort(res.scaled_residual.to_numpy())
    assert np.abs(at - (np.arange(3000) + 0.5) / 3000).max() < 1.63 / math.sqrt(3000)  # Kolmogorov-Smirnov at 1 %
    again = zero_beta_residuals(shares.repartition(3), ["k"], "y", "z", "mu", 9.0, sims=100).toPandas()
    assert (res.set_index("k").scaled_residual.sort_index() == again.set_index("k").scaled_residual.sort_index()).all()


def test_dispersion_finds_a_wrong_precision(shares):
    right = zero_beta_dispersion(shares, ["k"], "y", "z", "mu", 9.0, sims=100).first()
    assert right.dispersion == pytest.approx(1, abs=0.06) and right.p_value > 0.02
    wrong = zero_beta_dispersion(shares.withColumn("z", F.lit(0.0)).filter("y > 0"), ["k"], "y", "z", "mu", 100.0, sims=100).first()
    assert wrong.dispersion > 2 and wrong.p_value == 0
    assert zero_beta_residuals(shares.limit(0), ["k"], "y", "z", "mu", 9.0).count() == 0
    gap = shares.withColumn("y", F.when(F.col("k") == "r1", None).otherwise(F.col("y")))
    assert zero_beta_residuals(gap, ["k"], "y", "z", "mu", 9.0, sims=10).count() == 2999


def made_fit(spark):
    """A fit with chosen numbers: random effects of five sites and fifty plots."""
    rng = np.random.default_rng(1)
    modes = spark.createDataFrame([(f"s{s}", f"p{p}", 0.2 * s, float(rng.normal(0, 0.1))) for s in range(5) for p in range(50) if p % 5 == s],
                                  "site string, plot string, u_site double, u_plot double")
    same = dict(keys=("site", "plot_id"), n_rows=3000, n_dropped=2, modes=modes, n_iter=4, converged=True, loglik=-1.5)
    cond = MixedFit("beta", "y", ["(Intercept)", "x"], np.array([-0.5, 0.3]), np.diag([0.01, 0.02]), 0.4, 0.1, 9.0, **same)
    zero = MixedFit("binomial", "_is_zero", ["(Intercept)"], np.array([-0.8]), np.diag([0.03]), 0.3, 0.2, None, **same)
    return ZeroInflatedFit(zero, cond, 3)


def test_saved_fit_predicts_and_tests_as_before(spark, shares, tmp_path):
    fit = made_fit(spark)
    save_fit(fit, f"file://{tmp_path}/fit")
    read = load_fit(spark, f"file://{tmp_path}/fit")
    for of in (lambda f: f.predict(shares).select("k", "predicted"), lambda f: f.with_fit(f.coef_table()), lambda f: f.r_squared(shares)):
        assert sorted(map(tuple, of(read).collect())) == sorted(map(tuple, of(fit).collect()))
    assert read.n_params == fit.n_params == 3 + 5 and read.cond.covariance == fit.cond.covariance


def test_r_squared_and_overdispersion_of_shares(spark, shares):
    fit = made_fit(spark)
    at = fit.parts(shares).toPandas()
    got = fit.overdispersion(shares, "y").first()
    mean, variance = zero_beta_moments(at.p_zero, at.mu, 9.0)
    assert got.ratio == pytest.approx((((at.y - mean) ** 2 / variance).sum()) / (3000 - 8)) and got.residual_df == 2992
    x = at.x.to_numpy()
    z, c = 1 / (1 + math.exp(0.8)), (1 / (1 + np.exp(0.5 - 0.3 * x))).mean()
    draws = zero_beta_draws(KEYS, np.full(len(KEYS), z), np.full(len(KEYS), c), 9.0)
    residual = math.log1p(draws.var() / draws.mean() ** 2)
    assert fit.residual_variance(shares) == pytest.approx(residual, rel=0.03)
    r2 = fit.r_squared(shares).first()
    fixed = (0.3 * x).var(ddof=1)
    assert r2.r2_marginal == pytest.approx(fixed / (fixed + 0.17 + residual), rel=0.03)
    assert r2.r2_conditional == pytest.approx((fixed + 0.17) / (fixed + 0.17 + residual), rel=0.03)
    with pytest.raises(ValueError):
        fit.cond.residual_variance()


def test_curves_by_class_need_a_short_list(spark, monkeypatch):
    monkeypatch.setattr(glm, "MOST_CLASSES", 2)
    d = spark.createDataFrame([(0.0, "a"), (1.0, "b"), (2.0, "c")], "x double, c string")
    coefs, vcov = {"(Intercept)": 0.0, "x": 1.0}, {(a, b): 0.0 for a in ("(Intercept)", "x") for b in ("(Intercept)", "x")}
    with pytest.raises(ValueError):
        glm.effect_curve(d, "x", coefs, vcov, by="c")
    assert glm.effect_curve(d.filter("c <> 'c'"), "x", coefs, vcov, by="c").count() == 4


def test_packed_plots_lie_in_several_files_and_keep_their_rows(spark, monkeypatch):
    """Passes over the packed rows run in several tasks however few bytes they are; runs of all plots are cut at RUN_ROWS."""
    from understory.operators import mixed
    monkeypatch.setattr(mixed, "RUN_ROWS", 4)
    rows = [(f"s{k % 3}", f"p{k % 41}" if k % 7 else "hot", float(k % 5) / 7 + 0.1, float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "site string, plot_id string, y double, x double")
    prob = mixed._Problem(df, "y", ["x"], "site", "plot_id", "beta")
    small, large = prob.runs
    assert len(small.inputFiles()) > 1
    got = {}
    for r in small.select("_s", "_p", "_ys", "_xs").collect() + large.select("_s", "_p", "_ys", "_xs").collect():
        ys, xs = np.frombuffer(r._ys), np.frombuffer(r._xs)
        assert 0 < len(ys) <= 4 and len(xs) == len(ys)
        got.setdefault((r._s, r._p), []).extend(zip(ys.tolist(), np.round(xs * prob.scale[0] + prob.mean[0]).tolist()))
    want = {}
    for s, p, y, x in rows:
        want.setdefault((s, p), []).append((y, x))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
