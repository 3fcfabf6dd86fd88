"""Fixed-effect logit model, tests, tables, diagnostics and effect curves."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions.labels import effect_group
from understory.functions.scalars import excludes_zero, percent_if_invasion, round_to, significance_stars
from understory.functions.special import inv_logit
from understory.operators.verbs import map_numeric, stack_tagged

COEF_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"
MOST_CLASSES = 1000  # of a predictor that curves are repeated for
Z95 = 1.959963984540054  # 97.5 % point of the normal distribution


def coef_frame(spark, terms: Sequence[str], est, se) -> DataFrame:
    """Tidy coefficient table from driver-side vectors of a model's few terms."""
    rows = []
    for t, b, s in zip(terms, map(float, est), map(float, se)):
        z = b / s if s and s > 0 else None
        rows.append((t, b, s, z, None if z is None else math.erfc(abs(z) / math.sqrt(2))))
    return spark.createDataFrame(rows, COEF_SCHEMA)


def binomial_logit(df: DataFrame, label: str, features: Sequence[str]):
    """Binomial GLM by distributed iteratively reweighted least squares.

    Returns the fitted model and its coefficient table, intercept first.
    """
    features = list(features)
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(
        df.withColumn("_y", F.col(label).cast("double")))
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y",
                                        maxIter=50, tol=1e-10).fit(data.select("_x", "_y"))
    se = list(model.summary.coefficientStandardErrors)  # intercept comes last
    est = [model.intercept, *model.coefficients]
    return model, coef_frame(df.sparkSession, ["(Intercept)", *features], est, [se[-1], *se[:-1]])


def linear_predictor(coefs: Mapping[str, float]) -> Column:
    """Sum of coefficient times column, plus the intercept."""
    eta = F.lit(float(coefs.get("(Intercept)", 0.0)))
    for term, b in coefs.items():
        if term != "(Intercept)":
            eta = eta + F.lit(float(b)) * F.col(term)
    return eta


def predict_response(df: DataFrame, coefs: Mapping[str, float], out: str = "predicted") -> DataFrame:
    """Prediction on new data from the fixed effects."""
    return df.withColumn(out, inv_logit(linear_predictor(coefs)))


def wald_tests(coefs: DataFrame) -> DataFrame:
    """One-degree-of-freedom chi-square per term, intercept left out.

    The upper tail of z squared is the two-sided tail of z, which the table has.
    """
    stat = F.try_divide(F.col("estimate"), F.col("std_error"))
    return (coefs.filter(F.col("term") != "(Intercept)")
            .select("term", (stat * stat).alias("statistic"), F.lit(1).alias("df"), "p_value"))


def test_table(tables: Mapping[str, DataFrame], digits: int = 2) -> DataFrame:
    """Stack tests of several responses, add stars, round."""
    out = stack_tagged(tables, "resp").withColumn("star", significance_stars(F.col("p_value")))
    return map_numeric(out, lambda c: round_to(c, digits), exclude=["df"]).select(
        "resp", "term", "statistic", "df", "p_value", "star")


def coefficient_intervals(coefs: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """95 % intervals of the fixed effects with a significance label.

    `coefs` has effect, component, term, estimate, std_error. `titles` names the
    conditional and the other component.
    """
    half = F.lit(Z95) * F.col("std_error")
    out = (coefs.filter((F.col("effect") != "ran_pars") & (F.col("term") != "(Intercept)"))
           .withColumns({"conf_low": F.col("estimate") - half, "conf_high": F.col("estimate") + half}))
    component = F.when(F.col("component") == "cond", titles["cond"]).otherwise(titles["zi"])
    return out.select("term", component.alias("component"), "estimate", "conf_low", "conf_high",
                      F.when(excludes_zero(F.col("conf_low"), F.col("conf_high")), "Significant")
                      .otherwise("Not\nSignificant").alias("sig"))


def overdispersion(df: DataFrame, y: Column, mu: Column, variance: Column, n_params: int,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Sum of squared Pearson residuals over the residual degrees of freedom."""
    r = F.try_divide((y - mu) * (y - mu), variance)
    return df.groupBy(*keys).agg(
        F.sum(r).alias("pearson_chi2"), (F.count(r) - n_params).alias("residual_df"),
        F.try_divide(F.sum(r), F.count(r) - n_params).alias("ratio"))


def r_squared(df: DataFrame, coefs: Mapping[str, float], random_variance: float,
              residual_variance: float = math.pi**2 / 3) -> DataFrame:
    """Marginal and conditional R2; the default residual variance is the logit link's."""
    fixed = F.var_samp(linear_predictor(coefs))
    total = fixed + F.lit(float(random_variance + residual_variance))
    return df.agg((fixed / total).alias("r2_marginal"),
                  ((fixed + F.lit(float(random_variance))) / total).alias("r2_conditional"))


def collinearity(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factor per predictor: diagonal of the inverse correlation matrix.

    The correlation matrix (predictors squared) is the only thing that reaches the driver.
    """
    features = list(features)
    vec = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features).dropna())
    corr = Correlation.corr(vec, "_x").head()[0].toArray()
    vif = np.diag(np.linalg.inv(corr))
    return df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, vif)], "term string, vif double")


def uniform_draw(seed: int, *cols: Column) -> Column:
    """A repeatable uniform number in (0,1) from a seeded hash of the given columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52))


def scaled_residuals(df: DataFrame, key: str, y: str, mu: str, sims: int = 250, seed: int = 0) -> DataFrame:
    """Share of simulated 0/1 outcomes below the observed one, ties split at random.

    The simulations of a row are an array expression inside the row: no copy of
    the data and no shuffle.
    """
    draws = F.transform(F.sequence(F.lit(1), F.lit(sims)), lambda i: F.when(
        uniform_draw(seed, F.col(key), i) < F.col(mu), 1).otherwise(0))
    ones = F.aggregate(draws, F.lit(0), lambda acc, x: acc + x)
    below = F.when(F.col(y) == 1, F.lit(sims) - ones).otherwise(F.lit(0))
    equal = F.when(F.col(y) == 1, ones).otherwise(F.lit(sims) - ones)
    u = uniform_draw(seed + 1, F.col(key))
    return df.withColumn("scaled_residual", (below + u * equal) / F.lit(float(sims)))


def dispersion_test(df: DataFrame, key: str, y: str, mu: str, sims: int = 250, seed: int = 0) -> DataFrame:
    """Residual variance over its simulated mean, with a two-sided simulated p-value.

    Each row expands to its simulations in place and collapses to one partial sum
    per simulation before the shuffle.
    """
    resid = F.col(y) - F.col(mu)
    observed = df.agg(F.var_samp(resid).alias("v"))
    sim = df.select(key, mu, F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("_s"))
    drawn = F.when(uniform_draw(seed, F.col(key), F.col("_s")) < F.col(mu), 1.0).otherwise(0.0)
    per_sim = sim.groupBy("_s").agg(F.var_samp(drawn - F.col(mu)).alias("v"))
    v = observed.scalar()
    lower = F.avg(F.when(F.col("v") <= F.col("_obs"), 1.0).otherwise(0.0))
    upper = F.avg(F.when(F.col("v") >= F.col("_obs"), 1.0).otherwise(0.0))
    return per_sim.withColumn("_obs", v).agg(
        F.try_divide(F.max("_obs"), F.avg("v")).alias("dispersion"),
        F.least(F.lit(1.0), F.lit(2.0) * F.least(lower, upper)).alias("p_value"))


def effect_curve(df: DataFrame, term: str, coefs: Mapping[str, float], vcov: Mapping[tuple[str, str], float],
                 by: str | None = None) -> DataFrame:
    """Prediction at every observed value of one predictor, the others at their mean.

    With `by`, the curve is repeated for each observed value of a second
    predictor. The 95 % interval is built on the link scale.
    """
    others = [t for t in coefs if t not in {"(Intercept)", term, by}]
    means = df.agg(*[F.avg(t).alias(t) for t in others]) if others else None
    at = df.select(term, *([by] if by else [])).filter(F.col(term).isNotNull()).distinct() if not by else \
        _combinations(df, term, by)
    for t in others:
        at = at.withColumn(t, means.select(t).scalar())
    terms = list(coefs)
    value = {t: F.lit(1.0) if t == "(Intercept)" else F.col(t) for t in terms}
    eta = linear_predictor(coefs)
    var = F.lit(0.0)
    for a in terms:
        for b in terms:
            var = var + value[a] * value[b] * F.lit(float(vcov[a, b]))
    half = F.sqrt(F.greatest(var, F.lit(0.0))) * Z95
    return at.select(F.lit(term).alias("group"), F.col(term).cast("double").alias("x"),
                     *([F.col(by).alias("facet")] if by else []),
                     inv_logit(eta).alias("predicted"), inv_logit(eta - half).alias("conf_low"),
                     inv_logit(eta + half).alias("conf_high"))


def _combinations(df: DataFrame, term: str, by: str) -> DataFrame:
    """Every class value against every x: the class list travels as one array, so it has to be short."""
    named = df.select(by).filter(F.col(by).isNotNull()).distinct()
    if len(named.limit(MOST_CLASSES + 1).collect()) > MOST_CLASSES:
        raise ValueError(f"{by} has over {MOST_CLASSES} values: no class to repeat a curve for")
    classes = named.agg(F.collect_list(by).alias("c"))
    xs = df.select(term).filter(F.col(term).isNotNull()).distinct()
    return xs.select(term, F.explode(classes.scalar()).alias(by))


def effects_frame(curves: Mapping[str, DataFrame]) -> DataFrame:
    """Stack effect curves of several responses, label their group, show 'Invasion ...' in percent."""
    out = stack_tagged(curves, "response")
    r = F.col("response")
    return out.withColumn("type", effect_group(F.col("group"))).withColumns(
        {c: percent_if_invasion(r, F.col(c)) for c in ("predicted", "conf_low", "conf_high")})
