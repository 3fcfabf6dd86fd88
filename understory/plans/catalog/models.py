"""PCA, generalized linear and mixed models, their tests, tables and effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.labels import RESPONSE_TITLE
from understory.functions.scalars import round_to
from understory.operators import glm
from understory.operators.joins import left_join
from understory.operators.mixed import (MixedFit, ZeroInflatedFit, fit_mixed, fit_zero_inflated_beta, load_fit, save_fit,
                                        saved_fit)
from understory.operators.pca import pca
from understory.operators.simulate import zero_beta_dispersion, zero_beta_residuals
from understory.plans.catalog.aggregates import rounded
from understory.plans.catalog.ecology_spatial import model_table
from understory.plans.fixtures import Inputs
from understory.plans.registry import query
from understory.session import scratch_path, stored

STRUCTURE_14 = ("vai", "vci", "vert_sd", "q25", "q50", "gfp", "entropy", "rumple", "vert_cv", "top_rugosity",
                "deepgap_fraction", "mean_max_canopy_ht", "max_canopy_ht", "cover_fraction")
TERMS = ("nspp_native", "rumple", "entropy", "mean_max_canopy_ht")


def mixed_table(i: Inputs, *more: str) -> DataFrame:
    """Model rows that have a time since change (which leaves the Alaskan sites out), written once."""
    rows = model_table(i).filter(F.col("days_since_change").isNotNull())
    return stored(rows.select("site", "plot_id", "year", "i_cat", "rer", "rel_cover_exotic", *TERMS, *more), "mixed-rows")


def invasion_model(rows: DataFrame) -> MixedFit:
    return saved_fit(rows, "invasion-model", lambda d: fit_mixed(d, "i_cat", TERMS))


def rate_model(rows: DataFrame) -> ZeroInflatedFit:
    return saved_fit(rows, "rate-model", lambda d: fit_zero_inflated_beta(d, "rer", TERMS, drop_ones=True))


def impact_model(rows: DataFrame) -> ZeroInflatedFit:
    return saved_fit(rows, "impact-model", lambda d: fit_zero_inflated_beta(d, "rel_cover_exotic", TERMS, drop_ones=True))


#: Response and model of the two shares.
SHARES = {"rer": rate_model, "rel_cover_exotic": impact_model}


def complete(rows: DataFrame, label: str) -> DataFrame:
    """The rows that a model of `label` was fitted on."""
    known = rows.dropna(subset=[label, *TERMS])
    return known if label == "i_cat" else known.filter(F.col(label) < 1)


def stacked(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@query("gl1_pca_scores")
def gl1(i: Inputs) -> DataFrame:
    scores, _ = pca(i.view("v_structure"), STRUCTURE_14, k=2, keys=["plot_id"])
    return scores.select("plot_id", round_to(F.col("pc1"), 5).alias("pc1_order"), round_to(F.col("pc2"), 5).alias("pc2_sa_vol"))


@query("gl1_pca_loadings")
def gl1_loadings(i: Inputs) -> DataFrame:
    _, load = pca(i.view("v_structure"), STRUCTURE_14, k=2, keys=["plot_id"])
    return rounded(load, 5, "pc1", "pc2")


# one 0/1 predictor has a closed form: cell counts of response by predictor
_CELLS = """WITH t AS (SELECT CASE WHEN i_cat = 1 THEN 1 ELSE 0 END AS y, CASE WHEN nspp_native > 5 THEN 1 ELSE 0 END AS x
           FROM v_plot_year),
c AS (SELECT CAST(count(CASE WHEN x = 0 AND y = 1 THEN 1 END) AS DOUBLE) AS a,
             CAST(count(CASE WHEN x = 0 AND y = 0 THEN 1 END) AS DOUBLE) AS b,
             CAST(count(CASE WHEN x = 1 AND y = 1 THEN 1 END) AS DOUBLE) AS d,
             CAST(count(CASE WHEN x = 1 AND y = 0 THEN 1 END) AS DOUBLE) AS e FROM t),
k AS (SELECT '(Intercept)' AS term, ln(a / b) AS est, sqrt(1 / a + 1 / b) AS se FROM c
      UNION ALL SELECT 'many_natives', ln(d / e) - ln(a / b), sqrt(1 / a + 1 / b + 1 / d + 1 / e) FROM c)"""


def logit_input(i: Inputs) -> DataFrame:
    return i.plot_year.select("i_cat", F.when(F.col("nspp_native") > 5, 1.0).otherwise(0.0).alias("many_natives"))


@query("gl2_binomial_logit", _CELLS + """
SELECT term, round(est, 4) AS estimate, round(se, 4) AS std_error, round(est / se, 3) AS statistic FROM k""")
def gl2(i: Inputs) -> DataFrame:
    _, coefs = glm.binomial_logit(logit_input(i), "i_cat", ["many_natives"])
    return rounded(coefs.drop("p_value"), 4, "estimate", "std_error").withColumn(
        "statistic", round_to(F.col("statistic"), 3))


@query("gl3_nested_random_intercepts")
def gl3(i: Inputs) -> DataFrame:
    fit = invasion_model(mixed_table(i))
    return rounded(fit.with_fit(fit.coef_table().withColumns({"sigma_site": F.lit(fit.sigma_site), "sigma_plot": F.lit(fit.sigma_plot),
                                                              "loglik": F.lit(fit.loglik)})), 4, "estimate", "std_error", "statistic",
                   "p_value", "sigma_site", "sigma_plot", "loglik")


@query("gl4_beta_regression")
def gl4(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    out = stacked(fit.with_fit(fit.cond.coef_table().withColumns({"response": F.lit(label), "phi": F.lit(fit.cond.phi)}))
                  for label, fit in ((label, model(rows)) for label, model in SHARES.items()))
    return rounded(out, 4, "estimate", "std_error", "statistic", "p_value", "phi")


@query("gl5_zero_share", """
SELECT site, round(avg(CASE WHEN rer IS NULL THEN NULL WHEN rer = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share
FROM v_plot_year GROUP BY site""")
def gl5_share(i: Inputs) -> DataFrame:
    return i.plot_year.groupBy("site").agg(round_to(F.avg((F.col("rer") == 0).cast("double")), 6).alias("zero_share"))


@query("gl5_zero_inflated_beta")
def gl5(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    out = stacked(fit.with_fit(fit.coef_table()).withColumn("response", F.lit(label))
                  for label, fit in ((label, model(rows)) for label, model in SHARES.items()))
    return rounded(out, 4, "estimate", "std_error", "statistic", "p_value")


@query("gl5_zero_part_covariates")
def gl5_covariates(i: Inputs) -> DataFrame:
    """The impact with predictors in both parts, scores of the structure metrics among them."""
    scores, _ = pca(i.view("v_structure"), STRUCTURE_14, k=2, keys=["plot_id"])
    scores = scores.select("plot_id", F.col("pc1").alias("pc1_order"), F.col("pc2").alias("pc2_sa_vol"))
    rows = stored(left_join(mixed_table(i, "latitude", "mat"), scores, ["plot_id"]), "mixed-rows")
    fit = saved_fit(rows, "impact-hurdle", lambda d: fit_zero_inflated_beta(
        d, "rel_cover_exotic", ("pc1_order", "latitude"), ("latitude", "mat", "nspp_native", "pc2_sa_vol"), drop_ones=True))
    return rounded(fit.with_fit(fit.coef_table()), 4, "estimate", "std_error", "statistic", "p_value")


@query("gl6_wald_tests", _CELLS + """
SELECT term, round(pow(est / se, 2), 2) AS statistic, 1 AS df FROM k WHERE term <> '(Intercept)'""")
def gl6(i: Inputs) -> DataFrame:
    _, coefs = glm.binomial_logit(logit_input(i), "i_cat", ["many_natives"])
    return glm.wald_tests(coefs).select("term", round_to(F.col("statistic"), 2).alias("statistic"), "df")


@query("gl7_test_table", """
SELECT resp, term, round(statistic, 2) AS statistic, 1 AS df, round(p_value, 2) AS p_value,
       CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS star
FROM (SELECT CASE label WHEN 1 THEN 'RANN' ELSE 'RRNN' END AS resp, 'x' || rec_id AS term, truth AS statistic, p_value
      FROM v_preds) t""")
def gl7(i: Inputs) -> DataFrame:
    d = i.view("v_preds").select("label", F.concat(F.lit("x"), "rec_id").alias("term"), F.col("truth").alias("statistic"),
                                 F.lit(1).alias("df"), "p_value")
    return glm.test_table({"RANN": d.filter("label = 1").drop("label"), "RRNN": d.filter("label <> 1").drop("label")})


@query("gl7_model_tests")
def gl7_models(i: Inputs) -> DataFrame:
    """Tests of the three fitted models in one table."""
    rows = mixed_table(i)
    tables = {"RANN": impact_model(rows).cond, "RRNN": rate_model(rows).cond, "P(I)": invasion_model(rows)}
    return glm.test_table({name: glm.wald_tests(fit.coef_table()) for name, fit in tables.items()})


TITLES = {"cond": "Invasion Rate, Conditional on Invasion", "zi": "Effect on Invasion"}


@query("gl8_coefficient_intervals", f"""
SELECT term, CASE component WHEN 'cond' THEN '{TITLES["cond"]}' ELSE '{TITLES["zi"]}' END AS component,
       round(estimate, 6) AS estimate, round(estimate - {glm.Z95} * std_error, 6) AS conf_low,
       round(estimate + {glm.Z95} * std_error, 6) AS conf_high,
       CASE WHEN (estimate - {glm.Z95} * std_error) * (estimate + {glm.Z95} * std_error) > 0 THEN 'Significant'
            ELSE 'Not' || chr(10) || 'Significant' END AS sig
FROM (SELECT 'x' || rec_id AS term, CASE pred_class WHEN 1 THEN 'cond' ELSE 'zi' END AS component, truth - 30 AS estimate,
             10.0::DOUBLE + p_value AS std_error FROM v_preds WHERE rec_id % 5 <> 0) t""")
def gl8(i: Inputs) -> DataFrame:
    term = F.when(F.col("rec_id") % 10 == 0, F.lit("(Intercept)")).otherwise(F.concat(F.lit("x"), "rec_id"))
    d = i.view("v_preds").select(
        F.when(F.col("rec_id") % 10 == 5, "ran_pars").otherwise("fixed").alias("effect"), term.alias("term"),
        F.when(F.col("pred_class") == 1, "cond").otherwise("zi").alias("component"),
        (F.col("truth") - 30).alias("estimate"), (F.lit(10.0) + F.col("p_value")).alias("std_error"))
    return rounded(glm.coefficient_intervals(d, TITLES), 6, "estimate", "conf_low", "conf_high")


@query("gl8_model_intervals")
def gl8_models(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    titles = {"rer": TITLES, "rel_cover_exotic": TITLES | {"cond": "Invasion Impact, Conditional on Invasion"}}
    return rounded(stacked(glm.coefficient_intervals(model(rows).coef_table(), titles[label]).withColumn("response", F.lit(label))
                           for label, model in SHARES.items()), 6, "estimate", "conf_low", "conf_high")


@query("gl9_marginal_conditional_r2")
def gl9(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    fit = invasion_model(rows)
    parts = [glm.r_squared(complete(rows, "i_cat"), fit.coefs, fit.random_variance, fit.residual_variance()).withColumn("response", F.lit("i_cat"))]
    parts += [model(rows).r_squared(complete(rows, label)).withColumn("response", F.lit(label)) for label, model in SHARES.items()]
    return rounded(stacked(parts), 4, "r2_marginal", "r2_conditional")


@query("gl10_model_overdispersion")
def gl10_models(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    return rounded(stacked(model(rows).overdispersion(complete(rows, label), label).withColumn("response", F.lit(label))
                           for label, model in SHARES.items()), 4, "pearson_chi2", "ratio")


@query("gl10_overdispersion", """
SELECT fold, round(sum(pow(label - mu, 2) / (mu * (1 - mu))), 6) AS pearson_chi2, count(*) - 3 AS residual_df,
       round(sum(pow(label - mu, 2) / (mu * (1 - mu))) / (count(*) - 3), 6) AS ratio
FROM (SELECT fold, label, 0.2::DOUBLE + p_value * 5 AS mu FROM v_preds) t GROUP BY fold""")
def gl10(i: Inputs) -> DataFrame:
    mu = F.lit(0.2) + F.col("p_value") * 5
    out = glm.overdispersion(i.view("v_preds"), F.col("label"), mu, mu * (F.lit(1.0) - mu), 3, ["fold"])
    return rounded(out, 6, "pearson_chi2", "ratio")


@query("gl11_scaled_residuals")
def gl11(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    fitted = invasion_model(rows).predict(complete(rows, "i_cat")).withColumn("row_key", F.concat_ws("|", "plot_id", "year"))
    out = glm.scaled_residuals(fitted, "row_key", "i_cat", "predicted")
    return out.select("plot_id", "year", round_to(F.col("scaled_residual"), 6).alias("scaled_residual"))


@query("gl11_dispersion_test")
def gl11_dispersion(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    fitted = invasion_model(rows).predict(complete(rows, "i_cat")).withColumn("row_key", F.concat_ws("|", "plot_id", "year"))
    return rounded(glm.dispersion_test(fitted, "row_key", "i_cat", "predicted"), 4, "dispersion", "p_value")


@query("gl11_share_residuals")
def gl11_shares(i: Inputs) -> DataFrame:
    """Scaled residuals of both shares' models."""
    rows = mixed_table(i)
    parts = []
    for label, model in SHARES.items():
        fit = model(rows)
        found = zero_beta_residuals(fit.parts(complete(rows, label)), ["plot_id", "year"], label, "p_zero", "mu", fit.cond.phi)
        parts.append(found.withColumn("response", F.lit(label)))
    return rounded(stacked(parts), 6, "scaled_residual")


@query("gl11_share_dispersion")
def gl11_share_dispersion(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    parts = []
    for label, model in SHARES.items():
        fit = model(rows)
        found = zero_beta_dispersion(fit.parts(complete(rows, label)), ["plot_id", "year"], label, "p_zero", "mu", fit.cond.phi)
        parts.append(found.withColumn("response", F.lit(label)))
    return rounded(stacked(parts), 4, "dispersion", "p_value")


@query("gl12_collinearity", """
SELECT unnest(['rumple', 'gfp']) AS term, round(1 / (1 - pow(corr(rumple, gfp), 2)), 6) AS vif FROM v_structure""")
def gl12(i: Inputs) -> DataFrame:
    return rounded(glm.collinearity(i.view("v_structure"), ["rumple", "gfp"]), 6, "vif")


def model_curves(rows: DataFrame, label: str) -> DataFrame:
    """Curve of every predictor from the fixed effects of the response's model."""
    fit = invasion_model(rows) if label == "i_cat" else SHARES[label](rows).cond
    return stacked(glm.effect_curve(complete(rows, label), t, fit.coefs, fit.covariance) for t in TERMS)


@query("gl13_effect_curves")
def gl13(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    out = stacked(model_curves(rows, label).withColumn("response", F.lit(label)) for label in ("i_cat", *SHARES))
    return rounded(out, 5, "x", "predicted", "conf_low", "conf_high")


@query("gl13_effect_curve_by_class", """
WITH cl AS (SELECT DISTINCT nlcd FROM v_nlcd WHERE nlcd IS NOT NULL), xs AS (SELECT DISTINCT rumple FROM v_structure),
m AS (SELECT avg(gfp) AS gfp FROM v_structure),
e AS (SELECT rumple, nlcd, -1.0::DOUBLE + 0.5::DOUBLE * rumple + 0.25::DOUBLE * gfp AS eta,
             1.96::DOUBLE * 0 + 1.959963984540054::DOUBLE * sqrt(0.01::DOUBLE + 0.04::DOUBLE * rumple * rumple) AS half
      FROM xs, cl, m)
SELECT 'rumple' AS "group", rumple AS x, nlcd AS facet, round(1 / (1 + exp(-eta)), 6) AS predicted,
       round(1 / (1 + exp(-(eta - half))), 6) AS conf_low, round(1 / (1 + exp(-(eta + half))), 6) AS conf_high FROM e""")
def gl13_by_class(i: Inputs) -> DataFrame:
    d = i.view("v_structure").join(i.view("v_nlcd").select("plot_id", "nlcd"), "plot_id")
    coefs = {"(Intercept)": -1.0, "rumple": 0.5, "gfp": 0.25}
    vcov = {(a, b): 0.0 for a in coefs for b in coefs} | {("(Intercept)", "(Intercept)"): 0.01, ("rumple", "rumple"): 0.04}
    out = glm.effect_curve(d, "rumple", coefs, vcov, by="nlcd")
    return rounded(out, 6, "predicted", "conf_low", "conf_high")


@query("gl14_effects_frame", """
SELECT response, "group", x, CASE WHEN response LIKE 'Invasion%' THEN predicted * 100 ELSE predicted END AS predicted,
       CASE WHEN response LIKE 'Invasion%' THEN (predicted - 1) * 100 ELSE predicted - 1 END AS conf_low,
       CASE WHEN response LIKE 'Invasion%' THEN (predicted + 1) * 100 ELSE predicted + 1 END AS conf_high,
       CASE "group" WHEN 'map' THEN 'Climate' WHEN 'nspp_native' THEN 'Community' WHEN 'rumple' THEN 'Structure'
            WHEN 'entropy' THEN 'Structure' END AS type
FROM (SELECT CASE response WHEN 'ii' THEN 'Invasion Impact' WHEN 'ir' THEN 'Invasion Rate' ELSE 'P(Invasion)' END AS response,
             name AS "group", x, yhat AS predicted FROM v_curves) t""")
def gl14(i: Inputs) -> DataFrame:
    d = i.view("v_curves").select("response", F.col("name").alias("group"), "x", F.col("yhat").alias("predicted"),
                                  (F.col("yhat") - 1).alias("conf_low"), (F.col("yhat") + 1).alias("conf_high"))
    return glm.effects_frame({title: d.filter(F.col("response") == code).drop("response")
                              for code, title in RESPONSE_TITLE.items()})


@query("gl14_model_effects")
def gl14_models(i: Inputs) -> DataFrame:
    """Effects of the three fitted models, shares in percent."""
    rows = mixed_table(i)
    labels = {"pi": "i_cat", "ir": "rer", "ii": "rel_cover_exotic"}
    out = glm.effects_frame({title: model_curves(rows, labels[code]) for code, title in RESPONSE_TITLE.items()})
    return rounded(out, 5, "x", "predicted", "conf_low", "conf_high")


@query("gl15_predict_new_data")
def gl15(i: Inputs) -> DataFrame:
    rows = mixed_table(i)
    fit = rate_model(rows)
    out = fit.predict(rows.dropna(subset=list(TERMS)))
    return out.select("plot_id", "year", round_to(F.col("predicted"), 6).alias("predicted"), F.lit(fit.n_ones).alias("n_ones_dropped"))


@query("src7_load_saved_fit")
def src7_fit(i: Inputs) -> DataFrame:
    """Coefficients of a fit that is written and read again."""
    rows = mixed_table(i)
    path = scratch_path(i.spark, "fit")
    save_fit(rate_model(rows), path)
    return rounded(load_fit(i.spark, path).coef_table(), 6, "estimate", "std_error", "statistic", "p_value")


@query("gl15_fixed_effect_prediction", """
SELECT plot_id, round(1 / (1 + exp(-(-1.0::DOUBLE + 0.5::DOUBLE * rumple - 0.25::DOUBLE * gfp))), 6) AS predicted FROM v_structure""")
def gl15_fixed(i: Inputs) -> DataFrame:
    out = glm.predict_response(i.view("v_structure"), {"(Intercept)": -1.0, "rumple": 0.5, "gfp": -0.25})
    return rounded(out.select("plot_id", "predicted"), 6, "predicted")
