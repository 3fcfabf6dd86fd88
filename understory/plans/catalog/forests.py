"""Resampling, forests and their explanation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.scalars import round_to
from understory.operators.aggregates import importance_summary
from understory.operators.explain import aligned_mean_curves, centered_logit, feature_grid
from understory.operators.forest import ModelSpec, accuracy, assemble, complete_cases, holdout_metrics, rsq, specs_for
from understory.operators.ordering import zscore
from understory.operators.resample import group_folds, split_sizes, train_test_split
from understory.operators.study import (ForestStudy, curves, load_study, out_of_bag_importance, predictions, saved_study,
                                        sites_with_more_than)
from understory.operators.verbs import stack_tagged
from understory.plans.catalog.aggregates import FOLDS_SQL, rounded
from understory.plans.catalog.ecology_spatial import model_table
from understory.plans.fixtures import Inputs
from understory.plans.model_table import PREDICTORS
from understory.plans.registry import query

FEATURES = PREDICTORS


def forest_table(i: Inputs) -> DataFrame:
    """Complete rows of the model table, without the time since change."""
    d = model_table(i)
    return complete_cases(d.select("site", "plot_id", "year", *FEATURES, "rer", "rel_cover_exotic", "i_cat"))


def across_study(i: Inputs) -> ForestStudy:
    """Ten grouped folds by three responses, as in the study; fitted once for the same rows, then read."""
    return saved_study(forest_table(i), "across-sites", specs_for(FEATURES), seed=11)


def within_study(i: Inputs) -> ForestStudy:
    """The same apart for each site with more than 30 rows."""
    rows = sites_with_more_than(forest_table(i), "site", 30)
    return saved_study(rows, "within-sites", specs_for(FEATURES), within="site", seed=5)


def one_forest(i: Inputs, spec: ModelSpec) -> DataFrame:
    """All rows scored by one forest of all rows."""
    return predictions(saved_study(forest_table(i), f"forest-{spec.name}", [spec], v=0, seed=3))


@query("ml1_group_folds", f"SELECT p.plot_id, p.year, f.fold FROM v_plot_year p JOIN ({FOLDS_SQL}) f ON f.g = p.plot_id")
def ml1(i: Inputs) -> DataFrame:
    return group_folds(i.plot_year, "plot_id", v=10, seed=7).select("plot_id", "year", "fold")


@query("ml2_split_sizes", f"""
SELECT f.fold, count(*) AS n_assessment, (SELECT count(*) FROM v_plot_year) - count(*) AS n_analysis
FROM v_plot_year p JOIN ({FOLDS_SQL}) f ON f.g = p.plot_id GROUP BY f.fold""")
def ml2(i: Inputs) -> DataFrame:
    return split_sizes(group_folds(i.plot_year, "plot_id", v=10, seed=7))


@query("ml3_grouped_train_test_split", f"""
SELECT p.plot_id, p.year, CASE WHEN f.fold = 0 THEN 'test' ELSE 'train' END AS part
FROM v_plot_year p JOIN ({FOLDS_SQL.replace('% 10', '% 4')}) f ON f.g = p.plot_id""")
def ml3(i: Inputs) -> DataFrame:
    train, test = train_test_split(i.plot_year.select("plot_id", "year"), "plot_id", v=4, seed=7)
    return stack_tagged({"train": train, "test": test}, "part")


@query("ml4_forest_classifier")
def ml4(i: Inputs) -> DataFrame:
    out = one_forest(i, ModelSpec("pi", "i_cat", "class", FEATURES))
    return out.select("plot_id", "year", F.col("truth").cast("int").alias("i_cat"), F.col("pred").alias("pred_class"),
                      round_to(F.lit(1.0) - F.col("value"), 6).alias("p_not_invaded"))


@query("ml5_forest_regressor")
def ml5(i: Inputs) -> DataFrame:
    out = one_forest(i, ModelSpec("ir", "rer", "reg", FEATURES))
    return out.select("plot_id", "year", F.col("truth").alias("rer"), round_to(F.col("pred"), 6).alias("pred"))


@query("ml6_assembled_predictors", """
SELECT s.plot_id, s.rumple AS x1, s.entropy AS x2, s.sd_sd AS x3 FROM v_structure s WHERE s.sd_sd IS NOT NULL""")
def ml6(i: Inputs) -> DataFrame:
    spec = ModelSpec("d", "gfp", "reg", ("rumple", "entropy", "sd_sd"))
    d = complete_cases(i.view("v_structure").select("plot_id", *spec.features))
    a = vector_to_array("features")
    return assemble(d, spec.features).select("plot_id", a[0].alias("x1"), a[1].alias("x2"), a[2].alias("x3"))


@query("ml7_holdout_predictions")
def ml7(i: Inputs) -> DataFrame:
    return rounded(predictions(across_study(i)).drop("kind", "value"), 6, "truth", "pred")


@query("ml8_holdout_accuracy", """
SELECT fold, round(avg(CASE WHEN pred_class = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM v_preds GROUP BY fold""")
def ml8(i: Inputs) -> DataFrame:
    acc = accuracy(F.col("pred_class"), F.col("label"))
    return i.view("v_preds").groupBy("fold").agg(round_to(acc, 6).alias("accuracy"))


@query("ml9_holdout_rsq", """
SELECT fold, round(pow(corr(pred, truth), 2), 6) AS rsq FROM v_preds WHERE pred IS NOT NULL GROUP BY fold""")
def ml9(i: Inputs) -> DataFrame:
    return i.view("v_preds").groupBy("fold").agg(round_to(rsq(F.col("pred"), F.col("truth")), 6).alias("rsq"))


@query("ml10_cross_validation")
def ml10(i: Inputs) -> DataFrame:
    return rounded(holdout_metrics(predictions(across_study(i))), 6, "est")


@query("ml11_within_site_cross_validation")
def ml11(i: Inputs) -> DataFrame:
    return rounded(holdout_metrics(predictions(within_study(i)), by=["site"]), 6, "est")


@query("ml12_permutation_importance")
def ml12(i: Inputs) -> DataFrame:
    return rounded(out_of_bag_importance(across_study(i)), 6, "value")


@query("ml12_within_site_importance")
def ml12_within(i: Inputs) -> DataFrame:
    """Mean and deviation over sites and folds, as the study shows it."""
    return rounded(importance_summary(out_of_bag_importance(within_study(i)), clamp=True), 6, "mean", "sd")


@query("ml13_accuracy_table", """
SELECT fold, 'A. P(I)' AS respo, 'Acc.' AS metric,
       round(avg(CASE WHEN pred_class = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS est FROM v_preds GROUP BY fold
UNION ALL SELECT fold, 'B. RRNN', 'R2', round(pow(corr(pred, truth), 2), 6) FROM v_preds WHERE pred IS NOT NULL
GROUP BY fold""")
def ml13(i: Inputs) -> DataFrame:
    d = i.view("v_preds")
    stacked = stack_tagged({
        "pi": d.select("fold", F.lit("class").alias("kind"), F.col("pred_class").cast("double").alias("pred"),
                       F.col("label").cast("double").alias("truth")),
        "ir": d.select("fold", F.lit("reg").alias("kind"), "pred", "truth")}, "response")
    titles = F.when(F.col("response") == "pi", "A. P(I)").otherwise("B. RRNN")
    return holdout_metrics(stacked).select("fold", titles.alias("respo"), "metric", round_to(F.col("est"), 6).alias("est"))


@query("ml14_feature_grid", " UNION ALL ".join(f"""
SELECT '{f}' AS name, CAST(k AS INTEGER) AS grid_idx, round(lo + k * ((hi - lo) / 29), 6) AS x
FROM (SELECT min({f}) AS lo, max({f}) AS hi FROM v_structure) s, (SELECT unnest(generate_series(0, 29)) AS k) g"""
                                                for f in ("rumple", "entropy", "gfp")))
def ml14_grid(i: Inputs) -> DataFrame:
    return rounded(feature_grid(i.view("v_structure"), ["rumple", "entropy", "gfp"]), 6, "x")


@query("ml14_partial_dependence_fast")
def ml14(i: Inputs) -> DataFrame:
    return rounded(curves(across_study(i)), 6, "value", "yhat")


@query("ml15_partial_dependence_exact")
def ml15(i: Inputs) -> DataFrame:
    return rounded(curves(within_study(i), exact=True), 6, "value", "yhat")


@query("ml15_within_site_curves")
def ml15_scaled(i: Inputs) -> DataFrame:
    """The four predictors shown, x and prediction standardized within each curve."""
    shown = curves(within_study(i), exact=True).filter(F.col("name").isin("rumple", "entropy", "nspp_native", "mean_max_canopy_ht"))
    scaled = zscore(shown, ["value", "yhat"], ["site", "rep", "name", "response"])
    return rounded(scaled.dropna(), 6, "value", "yhat")


@query("src7_load_saved_study")
def src7_study(i: Inputs) -> DataFrame:
    """Importance from a study that is read from its folder alone."""
    return rounded(out_of_bag_importance(load_study(i.spark, across_study(i).path)), 6, "value")


@query("ml16_centered_logit", """
SELECT rec_id, round(ln(p) - (ln(p) + ln(1 - p)) / 2, 4) + 0 AS yhat
FROM (SELECT rec_id, 0.05::DOUBLE + p_value * 9 AS p FROM v_preds) t""")
def ml16(i: Inputs) -> DataFrame:
    p = F.lit(0.05) + F.col("p_value") * 9
    return i.view("v_preds").select("rec_id", (round_to(centered_logit(p, F.lit(1.0) - p), 4) + 0.0).alias("yhat"))


@query("ml17_aligned_standardized_curves", """
WITH a AS (SELECT c.block, c.response, c.name, f.x AS value, c.yhat FROM v_curves c
           JOIN (SELECT block, response, name, grid_idx, x FROM v_curves WHERE rep = 1) f ON c.block = f.block
           AND c.response = f.response AND c.name = f.name AND c.grid_idx = f.grid_idx),
m AS (SELECT block, response, name, value, avg(yhat) AS yhat FROM a GROUP BY block, response, name, value)
SELECT block, response, name, round(yhat, 6) AS yhat, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) + 0 AS value
FROM m WINDOW w AS (PARTITION BY block, name)""")
def ml17(i: Inputs) -> DataFrame:
    pdp = i.view("v_curves").withColumnRenamed("x", "value")
    out = rounded(aligned_mean_curves(pdp, ["block", "response", "name"], first_rep=1), 6, "value", "yhat")
    return out.select("block", "response", "name", "yhat", (F.col("value") + 0.0).alias("value"))
