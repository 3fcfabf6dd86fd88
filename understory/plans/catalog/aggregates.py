"""Aggregations, order statistics, windows, sorts and scalar functions."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.labels import (GROUP_ORDER, PANEL_TITLES, RESPONSE_TITLE, VARIABLE_GROUP, VARIABLE_LABEL,
                                         level_order, short_label)
from understory.functions.missing import if_else, mean_strict, nan_to_null, sum_strict
from understory.functions.scalars import (excludes_zero, extract_first, folded_aspect, map_lookup, paste0,
                                          percent_if_invasion, relative_richness, remove_all, replace_all, round_to,
                                          signif, significance_stars, str_c, terrain_terms, upper_if_three,
                                          wrap_longitude, year_of)
from understory.operators.aggregates import (class_counts, cover_by_visit, importance_summary, invasion_by_land_cover,
                                             invasion_by_plot, invasion_by_site, mean_curve, metric_table, profile)
from understory.operators.levels import order_levels
from understory.operators.ordering import dense_order, exact_quantiles, rank_average, top_k, zscore
from understory.operators.resample import group_folds, split_counts
from understory.plans.fixtures import STRUCTURE, Inputs
from understory.plans.registry import query


def strict(col: str, fn: str = "avg") -> str:
    return f"CASE WHEN count({col}) = count(*) THEN {fn}({col}) END"


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), digits) for c in cols})


@query("agg1_group_count", "SELECT site, year, count(*) AS n FROM v_cover GROUP BY site, year")
def agg1(i: Inputs) -> DataFrame:
    return i.cover.groupBy("site", "year").agg(F.count(F.lit(1)).alias("n"))


@query("agg2_strict_mean", f"""
SELECT plot_id, round({strict('cover')}, 6) AS mean_cover FROM v_cover GROUP BY plot_id""")
def agg2(i: Inputs) -> DataFrame:
    return i.cover.groupBy("plot_id").agg(round_to(mean_strict(F.col("cover")), 6).alias("mean_cover"))


@query("agg3_strict_sum", f"""
SELECT site, plot_id, year, {strict('cover', 'sum')} AS total FROM v_cover GROUP BY site, plot_id, year""")
def agg3(i: Inputs) -> DataFrame:
    return i.cover.groupBy("site", "plot_id", "year").agg(sum_strict(F.col("cover")).alias("total"))


@query("agg4_skipping_mean_sd", """
SELECT site, round(avg(cover), 6) AS mean, round(stddev_samp(cover), 6) AS sd FROM v_cover GROUP BY site""")
def agg4(i: Inputs) -> DataFrame:
    v = nan_to_null(F.col("cover"))
    return i.cover.groupBy("site").agg(round_to(F.avg(v), 6).alias("mean"), round_to(F.stddev_samp(v), 6).alias("sd"))


@query("agg5_sample_sd", """
SELECT plot_id, round(stddev_samp(rer), 6) AS sd FROM v_plot_year GROUP BY plot_id""")
def agg5(i: Inputs) -> DataFrame:
    return i.plot_year.groupBy("plot_id").agg(round_to(F.stddev_samp("rer"), 6).alias("sd"))


def invasion_sql(key: str, rer: str = "rer", where: str = "TRUE") -> str:
    """Two-stage summary in SQL."""
    return f"""
WITH yearly AS (
  SELECT {key}, year, {strict('nspp_exotic')} AS nspp,
         CAST(sum(i_cat) AS DOUBLE) / count(*) AS i, {strict('x')} AS ir, {strict('rel_cover_exotic')} AS ii
  FROM (SELECT p.*, {rer} AS x, t.nlcd FROM v_plot_year p LEFT JOIN v_nlcd t ON p.plot_id = t.plot_id) d
  WHERE {where} GROUP BY {key}, year),
s AS (SELECT {key}, {strict('nspp')} AS nspp, {strict('i')} AS i, {strict('ir')} AS ir, {strict('ii')} AS ii
      FROM yearly GROUP BY {key})"""


@query("agg6_invasion_by_site", invasion_sql("site", "rer * 100") + """
SELECT site, round(nspp, 2) AS mean_exotic_spp, round(i * 100, 2) AS percent_invaded_plots,
       round(ir, 2) AS mean_ir, round(ii * 100, 2) AS mean_ii FROM s""")
def agg6(i: Inputs) -> DataFrame:
    out = invasion_by_site(i.plot_year.withColumn("rer", F.col("rer") * 100))
    return rounded(out, 2, "mean_exotic_spp", "percent_invaded_plots", "mean_ir", "mean_ii")


@query("agg7_invasion_by_land_cover", invasion_sql("nlcd") + """
SELECT s.nlcd, round(nspp, 2) AS mean_exotic_spp, round(i * 100, 2) AS percent_invaded_plots,
       round(ir * 100, 2) AS relative_richness_non_native, round(ii * 100, 2) AS relative_abundance_non_native, c.n
FROM s JOIN (SELECT t.nlcd, count(*) AS n FROM v_plot_year p JOIN v_nlcd t ON p.plot_id = t.plot_id GROUP BY t.nlcd) c
ON s.nlcd = c.nlcd
WHERE nspp IS NOT NULL AND i IS NOT NULL AND ir IS NOT NULL AND ii IS NOT NULL""")
def agg7(i: Inputs) -> DataFrame:
    d = i.plot_year.join(i.view("v_nlcd").select("plot_id", "nlcd"), "plot_id", "left")
    return invasion_by_land_cover(d)


@query("agg8_invasion_by_plot", invasion_sql("plot_id") + """
SELECT plot_id, round(i, 6) AS i, round(ir, 6) AS ir, round(ii, 6) AS ii FROM s""")
def agg8(i: Inputs) -> DataFrame:
    return rounded(invasion_by_plot(i.plot_year), 6, "i", "ir", "ii")


@query("agg9_invasion_classes", invasion_sql("plot_id") + """
SELECT i_class, count(*) AS n FROM (
  SELECT CASE WHEN i = 1 THEN '100' WHEN i = 0 THEN '0' WHEN i > 0 AND i < 0.5 THEN '0-50'
              WHEN i >= 0.5 AND i < 1 THEN '50-100' END AS i_class FROM s) t
WHERE i_class IS NOT NULL GROUP BY i_class""")
def agg9(i: Inputs) -> DataFrame:
    return class_counts(invasion_by_plot(i.plot_year), "i", 1.0)


_SIG = "CASE WHEN {0} = 0 THEN CAST(0 AS DOUBLE) ELSE round({0} * pow(10.0::DOUBLE, 1 - floor(log10(abs({0}))))) / pow(10.0::DOUBLE, 1 - floor(log10(abs({0})))) END"


@query("agg10_metric_table", " UNION ALL ".join(
    f"SELECT '{m.removesuffix('_sd')}' AS name, {_SIG.format(f'avg({m})')} AS mean, "
    f"{_SIG.format(f'stddev_samp({m})')} AS sd FROM v_structure" for m in STRUCTURE))
def agg10(i: Inputs) -> DataFrame:
    return metric_table(i.view("v_structure"), STRUCTURE, strip=["_sd"])


@query("agg11_distinct_combinations", "SELECT DISTINCT site, monthyear, sitemonthyear, plot_id FROM v_cover")
def agg11(i: Inputs) -> DataFrame:
    return i.cover.select("site", "monthyear", "sitemonthyear", "plot_id").distinct()


@query("agg12_cover_by_visit", """
SELECT c.site, c.monthyear, c.sitemonthyear, c.year, count(DISTINCT c.plot_id) AS numplots,
       count(DISTINCT species) AS species_richness,
       count(DISTINCT CASE WHEN nativity = 'I' THEN species END) AS exotic_richness,
       round(avg(CASE WHEN nativity = 'I' THEN cover END), 6) AS exotic_cover,
       string_agg(DISTINCT t.nlcd, ', ' ORDER BY t.nlcd) AS dominant_nlcd_classes
FROM v_cover c LEFT JOIN v_nlcd t ON c.plot_id = t.plot_id
GROUP BY c.site, c.monthyear, c.sitemonthyear, c.year""")
def agg12(i: Inputs) -> DataFrame:
    return rounded(cover_by_visit(i.cover, i.view("v_nlcd")), 6, "exotic_cover")


@query("agg13_mean_curve", """
SELECT block, response, name, grid_idx, round(avg(yhat), 6) AS yhat FROM v_curves
GROUP BY block, response, name, grid_idx""")
def agg13(i: Inputs) -> DataFrame:
    return rounded(mean_curve(i.view("v_curves"), ["block", "response", "name", "grid_idx"]), 6, "yhat")


@query("agg14_importance_summary", """
SELECT response, var, round(CASE WHEN m < 0 THEN 0 ELSE m END, 6) AS mean, round(sd, 6) AS sd FROM (
  SELECT response, name || '_' || CAST(block AS VARCHAR) AS var, avg(yhat - 30) AS m, stddev_samp(yhat - 30) AS sd
  FROM v_curves GROUP BY 1, 2) t""")
def agg14(i: Inputs) -> DataFrame:
    d = i.view("v_curves").select("response", str_c(F.col("name"), F.lit("_"), F.col("block")).alias("var"),
                                  (F.col("yhat") - 30).alias("value"))
    return rounded(importance_summary(d, clamp=True), 6, "mean", "sd")


FOLDS_SQL = """SELECT g, CAST((row_number() OVER (ORDER BY md5(g || '|7')) - 1) % 10 AS INTEGER) AS fold
  FROM (SELECT DISTINCT plot_id AS g FROM v_plot_year) u"""


@query("agg15_plots_per_split", f"""
SELECT f.fold, f.held AS held_out, t.n - f.held AS training
FROM (SELECT fold, count(*) AS held FROM ({FOLDS_SQL}) x GROUP BY fold) f
CROSS JOIN (SELECT count(DISTINCT plot_id) AS n FROM v_plot_year) t""")
def agg15(i: Inputs) -> DataFrame:
    return split_counts(group_folds(i.plot_year, "plot_id", v=10, seed=7), "plot_id")


@query("agg16_profile", """
SELECT 'cover' AS column, count(*) AS rows, count(*) - count(cover) AS missing, count(DISTINCT cover) AS distinct,
       min(cover) AS min, max(cover) AS max, round(avg(cover), 6) AS mean FROM v_cover
UNION ALL SELECT 'year', count(*), count(*) - count(year), count(DISTINCT year), min(year), max(year),
       round(avg(year), 6) FROM v_cover
UNION ALL SELECT 'site', count(*), count(*) - count(site), count(DISTINCT site), NULL, NULL, NULL FROM v_cover
UNION ALL SELECT 'species', count(*), count(*) - count(species), count(DISTINCT species), NULL, NULL, NULL FROM v_cover
""".replace("AS column", 'AS "column"').replace("AS distinct", 'AS "distinct"'))
def agg16(i: Inputs) -> DataFrame:
    return rounded(profile(i.cover.select("cover", "year", "site", "species")), 6, "mean")


@query("agg17_median_and_mean_rank", """
SELECT block, response, name, round(quantile_cont(yhat, 0.5), 6) AS median_yhat, round(avg(r), 6) AS mean_rank
FROM (SELECT *, rank() OVER (PARTITION BY block, response, rep ORDER BY yhat)
               + (count(*) OVER (PARTITION BY block, response, rep, yhat) - 1) / 2.0 AS r FROM v_curves) t
GROUP BY block, response, name""")
def agg17(i: Inputs) -> DataFrame:
    keys = ["block", "response", "name"]
    ranked = rank_average(i.view("v_curves"), ["block", "response", "rep"], "yhat", "r")
    med = exact_quantiles(ranked, keys, "yhat", {"median_yhat": 0.5})
    out = med.join(ranked.groupBy(*keys).agg(F.avg("r").alias("mean_rank")), keys)
    return rounded(out, 6, "median_yhat", "mean_rank")


@query("win1_group_zscore", """
SELECT rec_id, round((yhat - avg(yhat) OVER w) / nullif(stddev_samp(yhat) OVER w, 0), 6) AS yhat
FROM v_curves WINDOW w AS (PARTITION BY block, response)""")
def win1(i: Inputs) -> DataFrame:
    return rounded(zscore(i.view("v_curves"), ["yhat"], ["block", "response"]).select("rec_id", "yhat"), 6, "yhat")


@query("win2_standardize_columns", """
SELECT plot_id, round((rumple - avg(rumple) OVER ()) / stddev_samp(rumple) OVER (), 6) AS rumple,
       round((gfp - avg(gfp) OVER ()) / stddev_samp(gfp) OVER (), 6) AS gfp
FROM v_structure""")
def win2(i: Inputs) -> DataFrame:
    v = VectorAssembler(inputCols=["rumple", "gfp"], outputCol="v").transform(i.view("v_structure"))
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)
    a = vector_to_array("z")
    return z.select("plot_id", round_to(a[0], 6).alias("rumple"), round_to(a[1], 6).alias("gfp"))


@query("win3_average_rank", """
SELECT rec_id, rank() OVER (PARTITION BY block, response ORDER BY yhat)
       + CAST(count(*) OVER (PARTITION BY block, response, yhat) - 1 AS DOUBLE) / 2 AS rank
FROM v_curves""")
def win3(i: Inputs) -> DataFrame:
    return rank_average(i.view("v_curves"), ["block", "response"], "yhat").select("rec_id", "rank")


@query("win4_grid_index", """
SELECT block, response, name, rep, x, CAST(row_number() OVER (PARTITION BY block, response, name, rep ORDER BY x) - 1
       AS BIGINT) AS idx FROM v_curves""")
def win4(i: Inputs) -> DataFrame:
    keys = ["block", "response", "name", "rep"]
    d = dense_order(i.view("v_curves").select(*keys, "x"), keys, "x", "idx")
    return d.withColumn("idx", F.col("idx") - 1)


@query("srt1_order_levels_by_two", """
SELECT name, CAST(row_number() OVER (ORDER BY y DESC, name) AS INTEGER) AS var_order
FROM (SELECT name, arg_max(rep, yhat * 100000000 + rec_id) AS y FROM v_curves GROUP BY name) t""")
def srt1(i: Inputs) -> DataFrame:
    d = i.view("v_curves").withColumn("x_key", F.col("yhat") * 100000000 + F.col("rec_id"))
    return order_levels(d, "name", "x_key", "rep", "var_order")


@query("srt2_fixed_level_order", """
SELECT rec_id, name, CASE name WHEN 'map' THEN 1 WHEN 'folded_aspect' THEN 2 WHEN 'rumple' THEN 3 WHEN 'entropy' THEN 3
       WHEN 'nspp_native' THEN 4 END AS cat_order FROM v_curves""")
def srt2(i: Inputs) -> DataFrame:
    cat = map_lookup(F.col("name"), VARIABLE_GROUP)
    return i.view("v_curves").select("rec_id", "name", level_order(cat, GROUP_ORDER).alias("cat_order"))


@query("srt3_sort_descending", """
SELECT block, response, name, m FROM (
  SELECT block, response, name, round(avg(yhat), 6) AS m FROM v_curves GROUP BY block, response, name) t
ORDER BY m DESC""")
def srt3(i: Inputs) -> DataFrame:
    means = i.view("v_curves").groupBy("block", "response", "name").agg(round_to(F.avg("yhat"), 6).alias("m"))
    return means.orderBy(F.desc("m"))


@query("srt4_top_k_by_rank", """
SELECT rec_id, response, yhat, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, rank() OVER (PARTITION BY response ORDER BY yhat DESC) AS r FROM v_curves) t WHERE r <= 5""")
def srt4(i: Inputs) -> DataFrame:
    return top_k(i.view("v_curves"), ["response"], "yhat", 5).select("rec_id", "response", "yhat", "rank")


@query("sc1_concat_and_paste", """
SELECT plot_id, '2000' || nlcd AS strict_text, coalesce(nlcd, 'NA') || '_x' AS pasted FROM v_nlcd""")
def sc1(i: Inputs) -> DataFrame:
    return i.view("v_nlcd").select("plot_id", str_c(F.lit(2000), F.col("nlcd")).alias("strict_text"),
                                   paste0(F.col("nlcd"), F.lit("_x")).alias("pasted"))


@query("sc2_substring", "SELECT rec_id, CAST(substr(monthyear, 1, 4) AS INTEGER) AS y FROM v_cover")
def sc2(i: Inputs) -> DataFrame:
    return i.cover.select("rec_id", year_of(F.col("monthyear")).alias("y"))


@query("sc3_regex_extract", """
SELECT rec_id, nullif(regexp_extract(species, '[0-9]{2}5'), '') AS hit FROM v_cover""")
def sc3(i: Inputs) -> DataFrame:
    return i.cover.select("rec_id", extract_first(F.col("species"), "[0-9]{2}5").alias("hit"))


@query("sc4_regex_replace", """
SELECT rec_id, regexp_replace(regexp_replace(regexp_replace(t, 'Invasion Rate', 'B. Rel. Richness NN (%)', 'g'),
       'Invasion Impact', 'C. Rel. Cover NN (%)', 'g'), 'P\\(Invasion\\)', 'A. P(Invasion)', 'g') AS title
FROM (SELECT rec_id, CASE response WHEN 'ii' THEN 'Invasion Impact' WHEN 'ir' THEN 'Invasion Rate'
             ELSE 'P(Invasion)' END AS t FROM v_curves) u""")
def sc4(i: Inputs) -> DataFrame:
    title = map_lookup(F.col("response"), RESPONSE_TITLE)
    return i.view("v_curves").select("rec_id", replace_all(title, PANEL_TITLES).alias("title"))


@query("sc5_regex_remove", r"""
SELECT rec_id, regexp_replace(regexp_replace(name || '_aop.AOP', '.aop', '', 'g'), '.AOP', '', 'g') AS name
FROM v_curves""")
def sc5(i: Inputs) -> DataFrame:
    return i.view("v_curves").select(
        "rec_id", remove_all(F.concat("name", F.lit("_aop.AOP")), [".aop", ".AOP"]).alias("name"))


@query("sc6_case_change", """
SELECT rec_id, lower(upper(name)) AS low, CASE WHEN length(name) = 3 THEN upper(name) ELSE name END AS shown
FROM v_curves""")
def sc6(i: Inputs) -> DataFrame:
    return i.view("v_curves").select("rec_id", F.lower(F.upper("name")).alias("low"),
                                     upper_if_three(F.col("name")).alias("shown"))


@query("sc7_display_names", """
SELECT rec_id, CASE name WHEN 'folded_aspect' THEN 'aspect' WHEN 'nspp_native' THEN 'N. Rich' WHEN 'map' THEN 'MAP'
       ELSE name END AS shown,
       CASE name WHEN 'folded_aspect' THEN 'F. Folded Aspect' WHEN 'nspp_native' THEN 'Q. Native Richness'
       WHEN 'map' THEN 'A. MAP' WHEN 'rumple' THEN 'P. Rumple' WHEN 'entropy' THEN 'K. Entropy' END AS long_name
FROM v_curves""")
def sc7(i: Inputs) -> DataFrame:
    name = F.col("name")
    return i.view("v_curves").select("rec_id", short_label(name).alias("shown"),
                                     map_lookup(name, VARIABLE_LABEL).alias("long_name"))


@query("sc8_round_decimals", "SELECT rec_id, round(truth, 1) AS t1, round(pred, 2) AS p2 FROM v_preds")
def sc8(i: Inputs) -> DataFrame:
    return i.view("v_preds").select("rec_id", round_to(F.col("truth"), 1).alias("t1"),
                                    round_to(F.col("pred"), 2).alias("p2"))


@query("sc9_significant_digits", f"SELECT rec_id, {_SIG.format('truth')} AS s FROM v_preds")
def sc9(i: Inputs) -> DataFrame:
    return i.view("v_preds").select("rec_id", signif(F.col("truth"), 2).alias("s"))


@query("sc10_if_else_missing", """
SELECT rec_id, CASE WHEN cover IS NULL THEN NULL WHEN cover > 25 THEN 1 ELSE 0 END AS dense FROM v_cover""")
def sc10(i: Inputs) -> DataFrame:
    return i.cover.select("rec_id", if_else(F.col("cover") > 25, F.lit(1), F.lit(0)).alias("dense"))


@query("sc11_multi_branch", """
SELECT rec_id, CASE WHEN cover < 10 THEN 'low' WHEN cover < 40 THEN 'mid' WHEN cover < 50 THEN 'high' END AS level
FROM v_cover""")
def sc11(i: Inputs) -> DataFrame:
    c = F.col("cover")
    return i.cover.select("rec_id", F.when(c < 10, "low").when(c < 40, "mid").when(c < 50, "high").alias("level"))


@query("sc12_sentinel_recode", """
SELECT plot_id, CASE WHEN x_tsc_1998 = 0 THEN 99999 ELSE x_tsc_1998 END AS d98,
       CASE WHEN x_tsc_2000 = 0 THEN 99999 ELSE x_tsc_2000 END AS d00
FROM v_tsc""")
def sc12(i: Inputs) -> DataFrame:
    never = lambda c: if_else(F.col(c) == 0, F.lit(99999), F.col(c))
    return i.view("v_tsc").select("plot_id", never("x_tsc_1998").alias("d98"), never("x_tsc_2000").alias("d00"))


@query("sc13_casts", """
SELECT rec_id, try_cast(replace(species, 'sp', '') AS INTEGER) AS code, try_cast(nativity AS INTEGER) AS none,
       CAST(year AS VARCHAR) AS year_text FROM v_cover""")
def sc13(i: Inputs) -> DataFrame:
    return i.cover.select("rec_id", F.replace("species", F.lit("sp"), F.lit("")).try_cast("int").alias("code"),
                          F.col("nativity").try_cast("int").alias("none"), F.col("year").cast("string").alias("year_text"))


@query("sc14_terrain_terms", """
SELECT plot_id, round(cos(aspect), 4) AS cosign_aspect, round(slope * cos(aspect), 4) AS slope_aspect FROM v_structure""")
def sc14(i: Inputs) -> DataFrame:
    d = i.view("v_structure").withColumns(terrain_terms())
    return rounded(d.select("plot_id", "cosign_aspect", "slope_aspect"), 4, "cosign_aspect", "slope_aspect")


@query("sc15_folded_aspect", "SELECT plot_id, abs(180 - abs(aspect - 225)) AS fa FROM v_structure")
def sc15(i: Inputs) -> DataFrame:
    return i.view("v_structure").select("plot_id", folded_aspect(F.col("aspect")).alias("fa"))


@query("sc16_ratio_metrics", """
SELECT plot_id, year, round(rer, 6) AS rer, round(rer * 100, 6) AS rer_percent, i_cat FROM v_plot_year""")
def sc16(i: Inputs) -> DataFrame:
    return i.plot_year.select("plot_id", "year", round_to(relative_richness(), 6).alias("rer"),
                              round_to(relative_richness(100.0), 6).alias("rer_percent"), "i_cat")


@query("sc17_longitude_wrap", """
SELECT plot_id, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon FROM (
  SELECT plot_id, CASE WHEN longitude < -110 THEN -longitude ELSE longitude END AS lon FROM v_centroids) t""")
def sc17(i: Inputs) -> DataFrame:
    lon = F.when(F.col("longitude") < -110, -F.col("longitude")).otherwise(F.col("longitude"))
    return i.view("v_centroids").select("plot_id", wrap_longitude(lon).alias("lon"))


@query("sc18_significance_stars", """
SELECT rec_id, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE ''
       END AS star FROM v_preds""")
def sc18(i: Inputs) -> DataFrame:
    return i.view("v_preds").select("rec_id", significance_stars(F.col("p_value")).alias("star"))


@query("sc19_interval_excludes_zero", """
SELECT rec_id, (truth - 40) * (truth - 20) > 0 AS significant FROM v_preds""")
def sc19(i: Inputs) -> DataFrame:
    return i.view("v_preds").select("rec_id", excludes_zero(F.col("truth") - 40, F.col("truth") - 20).alias("significant"))


@query("sc20_percent_rescale", """
SELECT rec_id, CASE WHEN t LIKE 'Invasion%' THEN yhat * 100 ELSE yhat END AS predicted FROM (
  SELECT rec_id, yhat, CASE response WHEN 'ii' THEN 'Invasion Impact' WHEN 'ir' THEN 'Invasion Rate'
         ELSE 'P(Invasion)' END AS t FROM v_curves) u""")
def sc20(i: Inputs) -> DataFrame:
    title = map_lookup(F.col("response"), RESPONSE_TITLE)
    return i.view("v_curves").select("rec_id", percent_if_invasion(title, F.col("yhat")).alias("predicted"))
