"""Community metrics, spatial operators, canopy structure, figure statistics, whole workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.labels import RESPONSE_TITLE, VARIABLE_GROUP, VARIABLE_LABEL
from understory.functions.scalars import map_lookup, round_to
from understory.operators import structure as st
from understory.operators.clips import clip_cells, clip_heights, clip_layers, clip_quantiles, clip_sums
from understory.operators.diversity import (attach_structure, beta_diversity, diversity_metrics, site_plot_summaries,
                                            taxon_cover, time_since_change)
from understory.operators.figstats import boxplot_outliers, boxplot_stats, loess
from understory.operators.spatial import (GridTransform, clip_key, sample_raster, sample_raster_360, sample_tiles, tile_raster,
                                          tiles_for, with_utm)
from understory.operators.verbs import align_to_first_rep
from understory.plans.catalog.aggregates import rounded
from understory.plans.fixtures import Inputs
from understory.plans.model_table import build_model_table
from understory.plans.registry import query
from understory.session import scratch_path

GRID = GridTransform(x0=-150.0, y0=65.0, dx=2.0, dy=1.0)
GRID_360 = GridTransform(x0=210.0, y0=65.0, dx=2.0, dy=1.0)
CELL = 10.0  # coarse cells: the derived clouds are sparse
LAYERS = ("map", "mat", "tmax", "tmin")


# ---- community metrics ----

@query("div1_taxon_cover", """
SELECT site, plot_id, year, species, nativity, sum(cover) AS cover FROM v_cover
GROUP BY site, plot_id, year, species, nativity""")
def div1(i: Inputs) -> DataFrame:
    return taxon_cover(i.cover, "plot")


@query("div2_richness", """
SELECT site, year, count(DISTINCT species) AS nspp_total,
       count(DISTINCT CASE WHEN nativity = 'N' THEN species END) AS nspp_native,
       count(DISTINCT CASE WHEN nativity = 'I' THEN species END) AS nspp_exotic
FROM v_cover GROUP BY site, year""")
def div2(i: Inputs) -> DataFrame:
    return diversity_metrics(i.cover, "site").select("site", "year", "nspp_total", "nspp_native", "nspp_exotic")


def shannon_sql(where: str, name: str) -> str:
    return f"""(SELECT site, plot_id, year, round(sum(-c / t * ln(c / t)), 4) AS {name} FROM (
  SELECT site, plot_id, year, c, sum(c) OVER (PARTITION BY site, plot_id, year) AS t FROM (
    SELECT site, plot_id, year, species, sum(cover) AS c FROM v_cover WHERE species IS NOT NULL AND ({where})
    GROUP BY site, plot_id, year, species) x WHERE c > 0) y GROUP BY site, plot_id, year)"""


@query("div3_shannon", f"""
SELECT p.site, p.plot_id, p.year, a.shannon_total + 0.0 AS shannon_total, n.shannon_native + 0.0 AS shannon_native,
       e.shannon_exotic + 0.0 AS shannon_exotic
FROM v_plot_year p
LEFT JOIN {shannon_sql('TRUE', 'shannon_total')} a ON a.plot_id = p.plot_id AND a.year = p.year
LEFT JOIN {shannon_sql("nativity = 'N'", 'shannon_native')} n ON n.plot_id = p.plot_id AND n.year = p.year
LEFT JOIN {shannon_sql("nativity = 'I'", 'shannon_exotic')} e ON e.plot_id = p.plot_id AND e.year = p.year""")
def div3(i: Inputs) -> DataFrame:
    cols = ["shannon_total", "shannon_native", "shannon_exotic"]
    d = rounded(diversity_metrics(i.cover).select("site", "plot_id", "year", *cols), 4, *cols)
    return d.withColumns({c: F.col(c) + 0.0 for c in cols})  # no negative zero


@query("div4_relative_exotic_cover", """
SELECT site, plot_id, year, round(rel_cover_exotic, 6) AS rel_cover_exotic FROM v_plot_year""")
def div4(i: Inputs) -> DataFrame:
    return rounded(diversity_metrics(i.cover).select("site", "plot_id", "year", "rel_cover_exotic"), 6, "rel_cover_exotic")


@query("div5_invaded_label", "SELECT site, plot_id, year, invaded FROM v_plot_year")
def div5(i: Inputs) -> DataFrame:
    return diversity_metrics(i.cover).select("site", "plot_id", "year", "invaded")


def beta_sql(keys: str, unit: str) -> str:
    """Brute force over pairs of units."""
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""
WITH pres AS (SELECT DISTINCT {keys}, {unit} AS u, species FROM v_cover WHERE species IS NOT NULL),
rich AS (SELECT {keys}, u, count(*) AS s FROM pres GROUP BY {keys}, u),
grp AS (SELECT {keys}, count(DISTINCT species) AS st FROM pres GROUP BY {keys}),
units AS (SELECT {keys}, count(*) AS n_units, sum(s) AS ss FROM rich GROUP BY {keys}),
shared AS (SELECT {xk}, x.u AS u1, y.u AS u2, count(*) AS a FROM pres x JOIN pres y
           ON {on} AND x.species = y.species AND x.u < y.u GROUP BY {xk}, x.u, y.u),
pairs AS (SELECT {xk}, sum(least(x.s, y.s) - coalesce(h.a, 0)) AS mins, sum(greatest(x.s, y.s) - coalesce(h.a, 0)) AS maxs
          FROM rich x JOIN rich y ON {on} AND x.u < y.u
          LEFT JOIN shared h ON {on.replace('y.', 'h.')} AND h.u1 = x.u AND h.u2 = y.u GROUP BY {xk})
SELECT {keys}, CAST(n_units AS BIGINT) AS n_units, round(sor, 6) AS beta_sor, round(sim, 6) AS beta_sim,
       round(sor - sim, 6) AS beta_nes
FROM (SELECT u.*, CAST(mins AS DOUBLE) / nullif(ss - st + mins, 0) AS sim,
             CAST(mins + maxs AS DOUBLE) / nullif(2 * (ss - st) + mins + maxs, 0) AS sor
      FROM units u JOIN grp USING ({keys}) LEFT JOIN pairs USING ({keys})) z"""


@query("div6_beta_diversity_plots", beta_sql("site, plot_id, year", "subplot_id"))
def div6(i: Inputs) -> DataFrame:
    return rounded(beta_diversity(i.cover, "plot"), 6, "beta_sor", "beta_sim", "beta_nes")


@query("div6_beta_diversity_sites", beta_sql("site, year", "plot_id"))
def div6_sites(i: Inputs) -> DataFrame:
    return rounded(beta_diversity(i.cover, "site"), 6, "beta_sor", "beta_sim", "beta_nes")


@query("div7_stacked_scales", """
WITH cal AS (SELECT DISTINCT site_id, CAST(substr(d, 1, 4) AS INTEGER) AS year
             FROM (SELECT site_id, date1 AS d FROM v_dates UNION ALL SELECT site_id, date2 FROM v_dates
                   UNION ALL SELECT site_id, date3 FROM v_dates) u WHERE d IS NOT NULL),
months AS (SELECT DISTINCT site, monthyear, CAST(substr(monthyear, 1, 4) AS INTEGER) AS year FROM v_cover),
stacked AS (SELECT site, plot_id, year, nspp_total, nspp_exotic, 'plot' AS scale FROM v_plot_year
            UNION ALL SELECT site, NULL, year, count(DISTINCT species),
                   count(DISTINCT CASE WHEN nativity = 'I' THEN species END), 'site' FROM v_cover GROUP BY site, year)
SELECT m.site, m.year, m.monthyear, s.plot_id, s.scale, s.nspp_total, s.nspp_exotic
FROM stacked s RIGHT JOIN months m ON s.site = m.site AND s.year = m.year
WHERE EXISTS (SELECT 1 FROM cal WHERE cal.site_id = m.site AND cal.year = m.year)""")
def div7(i: Inputs) -> DataFrame:
    visits = i.cover.select(F.col("site").alias("site_id"), "monthyear")
    out = site_plot_summaries(i.cover, visits, i.view("v_dates"))
    return out.select("site", "year", "monthyear", "plot_id", "scale", "nspp_total", "nspp_exotic")


@query("div8_vegetation_with_structure", """
SELECT p.site, p.plot_id, p.year, p.nspp_total, s.rumple, s.entropy, CAST(p.year AS VARCHAR) || p.plot_id AS year_plot
FROM v_plot_year p JOIN (SELECT plot_id, rumple, entropy FROM v_structure WHERE slope IS NOT NULL) s
ON p.plot_id = s.plot_id WHERE p.year IN (1996, 1998)""")
def div8(i: Inputs) -> DataFrame:
    metrics = i.view("v_structure").filter(F.col("slope").isNotNull()).select("plot_id", "rumple", "entropy")
    lidar = metrics.withColumn("monthyear", F.explode(F.array(F.lit("1996-06"), F.lit("1998-07"))))
    veg = i.plot_year.select("site", "plot_id", "year", "nspp_total").withColumn("scale", F.lit("plot"))
    return attach_structure(veg, lidar)


TSC_SQL = """SELECT DISTINCT p.plot_id, p.year, CASE WHEN v = 0 THEN 99999 ELSE v END AS days_since_change, p.site
FROM (SELECT q.plot_id, q.year, q.site, CASE q.year WHEN 1996 THEN t.x_tsc_1996 WHEN 1998 THEN t.x_tsc_1998
             WHEN 2000 THEN t.x_tsc_2000 END AS v
      FROM v_plot_year q JOIN v_tsc t ON q.plot_id = t.plot_id WHERE q.year IN (1996, 1998, 2000)) p"""


def history(i: Inputs) -> DataFrame:
    return i.plot_year.select("plot_id", "site", "year").join(i.view("v_tsc").drop("site"), "plot_id")


@query("div9_time_since_change", TSC_SQL)
def div9(i: Inputs) -> DataFrame:
    return time_since_change(history(i))


# ---- spatial ----

UTM_SQL = """
WITH k AS (SELECT plot_id, latitude, longitude, CAST(floor((longitude + 180) / 6) + 1 AS INTEGER) AS zone FROM v_centroids),
a AS (SELECT *, radians(latitude) AS phi, radians(longitude - (zone * 6 - 183)) AS dl,
             0.0016792203863836474::DOUBLE AS n FROM k),
b AS (SELECT *, sinh(atanh(sin(phi)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(phi))) AS t FROM a),
c AS (SELECT *, atan(t / cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta,
             0.9996::DOUBLE * 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS ka,
             n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2,
             61 * n * n * n / 240 AS a3 FROM b)
SELECT plot_id, zone,
       round(500000 + ka * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta)
             + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
       round(ka * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta)
             + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing
FROM c"""


@query("sp1_lonlat_to_utm", UTM_SQL)
def sp1(i: Inputs) -> DataFrame:
    out = with_utm(i.view("v_centroids")).select("plot_id", "zone", "easting", "northing")
    return rounded(out, 3, "easting", "northing")


@query("sp2_tile_list", """
SELECT DISTINCT CAST(e * 1000 AS BIGINT) AS tile_e, CAST(n * 1000 AS BIGINT) AS tile_n FROM (
  SELECT e, unnest(generate_series(CAST(floor((northing - 100) / 1000) AS BIGINT),
                                   CAST(floor((northing + 100) / 1000) AS BIGINT))) AS n
  FROM (SELECT northing, unnest(generate_series(CAST(floor((easting - 100) / 1000) AS BIGINT),
                                                CAST(floor((easting + 100) / 1000) AS BIGINT))) AS e FROM v_boxes) a) b""")
def sp2(i: Inputs) -> DataFrame:
    return tiles_for(i.view("v_boxes"))


CROP_SQL = """crops AS (SELECT b.plot_id, p.rec_id, p.x, p.y, p.z, p.class FROM v_points p JOIN v_boxes b
  ON p.x >= b.easting - 100 AND p.x < b.easting + 100 AND p.y >= b.northing - 100 AND p.y < b.northing + 100)"""


def sums(i: Inputs) -> DataFrame:
    return clip_sums(i.view("v_points"), i.view("v_boxes"))


@query("sp3_crop_plots", f"""
WITH {CROP_SQL} SELECT plot_id, count(*) AS n, sum(z) AS sum_z, min(x) AS min_x, max(y) AS max_y FROM crops GROUP BY plot_id
""".replace("sum(z)", "round(sum(z), 4)"))
def sp3(i: Inputs) -> DataFrame:
    return sums(i).select("plot_id", "n", round_to(F.col("s"), 4).alias("sum_z"), "min_x", "max_y")


@query("sp4_clip_key", """
SELECT c.rec_id, c.site || '_' || c.monthyear || '_' || printf('%.2f', b.longitude) || '_' || printf('%.2f', b.latitude)
       AS clip
FROM v_cover c JOIN v_centroids b ON c.plot_id = b.plot_id""")
def sp4(i: Inputs) -> DataFrame:
    d = i.cover.join(i.view("v_centroids"), "plot_id")
    # one coordinate arrives as text, one as a number: the key is the same
    return d.select("rec_id", clip_key(F.col("site"), F.col("monthyear"), F.col("longitude").cast("string"),
                                       F.col("latitude")).alias("clip"))


SAMPLE_SQL = """SELECT c.plot_id, c.latitude, c.longitude, r.map, r.mat, r.tmax, r.tmin FROM v_centroids c
LEFT JOIN (SELECT cell_row, cell_col, max(CASE WHEN layer = 'map' THEN value END) AS map,
                  max(CASE WHEN layer = 'mat' THEN value END) AS mat, max(CASE WHEN layer = 'tmax' THEN value END) AS tmax,
                  max(CASE WHEN layer = 'tmin' THEN value END) AS tmin FROM v_raster GROUP BY cell_row, cell_col) r
ON r.cell_row = CAST(floor(65.0 - c.latitude) AS INTEGER) AND r.cell_col = CAST(floor((c.longitude + 150.0) / 2) AS INTEGER)"""


@query("sp5_raster_sample", SAMPLE_SQL)
def sp5(i: Inputs) -> DataFrame:
    out = sample_raster(i.view("v_centroids"), i.view("v_raster"), GRID)
    return out.select("plot_id", "latitude", "longitude", *LAYERS)


@query("sp5_tiled_raster_sample", SAMPLE_SQL)
def sp5_tiled(i: Inputs) -> DataFrame:
    tiles = tile_raster(i.view("v_raster"), scratch_path(i.spark, "raster"), LAYERS, side=8)
    return sample_tiles(i.view("v_centroids"), tiles, GRID, LAYERS, side=8).select("plot_id", "latitude", "longitude", *LAYERS)


@query("sp6_raster_sample_360", SAMPLE_SQL.replace("(c.longitude + 150.0) / 2", "(c.longitude + 360 - 210.0) / 2"))
def sp6(i: Inputs) -> DataFrame:
    out = sample_raster_360(i.view("v_centroids"), i.view("v_raster"), GRID_360)
    return out.select("plot_id", "latitude", "longitude", *LAYERS)


HAG_SQL = f"""{CROP_SQL},
hag AS (SELECT plot_id, rec_id, x, y, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy,
  z - coalesce(min(CASE WHEN class = 2 THEN z END) OVER (PARTITION BY plot_id, floor(x / 10), floor(y / 10)),
               min(z) OVER (PARTITION BY plot_id)) AS z FROM crops)"""


def heights(i: Inputs) -> DataFrame:
    return clip_heights(i.view("v_points"), i.view("v_boxes"), cell=CELL)


@query("sp7_height_above_ground", f"WITH {HAG_SQL} SELECT plot_id, rec_id, x, y, round(z, 6) AS z FROM hag")
def sp7(i: Inputs) -> DataFrame:
    return rounded(heights(i).select("plot_id", "rec_id", "x", "y", "z"), 6, "z")


CHM_SQL = f"""{CROP_SQL},
cells AS (SELECT plot_id, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, max(z) AS chm,
                 stddev_samp(z) AS cell_sd FROM crops GROUP BY 1, 2, 3)"""


def chm(i: Inputs) -> DataFrame:
    return clip_cells(i.view("v_points"), i.view("v_boxes"), cell=CELL)


@query("sp8_canopy_heights", f"""WITH {CHM_SQL}
SELECT plot_id, round(avg(chm), 6) AS mean_max_canopy_ht, max(chm) AS max_canopy_ht,
       round(stddev_samp(chm), 6) AS top_rugosity FROM cells GROUP BY plot_id""")
def sp8(i: Inputs) -> DataFrame:
    return rounded(st.canopy_heights(chm(i)).drop("sd_sd"), 6, "mean_max_canopy_ht", "top_rugosity")


@query("sp9_rumple", f"""WITH {CHM_SQL},
q AS (SELECT a.plot_id, a.chm AS z00, b.chm AS z10, c.chm AS z01, d.chm AS z11 FROM cells a
      JOIN cells b ON a.plot_id = b.plot_id AND b.cx = a.cx + 1 AND b.cy = a.cy
      JOIN cells c ON a.plot_id = c.plot_id AND c.cx = a.cx AND c.cy = a.cy + 1
      JOIN cells d ON a.plot_id = d.plot_id AND d.cx = a.cx + 1 AND d.cy = a.cy + 1)
SELECT p.plot_id, round(r.rumple, 6) AS rumple FROM (SELECT DISTINCT plot_id FROM cells) p LEFT JOIN (
  SELECT plot_id, sum(5 * sqrt(100 + pow(z10 - z00, 2) + pow(z11 - z10, 2))
                    + 5 * sqrt(100 + pow(z01 - z00, 2) + pow(z11 - z01, 2))) / (count(*) * 100) AS rumple
  FROM q GROUP BY plot_id) r ON p.plot_id = r.plot_id""")
def sp9(i: Inputs) -> DataFrame:
    return rounded(st.rumple_index(chm(i), CELL), 6, "rumple")


@query("sp10_gap_and_cover_fraction", f"""WITH {CHM_SQL}
SELECT plot_id, round((400 - count(CASE WHEN chm > 0 THEN 1 END)) / 400.0::DOUBLE, 6) AS deepgap_fraction,
       round(count(CASE WHEN chm > 0 THEN 1 END) / 400.0::DOUBLE, 6) AS cover_fraction FROM cells GROUP BY plot_id""")
def sp10(i: Inputs) -> DataFrame:
    return rounded(st.gap_fractions(chm(i), 400), 6, "deepgap_fraction", "cover_fraction")


@query("sp11_vertical_spread", f"""WITH {CROP_SQL}
SELECT plot_id, round(stddev_samp(z), 6) AS vert_sd, round(stddev_samp(z) / nullif(avg(z), 0), 6) AS vert_cv
FROM crops GROUP BY plot_id""")
def sp11(i: Inputs) -> DataFrame:
    return rounded(st.spread_of_sums(sums(i).filter("nz > 0")), 6, "vert_sd", "vert_cv")


@query("sp12_sd_of_cell_sd", f"""WITH {CHM_SQL}
SELECT plot_id, round(stddev_samp(cell_sd), 6) AS sd_sd FROM cells GROUP BY plot_id""")
def sp12(i: Inputs) -> DataFrame:
    return rounded(st.canopy_heights(chm(i)).select("plot_id", "sd_sd"), 6, "sd_sd")


LAYER_SQL = f"""{HAG_SQL},
layers AS (SELECT plot_id, CAST(floor(greatest(z, 0)) AS BIGINT) AS layer, count(*) AS n, greatest(max(z), 0) AS zmax FROM hag WHERE z IS NOT NULL
           GROUP BY 1, 2)"""


def layers(i: Inputs) -> DataFrame:
    return clip_layers(i.view("v_points"), i.view("v_boxes"), cell=CELL)


@query("sp13_height_entropy", f"""WITH {LAYER_SQL}, s AS (
  SELECT *, n / sum(n) OVER (PARTITION BY plot_id) AS p FROM layers)
SELECT plot_id, round(CASE WHEN ceil(max(zmax)) >= 2 THEN sum(-p * ln(p)) / ln(ceil(max(zmax))) END, 4) AS entropy
FROM s GROUP BY plot_id""")
def sp13(i: Inputs) -> DataFrame:
    return rounded(st.height_entropy(layers(i)), 4, "entropy")


@query("sp14_vertical_complexity", f"""WITH {LAYER_SQL}, s AS (
  SELECT *, n / sum(n) OVER (PARTITION BY plot_id) AS p FROM layers WHERE layer < 100)
SELECT plot_id, round(sum(-p * ln(p)) / ln(100), 4) AS vci FROM s GROUP BY plot_id""")
def sp14(i: Inputs) -> DataFrame:
    return rounded(st.complexity_index(layers(i)), 4, "vci")


GAP_SQL = f"""{LAYER_SQL},
full_layers AS (SELECT t.plot_id, t.layer, coalesce(l.n, 0) AS n FROM (
    SELECT plot_id, unnest(generate_series(0, max(layer))) AS layer FROM layers GROUP BY plot_id) t
  LEFT JOIN layers l ON l.plot_id = t.plot_id AND l.layer = t.layer),
cum AS (SELECT *, sum(n) OVER (PARTITION BY plot_id ORDER BY layer) AS c FROM full_layers),
gaps AS (SELECT plot_id, layer, CASE WHEN c = 0 THEN 1 ELSE CAST(c - n AS DOUBLE) / c END AS gap FROM cum WHERE layer >= 3)"""


@query("sp15_gap_fraction_profile", f"""WITH {GAP_SQL}
SELECT p.plot_id, round(g.gfp, 6) AS gfp FROM (SELECT DISTINCT plot_id FROM layers) p
LEFT JOIN (SELECT plot_id, avg(gap) AS gfp FROM gaps GROUP BY plot_id) g ON p.plot_id = g.plot_id""")
def sp15(i: Inputs) -> DataFrame:
    return rounded(st.gap_and_area(st.gap_profile(layers(i))).select("plot_id", "gfp"), 6, "gfp")


@query("sp16_vegetation_area_index", f"""WITH {GAP_SQL}
SELECT p.plot_id, round(g.vai, 4) + 0 AS vai FROM (SELECT DISTINCT plot_id FROM layers) p
LEFT JOIN (SELECT plot_id, coalesce(sum(CASE WHEN gap > 0 THEN -ln(gap) / 0.5::DOUBLE END), 0) AS vai
           FROM gaps GROUP BY plot_id) g ON p.plot_id = g.plot_id""")
def sp16(i: Inputs) -> DataFrame:
    return rounded(st.gap_and_area(st.gap_profile(layers(i))).select("plot_id", "vai"), 4, "vai")


@query("sp17_height_quantiles", f"""WITH {CROP_SQL}
SELECT plot_id, round(quantile_cont(z, 0.25), 6) AS q25, round(quantile_cont(z, 0.5), 6) AS q50
FROM crops GROUP BY plot_id""")
def sp17(i: Inputs) -> DataFrame:
    return rounded(clip_quantiles(i.view("v_points"), i.view("v_boxes"), st.QUANTILES), 6, "q25", "q50")


# ---- figure statistics ----

@query("fg1_boxplot_stats", """
WITH q AS (SELECT response, name, quantile_cont(yhat, 0.25) AS q1, quantile_cont(yhat, 0.5) AS med,
                  quantile_cont(yhat, 0.75) AS q3 FROM v_curves GROUP BY response, name)
SELECT q.response, q.name, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
       min(CASE WHEN yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN yhat END) AS whisker_low,
       max(CASE WHEN yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN yhat END) AS whisker_high,
       count(CASE WHEN NOT yhat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM v_curves c JOIN q ON c.response = q.response AND c.name = q.name GROUP BY q.response, q.name, q1, med, q3""")
def fg1(i: Inputs) -> DataFrame:
    return rounded(boxplot_stats(i.view("v_curves"), ["response", "name"], "yhat"), 6, "q1", "med", "q3")


@query("fg1_boxplot_outliers", """
WITH q AS (SELECT response, quantile_cont(yhat, 0.25) AS q1, quantile_cont(yhat, 0.75) AS q3
           FROM v_curves GROUP BY response)
SELECT c.rec_id, c.response, c.yhat FROM v_curves c JOIN q ON c.response = q.response
WHERE yhat < q1 - 1.5 * (q3 - q1) OR yhat > q3 + 1.5 * (q3 - q1)""")
def fg1_out(i: Inputs) -> DataFrame:
    return boxplot_outliers(i.view("v_curves"), ["response"], "yhat").select("rec_id", "response", "yhat")


LOESS_SQL = """
WITH panel AS (SELECT response, name, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v_curves GROUP BY response, name),
grid AS (SELECT response, name, n, CAST(k AS INTEGER) AS idx, lo + k * ((hi - lo) / 19) AS x0
         FROM panel, (SELECT unnest(generate_series(0, 19)) AS k) g),
near AS (SELECT g.response, g.name, g.idx, g.x0, g.n, c.x, c.yhat, abs(c.x - g.x0) AS d FROM grid g
         JOIN v_curves c ON c.response = g.response AND c.name = g.name),
bw AS (SELECT response, name, idx, d AS h FROM (
         SELECT *, row_number() OVER (PARTITION BY response, name, idx ORDER BY d) AS r FROM near) t
       WHERE r = least(greatest(floor(n * 0.5), 1), n)),
w AS (SELECT a.*, h, pow(1 - pow(a.d / h, 3), 3) AS w, (a.x - a.x0) / h AS t FROM near a
      JOIN bw b ON a.response = b.response AND a.name = b.name AND a.idx = b.idx WHERE h > 0 AND a.d < h),
m AS (SELECT response, name, idx, max(x0) AS x0, sum(w) AS s0, sum(w*t) AS s1, sum(w*t*t) AS s2, sum(w*t*t*t) AS s3,
             sum(w*t*t*t*t) AS s4, sum(w*yhat) AS v0, sum(w*t*yhat) AS v1, sum(w*t*t*yhat) AS v2
      FROM w GROUP BY response, name, idx),
f AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM m)
SELECT response, name, idx, round(x0, 6) AS x, round(CASE WHEN abs(det) > s0*s0*s0*1e-12 THEN
  (v0*(s2*s4-s3*s3) - s1*(v1*s4-s3*v2) + s2*(v1*s3-s2*v2)) / det ELSE v0/s0 END, 4) AS fit FROM f"""


@query("fg2_local_regression", LOESS_SQL)
def fg2(i: Inputs) -> DataFrame:
    out = loess(i.view("v_curves"), ["response", "name"], "x", "yhat", span=0.5, points=20)
    return out.select("response", "name", "idx", round_to(F.col("x"), 6).alias("x"), round_to(F.col("fit"), 4).alias("fit"))


@query("fg3_panel_series", """
WITH f AS (SELECT block, response, name, grid_idx, x FROM v_curves WHERE rep = 1),
c AS (SELECT v.block, v.response, v.name, f.x, v.yhat FROM v_curves v LEFT JOIN f ON v.block = f.block
      AND v.response = f.response AND v.name = f.name AND v.grid_idx = f.grid_idx),
m AS (SELECT block, CASE response WHEN 'ii' THEN 'Invasion Impact' WHEN 'ir' THEN 'Invasion Rate'
             ELSE 'P(Invasion)' END AS title, name, x, avg(yhat) AS yhat FROM c GROUP BY 1, 2, 3, 4)
SELECT block, title, CASE name WHEN 'map' THEN 'A. MAP' WHEN 'folded_aspect' THEN 'F. Folded Aspect' END AS label, x,
       round(yhat, 6) AS yhat
FROM m WHERE name IN ('map', 'folded_aspect') AND x IS NOT NULL""")
def fg3(i: Inputs) -> DataFrame:
    d = align_to_first_rep(i.view("v_curves"), ["block", "response", "name", "grid_idx"], "rep", 1, "x")
    d = d.filter(map_lookup(F.col("name"), VARIABLE_GROUP).isin("Climate", "Site") & F.col("x").isNotNull())
    return d.groupBy("block", map_lookup(F.col("response"), RESPONSE_TITLE).alias("title"),
                     map_lookup(F.col("name"), VARIABLE_LABEL).alias("label"), "x").agg(
        round_to(F.avg("yhat"), 6).alias("yhat"))


# ---- whole workflows ----

MODEL_SQL = f"""
WITH tsc AS ({TSC_SQL}), clim AS ({SAMPLE_SQL}),
base AS (SELECT DISTINCT plot_id FROM v_centroids WHERE subtype = 'basePlot')
SELECT p.site, p.plot_id, p.year, p.nspp_exotic, p.nspp_native, p.i_cat, round(p.rer, 6) AS rer,
       round(p.rel_cover_exotic, 6) AS rel_cover_exotic, s.rumple, s.entropy, s.slope,
       abs(180 - abs(s.aspect - 225)) AS folded_aspect,
       CASE WHEN p.site NOT IN ('NATION_4', 'NATION_9') THEN tsc.days_since_change END AS days_since_change,
       clim.latitude, clim.map, clim.mat, clim.tmax, clim.tmin
FROM v_plot_year p JOIN v_structure s ON p.plot_id = s.plot_id
LEFT JOIN tsc ON tsc.plot_id = p.plot_id AND tsc.year = p.year AND tsc.site = p.site
LEFT JOIN (SELECT c.* FROM clim c JOIN base b ON b.plot_id = c.plot_id) clim ON clim.plot_id = p.plot_id
WHERE p.site NOT IN ('NATION_3', 'NATION_7')"""


def model_table(i: Inputs) -> DataFrame:
    insitu = i.plot_year.join(i.view("v_structure"), "plot_id")
    cells = i.view("v_raster")
    return build_model_table(insitu, history(i), i.view("v_centroids"), (cells, GRID), (cells, GRID_360),
                             excluded=("NATION_3", "NATION_7"), alaska=("NATION_4", "NATION_9"))


@query("flow_model_table", MODEL_SQL)
def flow_model_table(i: Inputs) -> DataFrame:
    d = model_table(i).select("site", "plot_id", "year", "nspp_exotic", "nspp_native", "i_cat", "rer",
                              "rel_cover_exotic", "rumple", "entropy", "slope", "folded_aspect", "days_since_change",
                              "latitude", *LAYERS)
    return rounded(d, 6, "rer", "rel_cover_exotic")


@query("flow_structure_table", None)
def flow_structure(i: Inputs) -> DataFrame:
    return rounded(st.structure_metrics(heights(i), cell=CELL), 6, *st.STRUCTURE_METRICS)
