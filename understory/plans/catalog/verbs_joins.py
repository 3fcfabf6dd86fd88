"""Projections, filters, reshape and joins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.labels import VARIABLE_GROUP
from understory.functions.missing import not_in, present
from understory.functions.scalars import map_lookup, round_to, terrain_terms, year_text
from understory.operators.joins import (first_per_key, left_join, member_of, natural_left_join, not_member_of,
                                        plot_coordinates, right_join, size_gate)
from understory.operators.spatial import GridTransform, crop, wide_cells, with_utm
from understory.operators.verbs import (align_to_first_rep, map_columns, map_numeric, select_matching, split_by_site,
                                        split_list, stack_frames, stack_tagged, to_long, visited_years)
from understory.plans.fixtures import Inputs
from understory.plans.registry import query

GRID = GridTransform(x0=-150.0, y0=65.0, dx=2.0, dy=1.0)


@query("prj1_select_drop", "SELECT site, plot_id, year, species, cover FROM v_cover")
def prj1(i: Inputs) -> DataFrame:
    return i.cover.drop("subplot_id", "monthyear", "sitemonthyear").select("site", "plot_id", "year", "species", "cover")


@query("prj2_select_by_name_pattern", "SELECT plot_id, site, x_tsc_1996, x_tsc_1998, x_tsc_2000 FROM v_tsc")
def prj2(i: Inputs) -> DataFrame:
    return select_matching(i.view("v_tsc"), ["plot_id", "site"], "X_TSC", not_suffix="MEDIAN_1")


@query("prj3_layer_columns_by_name", """
SELECT cell_row, cell_col, max(CASE WHEN layer = 'map' THEN value END) AS map,
       max(CASE WHEN layer = 'mat' THEN value END) AS mat, max(CASE WHEN layer = 'tmax' THEN value END) AS tmax,
       max(CASE WHEN layer = 'tmin' THEN value END) AS tmin
FROM v_raster GROUP BY cell_row, cell_col""")
def prj3(i: Inputs) -> DataFrame:
    return wide_cells(i.view("v_raster"), ["map", "mat", "tmax", "tmin"])


@query("prj4_rename", "SELECT plot_id AS plot, latitude AS y, longitude AS x FROM v_centroids")
def prj4(i: Inputs) -> DataFrame:
    return (i.view("v_centroids").withColumnsRenamed({"plot_id": "plot", "latitude": "y", "longitude": "x"})
            .drop("subtype"))


@query("prj5_computed_columns", """
SELECT plot_id, round(abs(180.0 - abs(aspect - 225.0)), 6) AS folded_aspect, round(cos(aspect), 4) AS cosign_aspect,
       round(slope * cos(aspect), 4) AS slope_aspect, round(slope * abs(180.0 - abs(aspect - 225.0)), 4) AS slope_fa
FROM v_structure""")
def prj5(i: Inputs) -> DataFrame:
    d = i.view("v_structure").withColumns(terrain_terms())
    return d.select("plot_id", round_to(F.col("folded_aspect"), 6).alias("folded_aspect"),
                    *[round_to(F.col(c), 4).alias(c) for c in ("cosign_aspect", "slope_aspect", "slope_fa")])


@query("prj6_round_all_numeric", """
SELECT site, plot_id, year, round(CAST(nspp_total AS DOUBLE), 2) AS nspp_total, round(rer, 2) AS rer,
       round(rel_cover_exotic, 2) AS rel_cover_exotic
FROM v_plot_year""")
def prj6(i: Inputs) -> DataFrame:
    d = i.plot_year.select("site", "plot_id", "year", F.col("nspp_total").cast("double").alias("nspp_total"), "rer",
                           "rel_cover_exotic")
    return map_numeric(d, lambda c: round_to(c, 2), exclude=["year"])


@query("prj7_mutate_column_range", """
SELECT plot_id, CAST(x_tsc_1996 * 365 AS INTEGER) AS x_tsc_1996, CAST(x_tsc_1998 * 365 AS INTEGER) AS x_tsc_1998,
       CAST(x_tsc_2000 * 365 AS INTEGER) AS x_tsc_2000
FROM v_tsc""")
def prj7(i: Inputs) -> DataFrame:
    cols = ["x_tsc_1996", "x_tsc_1998", "x_tsc_2000"]
    return map_columns(i.view("v_tsc"), cols, lambda c: c * 365).select("plot_id", *cols)


@query("prj8_constant_tag", """
SELECT rec_id, rep, response, name, x, yhat, 'among' AS panel FROM v_curves""")
def prj8(i: Inputs) -> DataFrame:
    return i.view("v_curves").select("rec_id", "rep", "response", "name", "x", "yhat").withColumn("panel", F.lit("among"))


@query("prj9_names_to_column", """
SELECT name, round(avg(v), 6) AS mean FROM (
  SELECT unnest(['rumple', 'entropy', 'gfp', 'vai']) AS name, unnest([rumple, entropy, gfp, vai]) AS v
  FROM v_structure) t GROUP BY name""")
def prj9(i: Inputs) -> DataFrame:
    names = ["rumple", "entropy", "gfp", "vai"]
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(i.view("v_structure"))
    means = vec.select(Summarizer.mean(F.col("v")).alias("m"))
    long = means.select(F.posexplode(vector_to_array("m")).alias("pos", "mean"))
    labels = F.array(*[F.lit(n) for n in names])
    return long.select(F.element_at(labels, F.col("pos") + 1).alias("name"), round_to(F.col("mean"), 6).alias("mean"))


@query("prj10_unique_values", "SELECT DISTINCT sitemonthyear FROM v_cover")
def prj10(i: Inputs) -> DataFrame:
    return i.cover.select("sitemonthyear").distinct()


@query("prj11_matrix_to_vector", """
SELECT plot_id, v AS value FROM (
  SELECT plot_id, unnest([x_tsc_1996, x_tsc_1998, x_tsc_2000]) AS v FROM v_tsc) t WHERE v IS NOT NULL""")
def prj11(i: Inputs) -> DataFrame:
    return (to_long(i.view("v_tsc"), ["plot_id"], ["x_tsc_1996", "x_tsc_1998", "x_tsc_2000"])
            .filter(F.col("value").isNotNull()).drop("name"))


@query("fil1_equality", "SELECT rec_id, site, year FROM v_cover WHERE site = 'NATION_4' AND year <> 1996")
def fil1(i: Inputs) -> DataFrame:
    return i.cover.filter((F.col("site") == "NATION_4") & (F.col("year") != 1996)).select("rec_id", "site", "year")


@query("fil2_membership", """
SELECT rec_id, site FROM v_cover WHERE site IN ('NATION_2', 'NATION_5', 'NATION_11')""")
def fil2(i: Inputs) -> DataFrame:
    return i.cover.filter(F.col("site").isin("NATION_2", "NATION_5", "NATION_11")).select("rec_id", "site")


@query("fil3_negated_membership_keeps_missing", """
SELECT plot_id, nlcd FROM v_nlcd WHERE nlcd IS NULL OR nlcd NOT IN ('BUILDING', 'MACHINERY')""")
def fil3(i: Inputs) -> DataFrame:
    return i.view("v_nlcd").filter(not_in(F.col("nlcd"), ["BUILDING", "MACHINERY"])).select("plot_id", "nlcd")


@query("fil4_not_missing", "SELECT rec_id, cover FROM v_cover WHERE cover IS NOT NULL")
def fil4(i: Inputs) -> DataFrame:
    return i.cover.filter(present(F.col("cover"))).select("rec_id", "cover")


@query("fil5_complete_rows", """
SELECT plot_id, slope, rumple, sd_sd FROM v_structure
WHERE slope IS NOT NULL AND rumple IS NOT NULL AND sd_sd IS NOT NULL""")
def fil5(i: Inputs) -> DataFrame:
    return i.view("v_structure").select("plot_id", "slope", "rumple", "sd_sd").dropna()


@query("fil6_group_size_gate", """
SELECT p.plot_id, p.year FROM v_plot_year p
JOIN (SELECT plot_id FROM v_plot_year GROUP BY plot_id HAVING count(*) > 5) g ON p.plot_id = g.plot_id""")
def fil6(i: Inputs) -> DataFrame:
    return size_gate(i.plot_year, "plot_id", 5).select("plot_id", "year")


@query("rsh1_wide_to_long", """
UNPIVOT (SELECT plot_id, aspect, min_elev, rumple FROM v_structure) ON aspect, min_elev, rumple
INTO NAME name VALUE value""".replace("UNPIVOT (", "SELECT plot_id, name, value FROM (UNPIVOT (") + ")")
def rsh1(i: Inputs) -> DataFrame:
    return to_long(i.view("v_structure"), ["plot_id"], ["aspect", "min_elev", "rumple"])


@query("rsh2_calendar_years", """
SELECT p.site, p.plot_id, p.year FROM v_plot_year p JOIN (
  SELECT DISTINCT site_id, CAST(substr(d, 1, 4) AS INTEGER) AS year
  FROM (SELECT site_id, date1 AS d FROM v_dates UNION ALL SELECT site_id, date2 FROM v_dates
        UNION ALL SELECT site_id, date3 FROM v_dates) u WHERE d IS NOT NULL) y
ON p.site = y.site_id AND p.year = y.year""")
def rsh2(i: Inputs) -> DataFrame:
    years = visited_years(i.view("v_dates"))
    return i.plot_year.select("site", "plot_id", "year").join(
        years.withColumnRenamed("site_id", "site"), ["site", "year"]).select("site", "plot_id", "year")


@query("rsh3_align_to_first_repetition", """
SELECT c.block, c.response, c.name, c.grid_idx, c.rep, f.x, c.yhat FROM v_curves c
LEFT JOIN (SELECT block, response, name, grid_idx, x FROM v_curves WHERE rep = 1) f
ON c.block = f.block AND c.response = f.response AND c.name = f.name AND c.grid_idx = f.grid_idx""")
def rsh3(i: Inputs) -> DataFrame:
    out = align_to_first_rep(i.view("v_curves"), ["block", "response", "name", "grid_idx"], "rep", 1, "x")
    return out.select("block", "response", "name", "grid_idx", "rep", "x", "yhat")


@query("rsh4_bind_columns_by_key", """
SELECT s.plot_id, s.rumple, s.sd_sd, t.nlcd FROM v_structure s JOIN v_nlcd t ON s.plot_id = t.plot_id
WHERE s.sd_sd IS NOT NULL""")
def rsh4(i: Inputs) -> DataFrame:
    kept = i.view("v_structure").select("plot_id", "rumple", "sd_sd").dropna()
    return kept.join(i.view("v_nlcd").select("plot_id", "nlcd"), "plot_id")


@query("rsh5_split_class_list", "SELECT plot_id, trim(unnest(string_split(classes, ','))) AS cls FROM v_nlcd")
def rsh5(i: Inputs) -> DataFrame:
    return split_list(i.view("v_nlcd").select("plot_id", "classes"), "classes", "cls")


@query("jn1_natural_left_join_null_keys", """
SELECT a.plot_id, a.nlcd, c.n FROM v_nlcd a
LEFT JOIN (SELECT nlcd, count(*) AS n FROM v_nlcd GROUP BY nlcd) c ON a.nlcd IS NOT DISTINCT FROM c.nlcd""")
def jn1(i: Inputs) -> DataFrame:
    a = i.view("v_nlcd").select("plot_id", "nlcd")
    return natural_left_join(a, a.groupBy("nlcd").agg(F.count(F.lit(1)).alias("n")))


@query("jn2_left_join_suffixes", """
SELECT a.plot_id, a.year, a.nspp_total AS nspp_total_x, b.nspp_total AS nspp_total_y FROM v_plot_year a
LEFT JOIN (SELECT plot_id, max(nspp_total) AS nspp_total FROM v_plot_year WHERE year > 1998 GROUP BY plot_id) b
ON a.plot_id = b.plot_id""")
def jn2(i: Inputs) -> DataFrame:
    a = i.plot_year.select("plot_id", "year", "nspp_total")
    best = a.filter(F.col("year") > 1998).groupBy("plot_id").agg(F.max("nspp_total").alias("nspp_total"))
    return left_join(a, best, ["plot_id"])


@query("jn3_right_join_multiplies", """
SELECT m.site_id AS site, m.year, m.monthyear, p.plot_id, p.nspp_total FROM v_plot_year p
RIGHT JOIN (SELECT site_id, d AS monthyear, CAST(substr(d, 1, 4) AS INTEGER) AS year
            FROM (SELECT site_id, date1 AS d FROM v_dates UNION ALL SELECT site_id, date2 FROM v_dates
                  UNION ALL SELECT site_id, date3 FROM v_dates) u WHERE d IS NOT NULL) m
ON p.site = m.site_id AND p.year = m.year""")
def jn3(i: Inputs) -> DataFrame:
    d = i.view("v_dates")
    months = (to_long(d, ["site_id"], ["date1", "date2", "date3"], "visit", "monthyear").dropna()
              .select("site_id", "monthyear", year_text(F.col("monthyear")).cast("int").alias("year")))
    out = right_join(i.plot_year.select("site", "year", "plot_id", "nspp_total"), months,
                     [("site", "site_id"), ("year", "year")])
    return out.select("site", "year", "monthyear", "plot_id", "nspp_total")


@query("jn4_semi_join", """
SELECT rec_id, plot_id FROM v_cover c
WHERE EXISTS (SELECT 1 FROM v_centroids b WHERE b.plot_id = c.plot_id AND b.subtype = 'basePlot')""")
def jn4(i: Inputs) -> DataFrame:
    base = i.view("v_centroids").filter(F.col("subtype") == "basePlot")
    return member_of(i.cover.select("rec_id", "plot_id"), base, [("plot_id", "plot_id")])


@query("jn5_anti_join", """
SELECT rec_id, plot_id FROM v_cover c
WHERE NOT EXISTS (SELECT 1 FROM v_centroids b WHERE b.plot_id = c.plot_id AND b.subtype = 'basePlot')""")
def jn5(i: Inputs) -> DataFrame:
    base = i.view("v_centroids").filter(F.col("subtype") == "basePlot")
    return not_member_of(i.cover.select("rec_id", "plot_id"), base, [("plot_id", "plot_id")])


FALLBACK_SQL = """(SELECT plot_id, arg_min(latitude, rec_id) AS latitude, arg_min(longitude, rec_id) AS longitude
  FROM (SELECT c.plot_id, c.rec_id, CAST(30 + (c.rec_id % 70) AS DOUBLE) / 2 AS latitude,
               CAST(-60 - (c.rec_id % 90) AS DOUBLE) AS longitude FROM v_cover c) r GROUP BY plot_id)"""


@query("jn6_coordinates_with_fallback", f"""
SELECT v.site, v.monthyear, v.plot_id, coalesce(b.latitude, f.latitude) AS latitude,
       coalesce(b.longitude, f.longitude) AS longitude
FROM (SELECT DISTINCT site, monthyear, plot_id FROM v_cover) v
LEFT JOIN (SELECT * FROM v_centroids WHERE subtype = 'basePlot') b ON v.plot_id = b.plot_id
LEFT JOIN {FALLBACK_SQL} f ON v.plot_id = f.plot_id""")
def jn6(i: Inputs) -> DataFrame:
    records = i.cover.select(
        "plot_id", "rec_id", ((F.lit(30) + F.col("rec_id") % 70).cast("double") / 2).alias("latitude"),
        (F.lit(-60) - F.col("rec_id") % 90).cast("double").alias("longitude"))
    spare = with_utm(first_per_key(records, ["plot_id"], ["rec_id"]).drop("rec_id"))
    visits = i.cover.select("site", "monthyear", "plot_id").distinct()
    out = plot_coordinates(visits, with_utm(i.view("v_centroids")), spare)
    return out.select("site", "monthyear", "plot_id", "latitude", "longitude")


@query("jn7_first_row_per_key", """
SELECT plot_id, rec_id, species, year FROM (
  SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY rec_id, species NULLS FIRST, year) AS rn FROM v_cover) t WHERE rn = 1""")
def jn7(i: Inputs) -> DataFrame:
    return first_per_key(i.cover.select("plot_id", "rec_id", "species", "year"), ["plot_id"],
                         ["rec_id", "species", "year"])


@query("jn8_lookup_absent_is_missing", """
SELECT rec_id, name, CASE name WHEN 'rumple' THEN 'Structure' WHEN 'entropy' THEN 'Structure' WHEN 'map' THEN 'Climate'
       WHEN 'nspp_native' THEN 'Community' END AS cat
FROM (SELECT rec_id, CASE WHEN name = 'folded_aspect' THEN 'unknown' ELSE name END AS name FROM v_curves) t""")
def jn8(i: Inputs) -> DataFrame:
    name = F.when(F.col("name") == "folded_aspect", "unknown").otherwise(F.col("name"))
    d = i.view("v_curves").select("rec_id", name.alias("name"))
    return d.withColumn("cat", map_lookup(F.col("name"), VARIABLE_GROUP))


@query("jn9_point_in_box", """
SELECT b.plot_id, p.rec_id, p.x, p.y FROM v_points p JOIN v_boxes b
ON p.x >= b.easting - 100 AND p.x < b.easting + 100 AND p.y >= b.northing - 100 AND p.y < b.northing + 100""")
def jn9(i: Inputs) -> DataFrame:
    return crop(i.view("v_points"), i.view("v_boxes")).select("plot_id", "rec_id", "x", "y")


@query("jn10_point_to_cell", """
SELECT c.plot_id, r.layer, r.value FROM v_centroids c JOIN v_raster r
ON r.cell_row = CAST(floor(65.0 - c.latitude) AS INTEGER) AND r.cell_col = CAST(floor((c.longitude + 150.0) / 2) AS INTEGER)""")
def jn10(i: Inputs) -> DataFrame:
    row, col = GRID.cell_of(F.col("longitude"), F.col("latitude"))
    pts = i.view("v_centroids").select("plot_id", row.alias("cell_row"), col.alias("cell_col"))
    return pts.join(i.view("v_raster"), ["cell_row", "cell_col"]).select("plot_id", "layer", "value")


@query("set1_union_by_name", """
SELECT site, year, plot_id, nspp_total, CAST(NULL AS VARCHAR) AS invaded FROM v_plot_year WHERE year < 1997
UNION ALL SELECT site, year, NULL, nspp_total, invaded FROM v_plot_year WHERE year >= 1997""")
def set1(i: Inputs) -> DataFrame:
    p = i.plot_year
    return stack_frames([p.filter("year < 1997").select("site", "year", "plot_id", "nspp_total"),
                         p.filter("year >= 1997").select("site", "year", "nspp_total", "invaded")])


@query("set2_append_rows", """
SELECT plot_id, latitude, longitude, 'base' AS part FROM v_centroids WHERE subtype = 'basePlot'
UNION ALL SELECT plot_id, latitude, longitude, 'other' FROM v_centroids WHERE subtype <> 'basePlot'""")
def set2(i: Inputs) -> DataFrame:
    c = i.view("v_centroids")
    return stack_tagged({"base": c.filter(F.col("subtype") == "basePlot").drop("subtype"),
                         "other": c.filter(F.col("subtype") != "basePlot").drop("subtype")}, "part")


@query("set3_split_and_rejoin", """
SELECT plot_id, nlcd, CASE WHEN nlcd IN ('BUILDING', 'FURNITURE') THEN 'members' ELSE 'rest' END AS part FROM v_nlcd""")
def set3(i: Inputs) -> DataFrame:
    members, rest = split_by_site(i.view("v_nlcd").select("plot_id", "nlcd"), "nlcd", ["BUILDING", "FURNITURE"])
    return stack_tagged({"members": members, "rest": rest}, "part")
