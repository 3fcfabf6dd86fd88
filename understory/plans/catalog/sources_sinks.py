"""Scans, sinks, caches and incremental work."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.functions.scalars import round_to
from understory.operators.spatial import clip_key, tiles_for, with_tile
from understory.plans.fixtures import Inputs
from understory.plans.registry import query
from understory.session import scratch_path
from understory.sources.files import (scan_ascii_grid, scan_cover, scan_csv, scan_csv_text, scan_files, scan_matching,
                                      scan_points, write_cover, write_csv, write_points)
from understory.streaming.incremental import materialize, pending

COVER_SCHEMA = T.StructType([
    T.StructField("rec_id", T.LongType()), T.StructField("site", T.StringType()),
    T.StructField("plot_id", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("species", T.StringType()), T.StructField("cover", T.DoubleType())])


@query("src1_csv_scan", "SELECT rec_id, site, plot_id, year, species, cover FROM v_cover")
def src1(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "cover-csv")
    write_csv(i.cover.select(*COVER_SCHEMA.names), path)
    return scan_csv(i.spark, path, COVER_SCHEMA)


@query("src2_csv_text_scan", """
SELECT plot_id, subtype, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
FROM v_centroids""")
def src2(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "centroids-csv")
    write_csv(i.view("v_centroids"), path)
    text = scan_csv_text(i.spark, path, ["plot_id", "subtype", "latitude", "longitude"])
    return text.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})


@query("src3_file_discovery", """
SELECT site, count(*) AS n_records FROM v_cover WHERE regexp_matches(site, '^NATION_1[0-9]$') GROUP BY site""")
def src3(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "cover-by-site")
    write_cover(i.cover, path)
    pattern = r"/site=NATION_1[0-9]/"
    records = scan_matching(i.spark, "parquet", path, r"*.parquet", pattern, i.cover.drop("site").schema)
    found = scan_files(i.spark, path, "*.parquet", pattern)
    site = F.regexp_extract("path", r"/site=([^/]+)/", 1).alias("site")
    return records.groupBy(site).agg(F.count(F.lit(1)).alias("n_records")).join(
        found.select(site).distinct(), "site", "left_semi")


@query("src4_climate_grid", "SELECT layer, cell_row, cell_col, value FROM v_raster")
def src4(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "grid")
    cells = i.view("v_raster")
    text = F.coalesce(F.col("value").cast("string"), F.lit("-9999"))
    rows = (cells.groupBy("layer", "cell_row")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_col", text.alias("v")))),
                                          lambda s: s["v"]), " ").alias("value")))
    head = cells.groupBy("layer").agg((F.max("cell_row") + 1).alias("nr"), (F.max("cell_col") + 1).alias("nc"))
    lines = F.array(*[F.struct(F.lit(k - 6).alias("cell_row"), F.concat(F.lit(name + " "), v.cast("string")).alias("value"))
                      for k, (name, v) in enumerate([
                          ("ncols", F.col("nc")), ("nrows", F.col("nr")), ("xllcorner", F.lit(-150.0)),
                          ("yllcorner", F.lit(65.0) - F.col("nr")), ("cellsize", F.lit(1.0)),
                          ("NODATA_value", F.lit(-9999))])])
    header = head.select("layer", F.explode(lines).alias("h")).select("layer", "h.*")
    # the format is one ordered file per layer
    (rows.unionByName(header).repartition("layer").sortWithinPartitions("layer", "cell_row")
     .select("layer", F.col("value")).write.partitionBy("layer").text(path))
    layers = {n: n for n in ("map", "mat", "tmax", "tmin")}
    return scan_ascii_grid(i.spark, path, layers, r"layer=([^/]+)/")[0]


@query("src5_cover_records", """
SELECT site, plot_id, subplot_id, year, species, nativity, cover FROM v_cover""")
def src5(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "cover")
    write_cover(i.cover, path)
    return scan_cover(i.spark, path).select("site", "plot_id", "subplot_id", "year", "species", "nativity", "cover")


@query("src6_tiles_scan", """
SELECT p.rec_id, p.x, p.y, p.z, p.class FROM v_points p
WHERE EXISTS (SELECT 1 FROM v_boxes b
              WHERE floor(p.x / 1000) BETWEEN floor((b.easting - 100) / 1000) AND floor((b.easting + 100) / 1000)
                AND floor(p.y / 1000) BETWEEN floor((b.northing - 100) / 1000) AND floor((b.northing + 100) / 1000))""")
def src6(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "points")
    write_points(with_tile(i.view("v_points")), path)
    return scan_points(i.spark, path, tiles_for(i.view("v_boxes"))).drop("tile_e", "tile_n")


@query("src7_load_saved_model", """
SELECT site, plot_id, year,
       round((nspp_total - avg(nspp_total) OVER ()) / stddev_samp(nspp_total) OVER (), 6) AS z_total,
       round((nspp_native - avg(nspp_native) OVER ()) / stddev_samp(nspp_native) OVER (), 6) AS z_native
FROM v_plot_year""")
def src7(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "model")
    parts = [VectorAssembler(inputCols=["nspp_total", "nspp_native"], outputCol="raw"),
             StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True)]
    Pipeline(stages=parts).fit(i.plot_year).write().save(path)
    z = vector_to_array("z")
    return PipelineModel.load(path).transform(i.plot_year).select(
        "site", "plot_id", "year", round_to(z[0], 6).alias("z_total"), round_to(z[1], 6).alias("z_native"))


@query("snk1_csv_sink", """
SELECT CAST(rec_id AS VARCHAR) AS rec_id, plot_id, coalesce(CAST(cover AS VARCHAR), 'NA') AS cover FROM v_cover""")
def snk1(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "sink-csv")
    write_csv(i.cover.select("rec_id", "plot_id", "cover"), path)
    return i.spark.read.csv(path, header=True, schema="rec_id string, plot_id string, cover string")


@query("snk2_quoted_csv_sink", """
SELECT '"' || site_id || '","' || plot_id || '","' || latitude_text || '"' AS line
FROM (SELECT split_part(plot_id, '_', 2) AS site_id, plot_id, CAST(latitude AS VARCHAR) AS latitude_text
      FROM v_centroids)""")
def snk2(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "sink-quoted")
    rows = i.view("v_centroids").select(F.split_part("plot_id", F.lit("_"), F.lit(2)).alias("site_id"), "plot_id",
                                        F.col("latitude").cast("string").alias("latitude"))
    write_csv(rows, path, quote_all=True)
    return i.spark.read.text(path).filter(F.col("value") != '"site_id","plot_id","latitude"').select(
        F.col("value").alias("line"))


@query("snk3_persist_frame", "SELECT site, plot_id, year, nspp_total, invaded FROM v_plot_year")
def snk3(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "frame")
    i.plot_year.write.parquet(path)
    return i.spark.read.parquet(path).select("site", "plot_id", "year", "nspp_total", "invaded")


@query("snk4_compute_if_absent", """
SELECT site, count(*) AS n_plot_years FROM v_plot_year GROUP BY site""")
def snk4(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "cache")
    materialize(i.spark, path, lambda: i.plot_year)
    again = materialize(i.spark, path, lambda: i.plot_year.limit(0))  # must read, not rebuild
    return again.groupBy("site").agg(F.count(F.lit(1)).alias("n_plot_years"))


PENDING_SQL = """
WITH clips AS (SELECT DISTINCT c.site, c.monthyear, b.latitude, b.longitude,
                      c.site || '_' || c.monthyear || '_' || printf('%.2f', b.longitude) || '_'
                        || printf('%.2f', b.latitude) AS clip
               FROM v_cover c JOIN v_centroids b ON c.plot_id = b.plot_id),
done AS (SELECT DISTINCT clip FROM clips WHERE latitude < 45)
SELECT clip FROM clips WHERE clip NOT IN (SELECT clip FROM done)"""


@query("snk5_pending_clips", PENDING_SQL)
def snk5(i: Inputs) -> DataFrame:
    visits = i.cover.select("site", "monthyear", "plot_id").distinct().join(i.view("v_centroids"), "plot_id")
    clips = visits.select("latitude", clip_key(F.col("site"), F.col("monthyear"), F.col("longitude"),
                                               F.col("latitude")).alias("clip")).distinct()
    return pending(clips, clips.filter(F.col("latitude") < 45), ["clip"]).select("clip")
