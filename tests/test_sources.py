"""Scans, sinks and incremental operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.operators.spatial import GridTransform, sample_raster, sample_raster_360, with_tile
from understory.session import broadcast_if_small, broadcast_limit, scratch_dir, scratch_path, stored
from understory.sources.files import (grid_transform, scan_ascii_grid, scan_csv, scan_csv_text, scan_files, scan_points,
                                      write_csv, write_points)
from understory.streaming.incremental import materialize, pending


def test_csv_missing_values_and_line_ends(spark, tmp_path):
    (tmp_path / "v.csv").write_bytes(b'siteID,date1,Cover\r\n"BONA",2017-08,NaN\r\nCLBJ,NA,"12.5"\r\nX,,1\r\n')
    schema = T.StructType([T.StructField("siteID", T.StringType()), T.StructField("date1", T.StringType()),
                           T.StructField("Cover", T.DoubleType())])
    rows = {r.siteid: (r.date1, r.cover) for r in scan_csv(spark, str(tmp_path), schema).collect()}
    assert rows == {"BONA": ("2017-08", None), "CLBJ": (None, 12.5), "X": (None, 1.0)}
    text = scan_csv_text(spark, str(tmp_path), ["Cover", "siteID"])  # by header name, not by place
    assert text.dtypes == [("cover", "string"), ("siteid", "string")]
    assert {r.siteid: r.cover for r in text.collect()} == {"BONA": "NaN", "CLBJ": "12.5", "X": "1"}


def test_csv_sink_writes_na(spark):
    path = scratch_path(spark, "t")
    write_csv(spark.createDataFrame([("a", None), ("b", 1.5)], "k string, x double"), path)
    lines = {r.value for r in spark.read.text(path).collect()}
    assert {"k,x", "a,NA", "b,1.5"} == lines


def test_grid_scan_and_sampling(spark, tmp_path):
    body = "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 50\ncellsize 1\nNODATA_value -9999\n"
    (tmp_path / "ppt.asc").write_text(body + "1 2 3\n4 -9999 6\n")
    (tmp_path / "tmean.asc").write_text(body + "7 8 9\n10 11 12\n")
    cells, transform = scan_ascii_grid(spark, str(tmp_path), {"ppt": "map", "tmean": "mat"})
    assert cells.count() == 12 and cells.filter("value is null").count() == 1
    grid = grid_transform(transform)
    assert grid == GridTransform(10.0, 52.0, 1.0, 1.0)
    pts = spark.createDataFrame([(1, 10.5, 51.5), (2, 11.2, 50.1), (3, 99.0, 0.0)], "k int, longitude double, latitude double")
    got = {r.k: (r.map, r.mat) for r in sample_raster(pts, cells, grid, ("map", "mat")).collect()}
    assert got == {1: (1.0, 7.0), 2: (None, 11.0), 3: (None, None)}
    west = spark.createDataFrame([(1, -349.5, 51.5)], "k int, longitude double, latitude double")
    assert sample_raster_360(west, cells, grid, ("map",)).first().map == 1.0


def test_tiles_prune_the_scan(spark):
    path = scratch_path(spark, "pts")
    pts = spark.createDataFrame([(10.0, 10.0), (1500.0, 10.0), (2500.0, 2500.0)], "x double, y double")
    write_points(with_tile(pts), path)
    tiles = spark.createDataFrame([(1000, 0)], "tile_e int, tile_n int")
    assert [r.x for r in scan_points(spark, path, tiles).collect()] == [1500.0]
    assert scan_files(spark, path, "*.parquet", "tile_e=2000").count() == 1


def test_materialize_and_pending(spark):
    path = scratch_path(spark, "cache")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert materialize(spark, path, build).count() == 3 and materialize(spark, path, build).count() == 3
    assert len(built) == 1
    work = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in pending(work, work.filter(F.col("k") == "a"), ["k"]).collect()] == ["b"]


def test_scratch_and_size_checked_broadcast(spark):
    assert scratch_dir(spark) == scratch_dir(spark)
    assert stored(spark.range(5), "s").count() == 5
    assert broadcast_limit(spark) == 10 * 2**20
    big = spark.range(10**9)
    for df, hinted in ((spark.range(10), True), (big, False)):
        assert ("ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().logical().toString()
                or "UnresolvedHint" in broadcast_if_small(df)._jdf.queryExecution().logical().toString()
                or "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()) is hinted
