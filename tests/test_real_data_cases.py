"""Cases of real tables that well-behaved test views don't show."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.functions.geodesy import utm_zone
from understory.operators.aggregates import cover_by_visit
from understory.operators.diversity import beta_diversity, diversity_info, diversity_metrics
from understory.operators.figstats import boxplot_stats, loess
from understory.operators.resample import group_folds, split_sizes
from understory.operators.spatial import GridTransform
from understory.operators.structure import height_counts, height_entropy, height_layers
from understory.plans.model_table import build_model_table
from understory.session import scratch_path, stored
from understory.sources.files import grid_transform, scan_ascii_grid, scan_cover, scan_csv, scan_csv_text, write_cover

COVER = "site string, plot_id string, subplot_id int, year int, species string, nativity string, cover double"


def test_site_keys_stay_text(spark):
    path = scratch_path(spark, "cover")
    write_cover(spark.createDataFrame([("007", "p", 1, 2000, "a", "N", 1.0), ("12", "q", 1, 2000, "a", "N", 1.0)], COVER), path)
    assert {r.site for r in scan_cover(spark, path).collect()} == {"007", "12"}
    assert scan_cover(spark, path, ["007"]).count() == 1
    back = stored(spark.createDataFrame([("007", 1), ("7", 2)], "site string, x int"), "keys", "site")
    assert {(r.site, r.x) for r in back.collect()} == {("007", 1), ("7", 2)}


def test_stored_partitions_have_few_files(spark):
    df = spark.range(20000, numPartitions=40).select((F.col("id") % 5).alias("fold"), "id")
    back = stored(df, "folds", "fold")
    folders = {}
    for f in back.inputFiles():
        folders.setdefault(os.path.dirname(f), []).append(f)
    assert back.count() == 20000 and len(folders) == 5 and max(map(len, folders.values())) <= 8


def test_csv_columns_by_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a,c\n1,2,2020-01-05\n,NA,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    assert [tuple(r) for r in scan_csv(spark, str(tmp_path), schema).orderBy("a").collect()] == [(None, None), (2, 1.0)]
    inferred = scan_csv(spark, str(tmp_path))
    assert dict(inferred.dtypes) == {"b": "int", "a": "int", "c": "date"}
    assert scan_csv_text(spark, str(tmp_path)).columns == ["b", "a", "c"]
    assert [r.c for r in scan_csv_text(spark, str(tmp_path), ["c"]).collect()] == ["2020-01-05", None]
    with pytest.raises(ValueError):
        scan_csv_text(spark, str(tmp_path), ["z"])
    (tmp_path / "y.csv").write_text("a,b,c\n1,2,2020-01-05\n")
    with pytest.raises(Exception):
        scan_csv(spark, str(tmp_path), schema).collect()


def test_taxa_count_once(spark):
    rows = [("s", "p", 1, 2000, "oak", "N", 2.0), ("s", "p", 2, 2000, "oak", "I", 1.0), ("s", "p", 1, 2000, None, "N", 3.0),
            ("s", "q", 1, 2000, None, None, None)]
    got = {r.plot_id: r for r in diversity_metrics(spark.createDataFrame(rows, COVER)).collect()}
    p, q = got["p"], got["q"]
    assert (p.nspp_total, p.nspp_native, p.nspp_exotic, p.invaded) == (1, 1, 1, "invaded")
    assert p.shannon_total == pytest.approx(0) and p.rel_cover_exotic == pytest.approx(1 / 6)
    assert (q.nspp_total, q.invaded, q.rel_cover_exotic) == (0, "not invaded", None)


def test_null_keys_keep_their_groups(spark):
    rows = [(None, "p", k, 2000, s, "N", 1.0) for k, s in ((1, "a"), (1, "b"), (2, "b"), (2, "c"))]
    cover = spark.createDataFrame(rows, COVER)
    info = diversity_info(cover, "plot").first()
    assert info.site is None and info.beta_sor == pytest.approx(beta_diversity(cover).first().beta_sor) and info.n_units == 2
    box = boxplot_stats(spark.createDataFrame([("g", 1.0), (None, 2.0), (None, 4.0)], "g string, x double"), ["g"], "x")
    assert {r.g: r.med for r in box.collect()} == {"g": 1.0, None: 3.0}
    visits = spark.createDataFrame([("s", None, None, 2000, "p", "a", "N", 1.0), ("s", "2000-05", "s2000-05", 2000, "p", "a", "I", 1.0)],
                                   "site string, monthyear string, sitemonthyear string, year int, plot_id string, species string, nativity string, cover double")
    classes = spark.createDataFrame([("p", "forest")], "plot_id string, nlcd string")
    assert {r.monthyear: (r.numplots, r.dominant_nlcd_classes) for r in cover_by_visit(visits, classes).collect()} == {None: (1, "forest"), "2000-05": (1, "forest")}


def test_folds_keep_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 1, "s"), (None, 2, "s"), ("a", 3, None), ("b", 4, "s")], "plot_id string, x int, site string")
    folded = group_folds(df, "plot_id", v=2)
    assert folded.count() == 4 and len({r.fold for r in folded.collect() if r.plot_id is None}) == 1
    assert group_folds(df, "plot_id", v=2, within=["site"]).count() == 4
    assert {r.n_assessment + r.n_analysis for r in split_sizes(folded).collect()} == {4}


def test_coordinates_in_the_plot_table_are_no_key(spark):
    insitu = spark.createDataFrame([("s", "p", 2000, 1, 1, 5.0, 10.0, 45.0000001)],
                                   "site string, plot_id string, year int, nspp_exotic int, nspp_total int, slope double, aspect double, latitude double")
    history = spark.createDataFrame([("p", "s", 2000, 0)], "plot_id string, site string, year int, x_tsc_2000 int")
    centroids = spark.createDataFrame([("p", "basePlot", 45.0, 10.5)], "plot_id string, subtype string, latitude double, longitude double")
    raster = spark.createDataFrame([(k, r, c, float(r + c)) for k in ("map", "mat", "tmax", "tmin") for r in range(2) for c in range(2)],
                                   "layer string, cell_row int, cell_col int, value double")
    grid = (raster, GridTransform(10.0, 46.0, 1.0, 1.0))
    row = build_model_table(insitu, history, centroids, grid, grid).first()
    assert row.latitude == 45.0000001 and row.map is not None and row.tmin is not None


def test_layers_must_agree(spark, tmp_path):
    body = "ncols 2\nnrows 1\nxllcorner {}\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2\n"
    (tmp_path / "a.asc").write_text(body.format(0))
    (tmp_path / "b.asc").write_text(body.format(5))
    cells, transform = scan_ascii_grid(spark, str(tmp_path), {"a": "map", "b": "mat"})
    assert cells.count() == 4
    with pytest.raises(ValueError):
        grid_transform(transform)
    with pytest.raises(Exception, match="two files"):
        scan_ascii_grid(spark, str(tmp_path), {"a": "map", "b": "map"})[0].collect()


def test_last_meridian(spark):
    lons = spark.createDataFrame([(-180.0,), (179.9,), (180.0,)], "lon double")
    assert [r[0] for r in lons.select(utm_zone(F.col("lon"))).collect()] == [1, 60, 60]


def test_returns_below_ground_are_in_the_lowest_layer(spark):
    pts = spark.createDataFrame([("p", -0.5), ("p", 0.2), ("p", 3.5)], "plot_id string, z double")
    layers = height_layers(height_counts(pts))
    assert {r.layer: r.n for r in layers.collect()} == {0: 2, 3: 1}
    assert height_entropy(layers).first().entropy > 0


def test_loess_counts_whole_neighbours(spark):
    # 0.29 * 100 falls just under 29 in binary
    df = spark.createDataFrame([("g", float(k), float(k) * 2 + 1) for k in range(100)], "g string, x double, y double")
    assert int(100 * 0.29) == 28
    out = loess(df, ["g"], "x", "y", span=0.29, points=5).collect()
    assert len(out) == 5
