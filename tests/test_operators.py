"""Order statistics, resampling, diversity, geodesy, structure, figure statistics and special functions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.functions.geodesy import to_utm
from understory.functions.special import bernoulli_loglik, beta_loglik, digamma, lgamma, trigamma
from understory.operators import structure as st
from understory.operators.diversity import beta_diversity, diversity_metrics, time_since_change
from understory.operators.figstats import boxplot_outliers, boxplot_stats, loess
from understory.operators.levels import order_levels
from understory.operators.ordering import exact_quantiles, hashed_positions, rank_average, top_k, zscore
from understory.operators.resample import group_folds, split_counts, train_test_split
from understory.operators.spatial import clip_key, crop, tiles_for
from understory.operators.verbs import visited_years


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, heavy ties, a long tail and missing values."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(np.arange(n) % 3 == 0, "hot", np.array([f"g{k % 40}" for k in range(n)]))
    x = np.round(np.exp(rng.normal(0, 2, n)), 1)
    pdf = pd.DataFrame({"id": range(n), "g": g, "x": x})
    pdf.loc[pdf.id % 17 == 0, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


def test_quantiles_match_linear_interpolation(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    exp = pdf.groupby("g").x.quantile([0.25, 0.5, 0.9]).unstack()
    assert np.allclose(got.loc[exp.index, ["a", "b", "c"]], exp)
    whole = exact_quantiles(df, [], "x", {"m": 0.5}).first().m
    assert whole == pytest.approx(pdf.x.median())


def test_average_ranks_and_zscores(skewed):
    pdf, df = skewed
    got = rank_average(df, ["g"], "x").toPandas().set_index("id").sort_index()
    assert np.allclose(got["rank"], pdf.set_index("id").groupby("g").x.rank(), equal_nan=True)
    z = zscore(df, ["x"], ["g"]).toPandas().set_index("id").sort_index().x
    exp = pdf.groupby("g").x.transform(lambda s: (s - s.mean()) / s.std())
    assert np.allclose(z, exp, equal_nan=True)
    whole = zscore(df, ["x"]).toPandas().set_index("id").sort_index().x
    assert np.allclose(whole, (pdf.x - pdf.x.mean()) / pdf.x.std(), equal_nan=True)


def test_top_k_limits_before_the_shuffle(skewed):
    pdf, df = skewed
    out = top_k(df, ["g"], "x", 3)
    exp = pdf[pdf.groupby("g").x.rank(method="min", ascending=False) <= 3]
    assert set(r.id for r in out.collect()) == set(exp.id)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_hashed_positions_number_every_row_once(skewed):
    _, df = skewed
    d = df.withColumn("h", F.md5(F.col("id").cast("string")))
    out = hashed_positions(d, ["g"], "h", "pos", total="n").toPandas()
    for _, part in out.groupby("g"):
        assert list(part.sort_values("h").pos) == list(range(len(part))) and (part.n == len(part)).all()


def test_folds_keep_groups_together_and_even(spark):
    d = spark.range(3000).select((F.col("id") % 103).cast("string").alias("plot"), "id")
    out = group_folds(d, "plot", v=10, seed=4).toPandas()
    assert len(out) == 3000 and out.groupby("plot").fold.nunique().max() == 1
    sizes = out.groupby("fold")["plot"].nunique()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 1
    again = group_folds(d, "plot", v=10, seed=4).toPandas().set_index("id").sort_index().fold
    assert (again == out.set_index("id").sort_index().fold).all()
    c = split_counts(group_folds(d, "plot", v=10, seed=4), "plot").toPandas()
    assert (c.held_out + c.training == 103).all()
    train, test = train_test_split(d, "plot", v=4)
    assert train.count() + test.count() == 3000
    within = group_folds(d.withColumn("site", F.col("id") % 103 % 2), "plot", v=5, within=["site"]).toPandas()
    per = within.groupby(["site", "fold"])["plot"].nunique()
    assert len(per) == 10 and per.max() - per.min() <= 1


def test_level_order(spark):
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 5), ("b", 3.0, 9), ("c", 1.0, 5)], "v string, x double, y int")
    assert {r.v: r.o for r in order_levels(d, "v", "x", "y", "o").collect()} == {"b": 1, "a": 2, "c": 3}


COVER = [("s1", "p1", k % 3, 2000, f"sp{(k * 7) % 5 + k % 2}", "I" if k % 4 == 0 else "N", float(k % 3)) for k in range(14)]
COVER += [("s1", "p2", 1, 2000, "sp1", "N", None), ("s1", "p3", 0, 2000, "sp9", "I", 4.0), ("s1", "p3", 1, 2000, "sp9", "I", 4.0)]


def test_beta_diversity_against_pairs(spark):
    d = spark.createDataFrame(COVER, "site string, plot_id string, subplot_id int, year int, species string, "
                                     "nativity string, cover double")
    got = {r.plot_id: r for r in beta_diversity(d, "plot").collect()}
    sets: dict = {}
    for s, p, u, *_rest in COVER:
        sets.setdefault(p, {}).setdefault(u, set()).add(_rest[1])
    for p, units in sets.items():
        total = set().union(*units.values())
        excess = sum(map(len, units.values())) - len(total)
        lo = sum(min(len(a - b), len(b - a)) for a, b in itertools.combinations(units.values(), 2))
        hi = sum(max(len(a - b), len(b - a)) for a, b in itertools.combinations(units.values(), 2))
        if excess + lo:
            assert got[p].beta_sim == pytest.approx(lo / (excess + lo))
            assert got[p].beta_sor == pytest.approx((lo + hi) / (2 * excess + lo + hi))
        else:
            assert got[p].beta_sim is None
    assert got["p3"].beta_sor == 0


def test_diversity_of_hand_computed_plot(spark):
    rows = [("s", "p", 0, 1, "a", "N", 1.0), ("s", "p", 1, 1, "a", "N", 1.0), ("s", "p", 0, 1, "b", "I", 2.0),
            ("s", "p", 0, 1, "c", "N", None), ("s", "q", 0, 1, "c", "N", None)]
    d = spark.createDataFrame(rows, "site string, plot_id string, subplot_id int, year int, species string, "
                                    "nativity string, cover double")
    out = {r.plot_id: r for r in diversity_metrics(d).collect()}
    p, q = out["p"], out["q"]
    assert (p.nspp_total, p.nspp_native, p.nspp_exotic, p.invaded) == (3, 2, 1, "invaded")
    assert p.shannon_total == pytest.approx(math.log(2)) and p.rel_cover_exotic == 0.5
    assert (q.invaded, q.rel_cover_exotic, q.shannon_total) == ("not invaded", None, None)


def test_time_since_change_and_calendar(spark):
    h = spark.createDataFrame([("p", 1996, "s", 0, 7, 1), ("p", 1998, "s", 0, 7, 1), ("q", 1998, "s", 3, None, 1)],
                              "plot_id string, year int, site string, x_tsc_1996 int, x_tsc_1998 int, x_tsc_1998_median_1 int")
    assert {(r.plot_id, r.year): r.days_since_change for r in time_since_change(h).collect()} == {
        ("p", 1996): 99999, ("p", 1998): 7, ("q", 1998): None}
    cal = spark.createDataFrame([("S", "2017-07", "2017-08", None)], "site_id string, date1 string, date2 string, date3 string")
    assert [(r.site_id, r.year) for r in visited_years(cal).collect()] == [("S", 2017)]


def test_utm_known_positions(spark):
    pts = spark.createDataFrame([("equator", 3.0, 0.0), ("toronto", -79.387139, 43.642566), ("south", 151.2, -33.9)],
                                "n string, lon double, lat double").withColumns(to_utm(F.col("lon"), F.col("lat")))
    r = {x.n: x for x in pts.collect()}
    assert (r["equator"].zone, r["equator"].easting, r["equator"].northing) == (31, pytest.approx(500000), pytest.approx(0))
    # CN Tower, a position published with its UTM coordinates
    assert r["toronto"].zone == 17 and r["toronto"].easting == pytest.approx(630084, abs=1)
    assert r["toronto"].northing == pytest.approx(4833439, abs=1)
    assert 6e6 < r["south"].northing < 7e6


def test_crop_edges_overlaps_and_plan(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 50.0), (3, -100.0, -100.0), (4, 99.99, 99.99)],
                                "id int, x double, y double")
    boxes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 150.0, 50.0)], "plot_id string, easting double, northing double")
    out = crop(pts, boxes)
    assert sorted((r.plot_id, r.id) for r in out.collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 2), ("b", 4)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.tile_e, r.tile_n) for r in tiles_for(boxes).collect()) == [(-1000, -1000), (-1000, 0), (0, -1000), (0, 0)]
    key = spark.range(1).select(clip_key(F.lit("S"), F.lit("2017-08"), F.lit("500100"), F.lit(1.5)).alias("k")).first().k
    assert key == "S_2017-08_500100.00_1.50"


def test_structure_of_hand_computed_cloud(spark):
    # 2 x 2 m plot, 1 m cells; heights 4, 4, 4, 4 -> flat canopy
    flat = [("p", x + 0.5, y + 0.5, 4.0, 5) for x in range(2) for y in range(2)]
    tall = [("q", 0.5, 0.5, 0.5, 5), ("q", 1.5, 0.5, 3.5, 5), ("q", 0.5, 1.5, 4.5, 5), ("q", 0.6, 1.5, 0.0, 5)]
    d = spark.createDataFrame(flat + tall, "plot_id string, x double, y double, z double, class int")
    out = {r.plot_id: r for r in st.structure_metrics(d, cell=1.0, half=1.0).collect()}
    p, q = out["p"], out["q"]
    assert (p.rumple, p.deepgap_fraction, p.cover_fraction, p.max_canopy_ht) == (1.0, 0.0, 1.0, 4.0)
    assert (p.q25, p.q50, p.vert_sd, p.entropy) == (4.0, 4.0, 0.0, 0.0)
    assert q.deepgap_fraction == 0.25 and q.rumple is None and q.max_canopy_ht == 4.5
    # layers 0 (two), 3, 4: gaps above 3 m are 2/3 and 3/4
    assert q.gfp == pytest.approx((2 / 3 + 3 / 4) / 2)
    assert q.vai == pytest.approx((math.log(3 / 2) + math.log(4 / 3)) / 0.5)
    share = [2 / 4, 1 / 4, 1 / 4]
    h = -sum(s * math.log(s) for s in share)
    assert q.entropy == pytest.approx(h / math.log(5)) and q.vci == pytest.approx(h / math.log(100))


def test_rumple_of_a_slope_and_ground_height(spark):
    rows = [("p", x + 0.5, y + 0.5, float(x), 5) for x in range(3) for y in range(3)]
    d = spark.createDataFrame(rows, "plot_id string, x double, y double, z double, class int")
    assert st.rumple_index(st.canopy_height_model(d)).first().rumple == pytest.approx(math.sqrt(2))
    g = spark.createDataFrame([("p", 0.1, 0.1, 10.0, 2), ("p", 0.2, 0.1, 15.0, 5), ("p", 5.1, 0.1, 12.0, 5)],
                              "plot_id string, x double, y double, z double, class int")
    assert sorted(r.z for r in st.height_above_ground(g).collect()) == [0.0, 2.0, 5.0]


def test_boxplot(spark):
    d = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, x double")
    r = boxplot_stats(d, ["g"], "x").first()
    assert (r.q1, r.med, r.q3, r.whisker_low, r.whisker_high, r.n_outliers) == (2, 3, 4, 1, 4, 1)
    assert [x.x for x in boxplot_outliers(d, ["g"], "x").collect()] == [100.0]
    assert boxplot_stats(d, [], "x").first().n_outliers == 1


def test_local_regression_is_exact_on_a_quadratic(spark):
    d = spark.createDataFrame([("g", float(v), 2.0 - v + 0.5 * v * v) for v in range(40)], "g string, x double, y double")
    out = loess(d, ["g"], "x", "y", span=0.5, points=11).collect()
    assert len(out) == 11
    for r in out:
        assert r.fit == pytest.approx(2.0 - r.x + 0.5 * r.x * r.x, abs=1e-6)


def test_special_functions(spark):
    xs = [0.01, 0.3, 1.0, 2.5, 17.0, 400.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    h = 1e-5
    for r in d.select("x", lgamma(F.col("x")).alias("l"), digamma(F.col("x")).alias("d"), trigamma(F.col("x")).alias("t"),
                      ((lgamma(F.col("x") * (1 + h)) - lgamma(F.col("x") * (1 - h))) / (F.col("x") * 2 * h)).alias("fd"),
                      ((digamma(F.col("x") * (1 + h)) - digamma(F.col("x") * (1 - h))) / (F.col("x") * 2 * h)).alias("ft")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-10)
        assert r.d == pytest.approx(r.fd, rel=1e-4, abs=1e-5) and r.t == pytest.approx(r.ft, rel=1e-4)
    r = spark.range(1).select(bernoulli_loglik(F.lit(1.0), F.lit(-800.0)).alias("b"),
                              beta_loglik(F.lit(0.3), F.lit(0.5), F.lit(2.0)).alias("u")).first()
    assert r.b == pytest.approx(-800.0) and r.u == pytest.approx(0.0, abs=1e-10)  # uniform density


def test_buckets_of_a_long_tail_are_even(spark):
    from understory.operators.ordering import even_buckets, exact_quantiles, rank_average

    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(0, 4, 20_000))  # lognormal: nearly all values in one of 256 equal widths
    x[-200:] = -x[-200:]
    pdf = pd.DataFrame({"g": ["hot"] * 19_000 + ["cold"] * 1_000, "x": x})
    df = spark.createDataFrame(pdf)
    for keys in (["g"], []):
        cells = even_buckets(df, keys, "x", "b").toPandas()
        for _, part in cells.groupby("g") if keys else [("", cells)]:
            assert part.b.between(0, 255).all() and part.b.value_counts(normalize=True).max() <= 0.02
            ordered = part.sort_values("x")
            assert ordered.b.is_monotonic_increasing
    got = {r.g: (r.a, r.b) for r in exact_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.99}).collect()}
    ranks = rank_average(df, ["g"], "x").toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.x, [0.5, 0.99]))
        mine = ranks[ranks.g == g]
        assert np.allclose(mine["rank"], mine.x.rank())


def test_buckets_of_few_and_missing_values(spark):
    from understory.operators.ordering import exact_quantiles, ordered_counts

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 3), (None, 5)], "g string, x int")
    got = {(r.g, r.x): (r.n, r.before, r.total, r.d_before, r.d_total) for r in ordered_counts(df, ["g"], "x").collect()}
    assert got == {("a", 1): (2, 0, 2, 0, 1), (None, 3): (1, 0, 2, 0, 2), (None, 5): (1, 1, 2, 1, 2)}
    assert {r.g: r.q for r in exact_quantiles(df, ["g"], "x", {"q": 0.5}).collect()} == {"a": 1.0, None: 4.0}


@pytest.mark.parametrize("span", [0.1, 0.5, 1.5])
def test_loess_as_plain_weighted_least_squares(spark, span):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.round(np.exp(rng.normal(0, 1, 500)), 2), rng.uniform(0, 3, 300)])  # ties, a long tail, many blocks
    y = np.sin(x) + rng.normal(0, 0.1, 800)
    pdf = pd.DataFrame({"g": "a", "x": x, "y": y})
    few = pd.DataFrame({"g": None, "x": [1.0, 2.0, 2.0, 4.0, 5.0], "y": [1.0, 2.0, 3.0, 1.0, 0.0]})
    d = spark.createDataFrame(pd.concat([pdf, few]), "g string, x double, y double")
    got = {(r.g, r.idx): (r.x, r.fit) for r in loess(d, ["g"], "x", "y", span=span, points=9).collect()}
    for g, part in (("a", pdf), (None, few)):
        xs, ys, n = part.x.to_numpy(), part.y.to_numpy(), len(part)
        for k, x0 in enumerate(np.linspace(xs.min(), xs.max(), 9)):
            dist = np.abs(xs - x0)
            h = np.sort(dist)[min(max(int(span * n + 1e-5), 1), n) - 1] * max(1.0, span)
            w = np.where(dist < h, (1 - (dist / h) ** 3) ** 3, 0.0) if h > 0 else np.zeros(n)
            t = (xs - x0) / h if h > 0 else xs
            m = [(w * t**j).sum() for j in range(5)]
            full = np.array([[m[0], m[1], m[2]], [m[1], m[2], m[3]], [m[2], m[3], m[4]]])
            if w.sum() == 0:
                assert (g, k) not in got
            elif abs(np.linalg.det(full)) > m[0] ** 3 * 1e-9:
                assert got[g, k] == (pytest.approx(x0), pytest.approx(np.linalg.solve(full, [(w * ys * t**j).sum() for j in range(3)])[0], rel=1e-6, abs=1e-7))


def test_tiled_raster_reads_touched_tiles_only(spark, tmp_path):
    from understory.operators.spatial import GridTransform, sample_raster, sample_tiles, tile_raster

    grid = GridTransform(x0=0.0, y0=64.0, dx=1.0, dy=1.0)
    cells = spark.range(64 * 64).selectExpr("CAST(id DIV 64 AS INT) AS cell_row", "CAST(id % 64 AS INT) AS cell_col",
                                            "explode(array('map', 'mat')) AS layer", "CAST(id AS DOUBLE) AS value")
    points = spark.createDataFrame([("a", 1.5, 62.5), ("b", 3.2, 60.1), ("out", -5.0, 60.0), ("far", 500.0, 3.0), ("gap", None, 60.0), ("a2", 1.5, 62.5)],
                                   "plot_id string, longitude double, latitude double")
    tiles = tile_raster(cells, f"file://{tmp_path}/tiles", ("map", "mat"), side=8)
    out = sample_tiles(points, tiles, grid, ("map", "mat"), side=8)
    got = {r.plot_id: (r["map"], r.mat) for r in out.collect()}
    assert got == {"a": (65.0, 65.0), "a2": (65.0, 65.0), "b": (195.0, 195.0), "out": (None, None), "far": (None, None), "gap": (None, None)}
    assert got == {r.plot_id: (r["map"], r.mat) for r in sample_raster(points, cells, grid, ("map", "mat")).collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
