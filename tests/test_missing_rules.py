"""Missing-value, text and number rules, each on a few rows."""

import pytest
from pyspark.sql import functions as F

from understory.functions.labels import GROUP_ORDER, effect_group, level_order, short_label
from understory.functions.missing import if_else, mean_strict, nan_to_null, not_in, safe_corr, sum_strict
from understory.functions.scalars import (extract_first, folded_aspect, invasion_class, paste0, remove_all, round_to,
                                          signif, significance_stars, str_c, upper_if_three, wrap_longitude, year_of)
from understory.operators.joins import (first_per_key, left_join, member_of, natural_left_join, not_member_of,
                                        right_join, size_gate)
from understory.operators.verbs import canonical_names, map_numeric, select_matching, split_by_site


def values(df, col):
    return [r[col] for r in df.orderBy("k").collect()]


def test_negated_membership_keeps_missing(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, s string")
    assert values(d.filter(not_in(F.col("s"), ["a"])), "s") == [None, "b"]
    inside, rest = split_by_site(d, "s", ["a"])
    assert inside.count() == 1 and rest.count() == 2


def test_if_else_is_missing_when_condition_is(spark):
    d = spark.createDataFrame([(1, 2), (2, None), (3, 0)], "k int, x int")
    assert values(d.withColumn("y", if_else(F.col("x") > 0, F.lit(1), F.lit(0))), "y") == [1, None, 0]


def test_strict_aggregates(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    out = {r.k: (r.m, r.s) for r in d.groupBy("k").agg(mean_strict(F.col("x")).alias("m"),
                                                      sum_strict(F.col("x")).alias("s")).collect()}
    assert out == {"a": (None, None), "b": (3.0, 6.0)}


def test_nan_becomes_null_and_correlation_is_safe(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, x double")
    assert values(d.withColumn("x", nan_to_null(F.col("x"))), "x") == [None, 1.0]
    c = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    r = c.agg(safe_corr(F.col("a"), F.col("b")).alias("ab"), safe_corr(F.col("a"), F.col("c")).alias("ac")).first()
    assert r.ab == pytest.approx(1.0) and r.ac is None


def test_text_rules(spark):
    d = spark.createDataFrame([(1, None, "2017-08", "X_TSC_1996"), (2, "b", "bad", "none")],
                              "k int, s string, my string, name string")
    d = d.select("k", str_c(F.lit(2017), F.col("s")).alias("c"), paste0(F.col("s"), F.lit("_")).alias("p"),
                 year_of(F.col("my")).alias("y"), extract_first(F.col("name"), r"\d{4}").alias("e"),
                 remove_all(F.lit("xaop.AOP"), [".aop", ".AOP"]).alias("r"))
    assert values(d, "c") == [None, "2017b"] and values(d, "p") == ["NA_", "b_"]
    assert values(d, "y") == [2017, None] and values(d, "e") == ["1996", None] and values(d, "r") == ["", ""]


def test_number_rules(spark):
    d = spark.createDataFrame([(1, 123.4), (2, 0.01264), (3, -9.96), (4, 0.0)], "k int, x double")
    assert values(d.withColumn("s", signif(F.col("x"), 2)), "s") == pytest.approx([120, 0.013, -10, 0])
    r = spark.range(1).select(round_to(F.lit(0.15), 1).alias("a"), round_to(F.lit(-2.5), 0).alias("b"),
                              folded_aspect(F.lit(45.0)).alias("f0"), folded_aspect(F.lit(225.0)).alias("f180"),
                              wrap_longitude(F.lit(-150.0)).alias("w"), wrap_longitude(F.lit(10.0)).alias("u")).first()
    assert (r.a, r.b, r.f0, r.f180, r.w, r.u) == (0.2, -3.0, 0.0, 180.0, 210.0, 10.0)


def test_classes_stars_and_labels(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 49.9), (3, 50.0), (4, 100.0), (5, None)], "k int, x double")
    assert values(d.withColumn("c", invasion_class(F.col("x"), 100.0)), "c") == ["0", "0-50", "50-100", "100", None]
    p = spark.createDataFrame([(1, 0.0005), (2, 0.005), (3, 0.03), (4, 0.07), (5, None)], "k int, p double")
    assert values(p.withColumn("s", significance_stars(F.col("p"))), "s") == ["***", "**", "*", "", None]
    n = spark.createDataFrame([(1, "map"), (2, "folded_aspect"), (3, "vpdmx"), (4, "rumple")], "k int, n string")
    assert values(n.withColumn("l", short_label(F.col("n"))), "l") == ["MAP", "aspect", "vpdmx", "rumple"]
    assert values(n.withColumn("g", effect_group(F.col("n"))), "g") == ["Climate", None, "Climate", "Structure"]
    assert values(n.withColumn("u", upper_if_three(F.col("n"))), "u")[0] == "MAP"
    assert spark.range(1).select(level_order(F.lit("Structure"), GROUP_ORDER)).first()[0] == 3


def test_joins_match_missing_keys_and_suffix_clashes(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, g string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "g string, n int")
    assert values(natural_left_join(a, b), "n") == [10, 20, None]
    with pytest.raises(ValueError):
        natural_left_join(a, b.toDF("u", "v"))
    c = spark.createDataFrame([("x", 9)], "g string, k int")
    assert set(left_join(a, c, ["g"]).columns) == {"g", "k_x", "k_y"}
    months = spark.createDataFrame([("x", "2017-07"), ("x", "2017-08"), ("z", "2017-09")], "sid string, my string")
    out = right_join(a, months, [("g", "sid")])
    assert {(r.g, r.my): r.k for r in out.collect()} == {("x", "2017-07"): 2, ("x", "2017-08"): 2, ("z", "2017-09"): None}
    assert member_of(a, months, [("g", "sid")]).count() == 1
    assert not_member_of(a, months, [("g", "sid")]).count() == 2


def test_first_row_and_size_gate(spark):
    d = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None)], "g string, k int, v string")
    assert {r.g: r.v for r in first_per_key(d, ["g"], ["k"]).collect()} == {"a": "early", "b": None}
    assert {r.g for r in size_gate(d, "g", 1).collect()} == {"a"}


def test_names_and_whole_frame_rounding(spark):
    d = spark.createDataFrame([(1.234, "x", 5)], "`rumple.aop` double, Name string, Q25 int")
    c = canonical_names(d)
    assert c.columns == ["rumple_aop", "name", "q25"]
    assert map_numeric(c, lambda v: round_to(v, 1)).first().rumple_aop == 1.2
    with pytest.raises(ValueError):
        canonical_names(spark.createDataFrame([(1, 2)], "MAP int, map_ int").toDF("MAP", "map"))
    w = spark.createDataFrame([(1, 2, 3)], "plot int, X_TSC_1 int, x_tsc_median_1 int")
    assert select_matching(w, ["plot"], "x_tsc", "median_1").columns == ["plot", "X_TSC_1"]
