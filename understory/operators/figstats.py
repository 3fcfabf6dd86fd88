"""Statistics that figures are drawn from."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from understory.operators.ordering import (even_buckets, exact_quantiles, join_back, ordered_counts, positions_of_counts,
                                           quantiles_of_counts)
from understory.session import stored


def boxplot_stats(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR, and the number of outliers."""
    keys = list(keys)
    counts = ordered_counts(df, keys, col)
    q = quantiles_of_counts(counts, keys, col, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    x = F.col(col)
    inside = (x >= F.col("_low")) & (x <= F.col("_high"))
    fenced = join_back(counts, _fences(q), keys)
    ends = fenced.groupBy(*keys).agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"))
    return join_back(q, ends, keys)


def _fences(q: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"_low": F.col("q1") - iqr * 1.5, "_high": F.col("q3") + iqr * 1.5}).drop("q1", "med", "q3")


def boxplot_outliers(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows outside the fences, as rows: the set has no bound per group."""
    q = exact_quantiles(df, keys, col, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    x = F.col(col)
    return (join_back(df, _fences(q), keys)
            .filter((x < F.col("_low")) | (x > F.col("_high"))).drop("_low", "_high"))


def _det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def loess(df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.75,
          points: int = 80) -> DataFrame:
    """Local quadratic regression with tricube weights at evenly spaced points of each panel.

    The bandwidth at a point is the distance to its floor(span*n)-th nearest
    observation (scaled up when span > 1). Equal x are pre-aggregated, and lie in
    blocks of the panel in the order of x. For a point, the few blocks that may
    hold its bandwidth, and those that x0 or the end of the window cuts, are met
    row by row; all other blocks enter by their own moments, as the weight is a
    polynomial on either side of the point. So rows are repeated for the points
    near their block only, and no panel is ever gathered in one task.
    """
    keys = list(keys)
    at = [*keys, "idx"]
    obs = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
           .groupBy(*keys, F.col(x).cast("double").alias("_x"))
           .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_sy")))
    obs = stored(even_buckets(obs, keys, "_x", "_b"), "loess")
    pairs = _points_by_block(obs, keys, points)

    # the bandwidth lies between the first distances that some and that surely enough rows are within
    nth = F.least(F.greatest(F.floor(F.col("_tot") * span + 1e-5), F.lit(1)), F.col("_tot"))
    of = W.partitionBy(*at)  # BLOCKS rows at most
    pairs = pairs.withColumns({"_some": F.sum("_n").over(of.orderBy("_near").rangeBetween(W.unboundedPreceding, W.currentRow)),
                               "_all": F.sum("_n").over(of.orderBy("_far").rangeBetween(W.unboundedPreceding, W.currentRow)), "_k": nth})
    pairs = pairs.withColumns({"_from": F.min(F.when(F.col("_some") >= F.col("_k"), F.col("_near"))).over(of),
                               "_to": F.min(F.when(F.col("_all") >= F.col("_k"), F.col("_far"))).over(of)})
    below = F.coalesce(F.sum(F.when(F.col("_far") < F.col("_from"), F.col("_n"))).over(of), F.lit(0))
    open_ = (pairs.withColumn("_tot", F.col("_k") - below).filter((F.col("_far") >= F.col("_from")) & (F.col("_near") <= F.col("_to")))
             .select(*at, "x0", "_b", "_tot"))
    dist = _rows_of(open_, obs, keys).groupBy(*at, F.abs(F.col("_x") - F.col("x0")).alias("_d")).agg(
        F.sum("_n").alias("n"), F.max("_tot").alias("_tot"))
    width = nth_smallest(dist, at, "_d", F.col("_tot")).withColumn("_h", F.col("_kth") * max(1.0, span)).drop("_kth")

    placed = join_back(pairs.select(*at, "x0", "_b", "_lo", "_hi", "_near", "_far"), width, at).filter(F.col("_near") < F.col("_h"))
    whole = (F.col("_far") < F.col("_h")) & ((F.col("_hi") <= F.col("x0")) | (F.col("_lo") >= F.col("x0")))
    cut = _rows_of(placed.filter(~whole).select(*at, "x0", "_b", "_h"), obs, keys)
    t = (F.col("_x") - F.col("x0")) / F.col("_h")
    u = F.abs(t)
    w = F.when(u < 1, F.pow(F.lit(1.0) - u * u * u, F.lit(3.0)))
    cut = cut.withColumns({"_t": t, "_w": w}).filter(F.col("_w").isNotNull())
    by_row = cut.select(*at, "x0", *[(F.col("_w") * F.col(c) * F.pow(F.col("_t"), F.lit(float(j)))).alias(f"_{n}{j}")
                                     for n, c, most in _MOMENTS for j in range(most)])
    blocks = _block_moments(obs, keys)
    by_block = join_back(placed.filter(whole), blocks, [*keys, "_b"]).select(*at, "x0", *_window_moments())
    sums = by_row.unionByName(by_block).groupBy(*at).agg(
        F.max("x0").alias("x"), *[F.sum(f"_{n}{j}").alias(f"_{n}{j}") for n, _, most in _MOMENTS for j in range(most)])
    m, v = [F.col(f"_m{j}") for j in range(5)], [F.col(f"_v{j}") for j in range(3)]
    full = [[m[0], m[1], m[2]], [m[1], m[2], m[3]], [m[2], m[3], m[4]]]
    rhs = [[v[0], m[1], m[2]], [v[1], m[2], m[3]], [v[2], m[3], m[4]]]
    det = _det3(full)
    solved = F.when(F.abs(det) > F.pow(m[0], F.lit(3.0)) * 1e-12, _det3(rhs) / det)
    return sums.select(*at, "x", F.coalesce(solved, F.try_divide(v[0], m[0])).alias("fit"))


#: Weighted moments of a window: of the counts, and of the sums of y, with how many powers each.
_MOMENTS = (("m", "_n", 5), ("v", "_sy", 3))
_DEGREE = 9  # of the weight


def _points_by_block(obs: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Every fit point of a panel with every block of it: bounds, rows, and the least and greatest distance."""
    blocks = obs.groupBy(*keys, "_b").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_n"))
    panel = blocks.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"), F.sum("_n").alias("_tot"))
    step = (F.col("_last") - F.col("_first")) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(
        i.alias("idx"), (F.col("_first") + step * i).alias("x0")))).alias("_g")
    pairs = join_back(blocks, panel, keys).select("*", grid).select(*keys, "_b", "_lo", "_hi", "_n", "_tot", "_g.idx", "_g.x0")
    low, high = F.col("_lo") - F.col("x0"), F.col("_hi") - F.col("x0")
    return pairs.withColumns({"_near": F.greatest(low, -high, F.lit(0.0)), "_far": F.greatest(F.abs(low), F.abs(high))})


def _rows_of(chosen: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """The observations of the chosen blocks, once for each point that asks; NULL keys match."""
    on = [*keys, "_b"]
    named = obs.withColumnsRenamed({k: f"_o_{k}" for k in on})
    cond = reduce(lambda p, q: p & q, [chosen[k].eqNullSafe(named[f"_o_{k}"]) for k in on])
    return chosen.join(named, cond).drop(*[f"_o_{k}" for k in on])


def _block_moments(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of each block about its middle, in units of half its width."""
    on = [*keys, "_b"]
    ends = obs.groupBy(*on).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    ends = ends.select(*on, ((F.col("_lo") + F.col("_hi")) / 2).alias("_c"), ((F.col("_hi") - F.col("_lo")) / 2).alias("_r"))
    z = F.coalesce(F.try_divide(F.col("_x") - F.col("_c"), F.col("_r")), F.lit(0.0))
    power = {k: F.pow(F.col("_z"), F.lit(float(k))) for k in range(_DEGREE + 5)}
    return join_back(obs, ends, on).withColumn("_z", z).groupBy(*on).agg(
        F.max("_c").alias("_c"), F.max("_r").alias("_r"),
        *[F.array(*[F.sum(F.col(c) * power[k]) for k in range(_DEGREE + most)]).alias(f"_{n}") for n, c, most in _MOMENTS])


def _window_moments() -> list[Column]:
    """Weighted moments about x0, in units of the bandwidth, of a block on one side of it.

    The block's powers are moved from its middle to x0 by the binomial theorem; the weight (1 - |t|^3)^3 is a polynomial
    whose odd powers have the sign of the side.
    """
    a, r = (F.col("_c") - F.col("x0")) / F.col("_h"), F.col("_r") / F.col("_h")
    side = F.when(F.col("_lo") >= F.col("x0"), F.lit(1.0)).otherwise(F.lit(-1.0))
    out = []
    for n, _, most in _MOMENTS:
        size = _DEGREE + most
        choose = F.array(*[F.lit(float(math.comb(k, i))) for k in range(size) for i in range(size)])
        sums = F.col(f"_{n}")

        def moved(k: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + F.element_at(choose, k * size + i + 1)
                               * F.pow(a, (k - i).cast("double")) * F.pow(r, i.cast("double")) * F.element_at(sums, i + 1))

        powers = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), moved)
        for j in range(most):
            p = [F.element_at(powers, j + 3 * k + 1) for k in range(4)]
            out.append((p[0] - 3.0 * side * p[1] + 3.0 * p[2] - side * p[3]).alias(f"_{n}{j}"))
    return out


def nth_smallest(counts: DataFrame, keys: Sequence[str], value: str, nth: Column) -> DataFrame:
    """Value holding the nth smallest row (1-based) given counts `n` per distinct value.

    `nth` may use the group's `_tot`.
    """
    placed = positions_of_counts(counts, keys, value)
    pos = nth - 1
    hit = (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
    return placed.filter(hit).groupBy(*keys).agg(F.max(value).alias("_kth"))
