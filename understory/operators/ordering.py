"""Order statistics that hold when one group has a large share of all rows.

A window over a hot key sorts that key in a single task. Here equal values are
counted first (map-side), the distinct values are spread over buckets of about
equal numbers of values, bounded by a mergeable quantile sketch of each group,
and only bucket totals, at most BUCKETS per group, go through a per-group
running sum. The sketch shapes the buckets only; all results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 256  # a square number
SKETCH_ACCURACY = 5000
HASH_DIGITS = 3


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-group columns to the rows of the group; NULL keys match."""
    keys = list(keys)
    if not keys:  # a global aggregate has one row: read it as scalar subqueries, no join at all
        return df.select("*", *[stats.select(c).scalar().alias(c) for c in stats.columns])
    s = stats.withColumnsRenamed({k: f"_jb_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(s[f"_jb_{k}"]) for k in keys])
    return df.join(s, cond, "left").drop(*[f"_jb_{k}" for k in keys])


def zscore(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Standardize columns within groups; a constant or single-row group gives NULL."""
    aggs = [f(F.col(c)).alias(f"_{tag}_{c}") for c in cols
            for tag, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    out = join_back(df, df.groupBy(*keys).agg(*aggs), keys)
    return (out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}"))
                             for c in cols})
            .drop(*[f"_{t}_{c}" for c in cols for t in ("mean", "sd")]))


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with `n`, rows `before` (smaller) and group `total`.

    Two more columns count distinct values instead of rows: `d_before`, `d_total`.
    """
    keys = list(keys)
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return positions_of_counts(cnt, keys, value)


def positions_of_counts(cnt: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Positions for a frame that already holds one row per group and value, with its count `n`."""
    keys = list(keys)
    extra = [c for c in cnt.columns if c not in {*keys, value, "n"}]
    cells = even_buckets(cnt, keys, value, "_b")

    per_group = W.partitionBy(*(keys or [F.lit(0)]))
    running = per_group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = cells.groupBy(*keys, "_b").agg(F.sum("n").alias("_bn"), F.count(F.lit(1)).alias("_bd"))
    offsets = sizes.select(
        *keys, "_b",
        (F.sum("_bn").over(running) - F.col("_bn")).alias("_off"),
        (F.sum("_bd").over(running) - F.col("_bd")).alias("_doff"),
        F.sum("_bn").over(per_group).alias("total"),
        F.sum("_bd").over(per_group).alias("d_total"))
    local = (W.partitionBy(*keys, "_b").orderBy(value)
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = cells.withColumns({"_loc": F.sum("n").over(local) - F.col("n"),
                                "_dloc": F.count(F.lit(1)).over(local) - 1})
    out = join_back(placed, offsets, [*keys, "_b"])
    return out.select(*keys, value, *extra, "n", (F.col("_off") + F.col("_loc")).alias("before"), "total",
                      (F.col("_doff") + F.col("_dloc")).alias("d_before"), "d_total")


def even_buckets(values: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Number rows by which of BUCKETS value ranges they lie in; a group's ranges hold about equally many rows each.

    Ranges follow the order of values, and equal values share one. The place among a group's bounds is found in two
    steps, first among each sixteenth bound, then among those that follow it.
    """
    step = int(BUCKETS**0.5)
    probs = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, probs, SKETCH_ACCURACY).alias("_cut"))

    def smaller(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b < F.col(value)))

    every = F.transform(F.sequence(F.lit(step), F.lit(BUCKETS - 1), F.lit(step)), lambda k: F.element_at("_cut", k))
    found = join_back(values, cuts, keys).withColumn("_coarse", smaller(every))
    fine = smaller(F.slice("_cut", F.col("_coarse") * step + 1, F.lit(step - 1)))
    place = F.coalesce(F.col("_coarse") * step + fine, F.lit(0)).cast("int")
    return found.withColumn(out, place).drop("_cut", "_coarse")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Interpolated (type 7) quantiles per group, one output column per entry of `probs`."""
    return quantiles_of_counts(ordered_counts(df, keys, value), keys, value, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str,
                        probs: Mapping[str, float]) -> DataFrame:
    def at(pos: Column) -> Column:
        inside = (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, q in probs.items():
        h = (F.col("total") - 1) * F.lit(float(q))
        aggs += [at(F.floor(h)).alias(f"_l_{name}"), at(F.ceil(h)).alias(f"_u_{name}"),
                 F.max(h - F.floor(h)).alias(f"_w_{name}")]
    picked = counts.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[
        (F.col(f"_l_{p}") + F.col(f"_w_{p}") * (F.col(f"_u_{p}") - F.col(f"_l_{p}"))).alias(p)
        for p in probs])


def rank_average(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1-based rank; ties share the mean of their positions; NULL values get NULL."""
    ranks = ordered_counts(df, keys, value).select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return join_back(df, ranks, [*keys, value])


def dense_order(df: DataFrame, keys: Sequence[str], value: str, out: str,
                descending: bool = False) -> DataFrame:
    """1-based dense rank of `value` within the group."""
    pos = F.col("d_total") - F.col("d_before") if descending else F.col("d_before") + 1
    ranks = ordered_counts(df, keys, value).select(*keys, value, pos.cast("long").alias(out))
    return join_back(df, ranks, [*keys, value])


def top_k(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str = "rank") -> DataFrame:
    """Rows whose descending rank is at most k, ties kept.

    Catalyst turns the rank filter into a group limit before the shuffle, so
    each map task forwards only its own best k (plus ties) per group.
    """
    w = W.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(out, F.rank().over(w)).filter(F.col(out) <= k)


def hashed_positions(df: DataFrame, keys: Sequence[str], hashed: str, out: str,
                     total: str | None = None) -> DataFrame:
    """0-based position of each row in the order of a hex digest column.

    Digests are uniform, so their first digits are even buckets: rows are
    ranked inside a bucket and shifted by the bucket's offset. The running sum
    covers 16**HASH_DIGITS bucket totals, whatever the number of rows.
    """
    keys = list(keys)
    cells = df.withColumn("_b", F.substring(hashed, 1, HASH_DIGITS))
    per_group = W.partitionBy(*(keys or [F.lit(0)]))
    running = per_group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = cells.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    offsets = sizes.select(*keys, "_b", (F.sum("_bn").over(running) - F.col("_bn")).alias("_off"),
                           F.sum("_bn").over(per_group).alias("_tot"))
    placed = cells.withColumn(
        "_loc", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(hashed)) - 1)
    res = join_back(placed, offsets, [*keys, "_b"]).withColumn(out, F.col("_off") + F.col("_loc"))
    if total:
        res = res.withColumnRenamed("_tot", total)
    return res.drop("_b", "_off", "_loc", "_tot")
