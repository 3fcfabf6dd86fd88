"""Joins with the survey workflow's matching rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column name, where NULL matches NULL."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common columns to join by")
    return left_join(left, right, shared)


def left_join(left: DataFrame, right: DataFrame, by: Sequence[str],
              suffix: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join on named keys (NULL matches NULL); clashing columns get suffixes."""
    by = list(by)
    clash = [c for c in left.columns if c in right.columns and c not in by]
    left = left.withColumnsRenamed({c: c + suffix[0] for c in clash})
    r = right.withColumnsRenamed({c: c + suffix[1] for c in clash} | {c: f"_key_{c}" for c in by})
    cond = _all([left[c].eqNullSafe(r[f"_key_{c}"]) for c in by])
    return left.join(r, cond, "left").drop(*[f"_key_{c}" for c in by])


def right_join(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep every right row; key values come from the right under the left's names.

    Several right rows per key multiply the matching left rows.
    """
    lefts = left.withColumnsRenamed({lk: f"_key_{lk}" for lk, _ in by})
    r = right.withColumnsRenamed({rk: lk for lk, rk in by})
    cond = _all([lefts[f"_key_{lk}"].eqNullSafe(r[lk]) for lk, _ in by])
    out = lefts.join(r, cond, "right").drop(*[f"_key_{lk}" for lk, _ in by])
    keys = [lk for lk, _ in by]
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def member_of(df: DataFrame, members: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose key occurs in another frame; never multiplies rows."""
    m = members.select(*[F.col(b).alias(f"_m_{a}") for a, b in on])
    return df.join(m, _all([df[a] == m[f"_m_{a}"] for a, _ in on]), "left_semi")


def not_member_of(df: DataFrame, members: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose key does not occur in another frame."""
    m = members.select(*[F.col(b).alias(f"_m_{a}") for a, b in on])
    return df.join(m, _all([df[a] == m[f"_m_{a}"] for a, _ in on]), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by explicit sequence columns.

    An aggregate rather than a window, so each map task keeps one row per key
    and a hot key never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def size_gate(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of the groups that have more than `more_than` rows.

    Counts are combined map-side; joining them back lets AQE broadcast the key
    list or split a hot key, where a counting window would sort it in one task.
    """
    big = df.groupBy(key).count().filter(F.col("count") > more_than).select(key)
    return df.join(big, key, "left_semi")


def plot_coordinates(visits: DataFrame, centroids: DataFrame, fallback: DataFrame) -> DataFrame:
    """Coordinates per visit: the base-plot centroid if there is one, else the fallback.

    A plot with several base-plot rows yields several rows. `fallback` holds one
    row per plot with latitude, longitude, easting, northing.
    """
    cols = ["latitude", "longitude", "easting", "northing"]
    base = (centroids.filter(F.col("subtype") == "basePlot")
            .select("plot_id", *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_hit")))
    spare = fallback.select("plot_id", *[F.col(c).alias(f"_f_{c}") for c in cols])
    out = visits.join(base, "plot_id", "left").join(spare, "plot_id", "left")
    return out.select(*visits.columns, *[
        F.when(F.col("_hit"), F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in cols])
