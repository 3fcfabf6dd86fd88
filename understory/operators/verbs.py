"""Frame verbs: column selection, whole-frame mutation, reshape, stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.functions.missing import not_in


def canonical_names(df: DataFrame) -> DataFrame:
    """Lower snake_case names without dots; refuses names that collide."""
    names = [c.strip().lower().replace(".", "_").replace(" ", "_") for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns collide after lower-casing: {clash}")
    return df.toDF(*names)


def matching_columns(df: DataFrame, prefix: str = "", not_suffix: str | None = None) -> list[str]:
    low = prefix.lower()
    return [c for c in df.columns if c.lower().startswith(low)
            and not (not_suffix and c.lower().endswith(not_suffix.lower()))]


def select_matching(df: DataFrame, keep: Sequence[str], prefix: str,
                    not_suffix: str | None = None) -> DataFrame:
    """`keep` plus the columns with a prefix and without a suffix, ignoring case."""
    found = [c for c in matching_columns(df, prefix, not_suffix) if c not in keep]
    return df.select(*keep, *found)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def map_numeric(df: DataFrame, fn: Callable[[Column], Column], exclude: Iterable[str] = ()) -> DataFrame:
    """Apply `fn` to every numeric column."""
    return map_columns(df, numeric_columns(df, exclude), fn)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def visited_years(calendar: DataFrame, site: str = "site_id") -> DataFrame:
    """Wide visit calendar to the set of (site, year), missing dates dropped."""
    dates = [c for c in calendar.columns if c != site]
    long = to_long(calendar, [site], dates, "visit", "monthyear")
    return (long.select(site, F.substring("monthyear", 1, 4).try_cast("int").alias("year"))
            .dropna().distinct())


def split_list(df: DataFrame, col: str, out: str, sep: str = ",\\s*") -> DataFrame:
    """One row per member of a separator-joined text set."""
    return df.withColumn(out, F.explode(F.split(F.col(col), sep))).drop(col)


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-bind by name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Row-bind with a constant column naming each part."""
    return stack_frames([df.withColumn(tag, F.lit(k)) for k, df in frames.items()])


def split_by_site(df: DataFrame, col: str, members: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Members and the rest; rows with a missing key belong to the rest."""
    members = list(members)
    return df.filter(F.col(col).isin(members)), df.filter(not_in(F.col(col), members))


def align_to_first_rep(df: DataFrame, keys: Sequence[str], rep: str, first, x: str) -> DataFrame:
    """Replace every repetition's x by the first repetition's x at the same key."""
    base = df.filter(F.col(rep) == first).select(*keys, F.col(x).alias("_x1"))
    return (df.join(base, list(keys), "left").withColumn(x, F.col("_x1")).drop("_x1"))
