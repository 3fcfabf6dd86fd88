"""Missing-value rules of the survey workflow, as column expressions.

Source rules: a comparison with a missing value is missing (not false), a
negated membership test keeps missing values, and plain means and sums are
missing as soon as one input is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_in(col: Column, values: Iterable) -> Column:
    """True unless the value is one of `values`; a missing value is kept."""
    return ~F.coalesce(col.isin(list(values)), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is NULL where the condition is NULL."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def present(col: Column) -> Column:
    """Neither NULL nor NaN."""
    return col.isNotNull() & ~F.isnan(col)


def mean_strict(col: Column) -> Column:
    """Mean that is NULL when any row of the group is NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def sum_strict(col: Column) -> Column:
    """Sum that is NULL when any row of the group is NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
