"""Level orders for categorical variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_levels(df: DataFrame, level: str, x: str, y: str | Column, out: str) -> DataFrame:
    """Order levels by descending y taken at each level's largest x, ties by name.

    One row per level reaches the final window: the set of levels is the
    predictor list, not the data.
    """
    y = F.col(y) if isinstance(y, str) else y
    last = df.groupBy(level).agg(F.max_by(y, F.col(x)).alias("_y"))
    w = W.partitionBy(F.lit(0)).orderBy(F.col("_y").desc_nulls_last(), F.col(level))
    return last.select(level, F.row_number().over(w).alias(out))
