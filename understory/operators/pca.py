"""Principal components of standardized columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, cols: Sequence[str], k: int = 2, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores (keys, pc1..pck) of complete rows and loadings (var, pc1..pck).

    Columns are centered and scaled by their sample sd. Axis signs are free, so
    each axis is turned to make its largest loading positive. Keys travel with
    the scores; nothing is bound by position.
    """
    cols = list(cols)
    rows = df.select(*keys, *cols).dropna()
    stages = [VectorAssembler(inputCols=cols, outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True)]
    z = rows
    for s in stages:
        z = s.fit(z).transform(z) if hasattr(s, "fit") else s.transform(z)
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(z)
    load = model.pc.toArray()  # columns x k, fixed by the predictor list
    sign = np.where(load[np.abs(load).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    pc = vector_to_array("_pc")
    scores = model.transform(z).select(*keys, *[(pc[j] * float(sign[j])).alias(f"pc{j + 1}") for j in range(k)])
    table = [(c, *[float(x) for x in load[r] * sign]) for r, c in enumerate(cols)]
    schema = "var string, " + ", ".join(f"pc{j + 1} double" for j in range(k))
    return scores, df.sparkSession.createDataFrame(table, schema)
