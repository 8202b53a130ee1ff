"""Two-dimensional projection of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import stage


def pca_2d(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`(id, x, y)`: the embeddings projected on their first two principal axes.

    Only sums of the size of the covariance matrix leave the executors. The sign of an axis is
    chosen so that its largest loading is positive.
    """
    # Staged, as the fits and the result read it anew each.
    rows = stage(df.select(id_column, F.col(vector).cast("array<double>").alias("vector")), "projection-input")
    vectors = rows.select(id_column, array_to_vector("vector").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False)
    centred = scaler.fit(vectors).transform(vectors)
    model = PCA(k=2, inputCol="centred", outputCol="projected").fit(centred)
    axes = model.pc.toArray()
    largest = axes[np.abs(axes).argmax(axis=0), [0, 1]]
    point = vector_to_array("projected")
    x, y = (point[i] * float(np.sign(largest[i])) for i in (0, 1))
    return model.transform(centred).select(id_column, x.alias("x"), y.alias("y"))
