"""Vector rows that can be compared, and their packed blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding as array of double) of rows with an id and finite components only.

    Vectors with a null, NaN or infinite component, empty ones and, unless ``zero``, zero ones are
    left out, and so are vectors that are not as long as most are (of two such lengths the smaller
    one counts). Rows with one vec_id count as one, with the smallest vector.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select("vec_id", vector.alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0").where(finite)
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column) -> np.ndarray:
    """The vectors of a pandas column or an Arrow list column as one array."""
    if hasattr(column, "flatten"):
        return np.asarray(column.flatten()).reshape(len(column), -1)
    return np.array(list(column), np.float64)
