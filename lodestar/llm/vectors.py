"""What the vector searches share: which vectors take part, and packing of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """key (long) and v (array<double>) of the vectors that take part: neither key nor vector null,
    not empty, no component null or non-finite and, unless ``zero``, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0) & fine)
    return df if zero else df.where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
