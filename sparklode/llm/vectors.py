"""Vectors in Arrow batches, shared by the operators over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, finite: bool = True) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows with an id and a vector of the table's most frequent length (the shorter of equals) without
    nulls or NaN or infinite values, and that length (0 if there is none)."""
    v = F.col("embedding").cast("array<float>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    best = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = best["d"] if best else 0
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("v") == d) & good), d


def matrix(arr: pa.Array, d: int) -> np.ndarray:
    return np.asarray(arr.flatten(), np.float32).reshape(len(arr), d)
