"""Vector tables for the search operators: usable rows, packed blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """True for a vector without null, NaN or infinite components (false, not null, for a null vector)."""
    limit = F.lit(1.7976931348623157e308)
    return v.isNotNull() & F.coalesce(
        F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= limit), F.lit(False))), F.lit(False))


def usable(vectors: DataFrame, id_col: str, vector_col: str, *, zero: bool) -> DataFrame:
    """(id, v): one row per id with a finite vector as doubles; of several vectors of an id the smallest counts.

    ``zero=False`` also leaves out vectors without a component other than 0.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    keep = F.col("id").isNotNull() & finite(F.col("v"))
    if not zero:
        keep = keep & F.exists("v", lambda x: x != 0)
    return rows.where(keep).groupBy("id").agg(F.min("v").alias("v"))


def matrix(batch_column, dim: int) -> np.ndarray:
    """A list<double> Arrow column as an array of ``dim`` columns; missing components are 0."""
    offsets = np.asarray(batch_column.offsets)
    flat = np.asarray(batch_column.values)
    n = np.diff(offsets)
    out = np.zeros((len(n), dim))
    if len(n) and dim:
        at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n)
        out[np.repeat(np.arange(len(n)), n), at] = flat[offsets[0]:offsets[-1]]
    return out


def block_schema(*extra: str) -> str:
    return ", ".join([*extra, "n int, ids binary, vecs binary"])
