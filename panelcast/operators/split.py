"""Complete-case filter, row index and the time-ordered train/test split.

The reference numbers rows with an RDD ``zipWithIndex`` round trip and a
separate ``count()`` job; here both are window functions over the same
per-series partitioning as the features, so the split costs no extra
shuffle and no action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.series import all_present
from panelcast.operators import ordered
from panelcast.sources.panel import ORDER, SERIES


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null and no NaN in ``cols`` (all columns by default), as ``dropna`` does."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cond = all_present([c for c in cols if c in numeric])
    for c in cols:
        if c not in numeric:
            cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def _indexed_parts(df: DataFrame, hot_series_rows, rows_per_partition):
    """``[(part, blocked)]`` per heat class; blocked parts carry ``row_number`` and an encoded key."""
    out = []
    for part, blocked, rows in ordered.split_by_heat(df, hot_series_rows):
        if blocked:
            part = ordered.index_rows(ordered.encode_key(part), rows, rows_per_partition).withColumnRenamed(ordered.IDX, "row_number")
        out.append((part, blocked))
    return out


def row_index(df: DataFrame, key=(SERIES,), order=ORDER, name: str = "row_number",
              hot_series_rows: int | ordered.Heat | None = 5_000_000, rows_per_partition: int = 2_000_000) -> DataFrame:
    """0-based position of each row inside its series (bigint).

    Hot series (more than ``hot_series_rows`` rows) are numbered through
    range partitions and per-partition offsets, never in one task.  A null
    key is a series of its own.
    """
    x, back = ordered.to_layout(df, key, order)
    w = ordered.series_window()
    outs = []
    for part, blocked in _indexed_parts(x, hot_series_rows, rows_per_partition):
        if blocked:
            outs.append(ordered.decode_key(part, x.schema[SERIES].dataType))
        else:
            outs.append(part.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("row_number")))
    return back(_union(outs)).withColumnRenamed("row_number", name)


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def time_split(df: DataFrame, ratio: float = 0.7, key=(SERIES,), order=ORDER,
               hot_series_rows: int | ordered.Heat | None = 5_000_000, rows_per_partition: int = 2_000_000) -> DataFrame:
    """Add ``row_number``, ``n_rows`` and ``split``.

    With ``k = floor(n_rows * ratio)`` (double arithmetic, as ``int(N*0.7)``),
    rows ``0..k`` are ``train`` (k+1 rows) and the rest ``test``.  Hot series
    get their row numbers from :func:`ordered.index_rows` and their size from
    a partial aggregate joined back on the hot keys.
    """
    x, back = ordered.to_layout(df, key, order)
    w, whole = ordered.series_window(), Window.partitionBy(SERIES)
    outs = []
    for part, blocked in _indexed_parts(x, hot_series_rows, rows_per_partition):
        if blocked:
            sizes = part.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"))
            outs.append(ordered.decode_key(part.join(sizes, SERIES), x.schema[SERIES].dataType))
        else:
            outs.append(part.select(
                "*",
                (F.row_number().over(w) - 1).cast("bigint").alias("row_number"),
                F.count(F.lit(1)).over(whole).alias("n_rows"),
            ))
    k = F.floor(F.col("n_rows") * F.lit(float(ratio)))
    out = back(_union(outs))
    return out.withColumn("split", F.when(F.col("row_number") <= k, F.lit("train")).otherwise(F.lit("test")))


def undifference_long(df: DataFrame, base: str, delta: str, horizon: str = "horizon",
                      key=(SERIES,) + tuple(ORDER), name: str = "forecast") -> DataFrame:
    """Long-form undifferencing: ``base + cumulative sum of delta over horizons``.

    For predictions stored one row per (row key, horizon).  The window is
    partitioned by the row key, so each group holds only H rows.
    """
    w = Window.partitionBy(*key).orderBy(horizon).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", (F.col(base) + F.sum(delta).over(w)).alias(name))
