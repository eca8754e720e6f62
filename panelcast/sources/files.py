"""File sources in the reference's input layout (CSV with a header).

The reference reads one CSV per ticker with ``inferSchema``, which costs an
extra pass over the file and silently turns ``MM/dd/yyyy`` dates into
strings (then the time order becomes lexicographic).  Here the columns are
read as strings and parsed with an explicit format in one projection, so
there is no inference job and a bad date is an error (ANSI mode), not a
wrong order.  Many files become one panel: the series key is taken from a
column, or from each file's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.panel import as_panel


def read_csv_series(spark: SparkSession, path: str, ts_col: str = "Date", value_col: str = "Close",
                    date_format: str = "yyyy-MM-dd", series_col: str | None = None,
                    series_from_file: bool = False, tiebreak_col: str | None = None) -> DataFrame:
    """CSV file(s) -> panel ``(series_id, ts, tiebreak, value)``.

    ``path`` may be a file, a folder or a glob.  ``series_from_file`` names
    each series after its file (``apple.csv`` -> ``apple``); otherwise
    ``series_col`` or a single series ``'all'``.
    """
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    ts = F.to_timestamp_ntz(F.col(ts_col), F.lit(date_format))
    if series_from_file:
        series = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    else:
        series = series_col
    return as_panel(raw, series=series, ts=ts, value=F.col(value_col).cast("double"), tiebreak=tiebreak_col)


def write_csv_series(panel: DataFrame, path: str, ts_name: str = "Date", value_name: str = "Close",
                     date_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS", mode: str = "errorifexists") -> None:
    """Panel -> CSV with a header (``series_id``, ``Date``, ``tiebreak``, ``Close``)."""
    (
        panel.select(
            "series_id",
            F.date_format("ts", date_format).alias(ts_name),
            "tiebreak",
            F.col("value").alias(value_name),
        )
        .write.mode(mode)
        .option("header", "true")
        .csv(path)
    )
