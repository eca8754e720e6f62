"""The panel: many ordered univariate series in one long DataFrame.

Schema (fixed names used throughout the library)::

    series_id string     the series key (one ticker, one user, ...)
    ts        timestamp  event time
    tiebreak  bigint     makes (ts, tiebreak) a total order inside a series
    value     double     the observed value

The reference works on one series per DataFrame and relies on physical row
order; here the order is explicit, so any source (Parquet, CSV, a table) can
be projected onto the panel with a plain ``select`` and the optimizer prunes
every other column at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "series_id"
TS = "ts"
TIEBREAK = "tiebreak"
VALUE = "value"
KEY = [SERIES]
ORDER = [TS, TIEBREAK]
PANEL_COLUMNS = [SERIES, TS, TIEBREAK, VALUE]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_panel(df: DataFrame, series=None, ts="ts", value="value", tiebreak=None) -> DataFrame:
    """Project ``df`` onto the panel schema.

    ``series`` / ``tiebreak`` may be None (one series named ``'all'``;
    tiebreak 0).  Arguments are column names or Columns.  A row without a
    timestamp has no place in its series and is left out (the filter is
    pushed to the scan).  ``ts`` has to be a date or a timestamp: text would
    sort as text.  Rows of a series that tie on (ts, tiebreak) have no defined
    order; :func:`ties` finds them.
    """
    sid = F.lit("all") if series is None else _col(series).cast("string")
    tb = F.lit(0).cast("bigint") if tiebreak is None else _col(tiebreak).cast("bigint")
    out = df.select(
        sid.alias(SERIES),
        _col(ts).alias(TS),
        tb.alias(TIEBREAK),
        _col(value).cast("double").alias(VALUE),
    )
    require_temporal(out.schema[TS].dataType, "ts")
    return out.where(F.col(TS).isNotNull())


def require_temporal(data_type, name: str) -> None:
    if data_type.typeName() not in ("date", "timestamp", "timestamp_ntz"):
        raise TypeError(f"{name} must be a date or timestamp, not {data_type.simpleString()}")


def ties(panel: DataFrame) -> DataFrame:
    """``(series_id, ts, tiebreak, rows)`` where more than one row has the same place in its series."""
    return panel.groupBy(SERIES, TS, TIEBREAK).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- panels over the driver's test tables ----------------------------------
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with one series per ``event_type`` (few, long series)."""
    ev = read_table(spark, sf_dir, "events")
    return as_panel(ev, series="event_type", ts="ts", value="value", tiebreak="event_id")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with one series per ``user_id`` (many short series)."""
    ev = read_table(spark, sf_dir, "events")
    return as_panel(ev, series="user_id", ts="ts", value="value", tiebreak="event_id")


def events_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one series: the long-series / hot-key case."""
    ev = read_table(spark, sf_dir, "events")
    return as_panel(ev, series=None, ts="ts", value="value", tiebreak="event_id")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value per priority.

    The sum runs in decimal(18,2) so that it is exact and independent of
    the order in which partial sums meet, then is cast to double.
    """
    o = read_table(spark, sf_dir, "orders")
    daily = o.groupBy("o_orderpriority", "o_orderdate").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v")
    )
    return as_panel(daily, series="o_orderpriority", ts="o_orderdate", value="v", tiebreak=None)


PANELS = {
    "events_by_type": events_by_type,
    "events_by_user": events_by_user,
    "events_single": events_single,
    "orders_daily": orders_daily,
}
