"""Call shapes of the original workload, for one series per DataFrame.

Users of the original scripts call ``SavePredictions``, ``Forecast``,
``Predict``, ``Difference``, ``TimeSeriesSplit``, ``CheckStationarity`` and the
``LagGather`` / ``MovingAverageSmoothing`` / ``TrendGather`` generators on a
DataFrame holding one series with a ``Date`` column.  The same calls work
here.  Each turns the DataFrame into a one-key panel ordered by the date
column and runs the panel operators, so the semantics are those in the
README: explicit date order (not file order), rows matched by key, and the
metric each regressor reported (R² for the linear and single-tree models,
RMSE for forest and boosting), now under its own name.

For many series, call :func:`panelcast.forecast_panel` on one panel instead
of calling these once per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.features import LagFeatures, MovingAverage, TrendSign
from panelcast.operators.stationarity import adf_autolag
from panelcast.operators.split import time_split
from panelcast.plans.forecast import ForecastConfig, forecast_horizon, forecast_panel
from panelcast.plans.report import LEGACY_METRIC, write_legacy_csv
from panelcast.sources.panel import SERIES, TIEBREAK, TS, VALUE, require_temporal


def _single_panel(df: DataFrame, date_col: str) -> DataFrame:
    """Add the panel key (one series, ordered by ``date_col``) to ``df``."""
    require_temporal(df.schema[date_col].dataType, date_col)
    others = [c for c in df.columns if c not in (date_col, SERIES, TS, TIEBREAK)]
    return df.where(F.col(date_col).isNotNull()).select(
        F.lit("all").alias(SERIES), F.col(date_col).alias(TS), F.lit(0).cast("bigint").alias(TIEBREAK), *others
    )


def _back(df: DataFrame, date_col: str) -> DataFrame:
    return df.drop(SERIES, TIEBREAK).withColumnRenamed(TS, date_col)


def Difference(df: DataFrame, inputCol: str, outputCol: str, date_col: str = "Date") -> DataFrame:  # noqa: N802
    """``outputCol = inputCol - previous inputCol`` (0 on the first date)."""
    from panelcast.operators.features import Differencer

    out = Differencer(inputCol=inputCol, outputCol=outputCol).transform(_single_panel(df, date_col))
    return _back(out, date_col)


def TimeSeriesSplit(df_m: DataFrame, splitRatio: float, sparksession=None, date_col: str = "Date"):  # noqa: N802
    """``(train, test)``: first ``int(N * splitRatio) + 1`` dates train; ``Row Number`` from 0."""
    x = time_split(_single_panel(df_m, date_col), splitRatio).withColumnRenamed("row_number", "Row Number")
    x = _back(x, date_col)
    train = x.where(F.col("split") == "train").drop("split", "n_rows")
    test = x.where(F.col("split") == "test").drop("split", "n_rows")
    return train, test


def _metric(metrics: DataFrame, regressor: str) -> dict[str, float | None]:
    """The regressor's reported metric per split, from one run (two rows)."""
    return {r["split"]: r[1] for r in metrics.select("split", LEGACY_METRIC[regressor]).collect()}


def Forecast(df: DataFrame, forecast_days: int, nLags: int, timeSeriesColumn: str, regressor: str,  # noqa: N802
             sparksession=None, date_col: str = "Date"):
    """One horizon on an already-prepared column (no further differencing).

    Features: the column and its ``nLags`` lags; label: the column
    ``forecast_days`` rows ahead, clamped at the end.  Returns
    ``(test, train, predictions_test, predictions_train, metric_test,
    metric_train)``.
    """
    panel = _single_panel(df.select(date_col, timeSeriesColumn), date_col).withColumnRenamed(timeSeriesColumn, VALUE)
    cfg = ForecastConfig(horizons=forecast_days, lags=nLags, regressor=regressor, difference=False)
    rows, metrics = forecast_horizon(panel, forecast_days, cfg)
    rows = _back(rows.withColumnRenamed("row_number", "Row Number").withColumnRenamed(VALUE, timeSeriesColumn)
                 .drop("diff"), date_col)
    rows = rows.select(*[F.col(c).alias(f"{timeSeriesColumn}_LagBy_{c.split('_')[1]}") if c.startswith("lag_")
                         else F.col(c) for c in rows.columns])
    train = rows.where(F.col("split") == "train").drop("split")
    test = rows.where(F.col("split") == "test").drop("split")
    inputs = [c for c in rows.columns if c not in ("prediction", "split")]
    metric = _metric(metrics, regressor)
    return test.select(*inputs), train.select(*inputs), test, train, metric.get("test"), metric.get("train")


def Predict(i: int, df1: DataFrame, df2: DataFrame, timeSeriesCol: str, predictionCol: str,  # noqa: N802
            joinCol: str) -> DataFrame:
    """Undifference one horizon: ``forecast_<i>day = <timeSeriesCol> + prediction``.

    ``df1`` holds the level (or the previous horizon's forecast), ``df2`` the
    predicted change; rows are matched on ``joinCol`` (a key, e.g. the row
    number or the date).  The prediction is kept as ``DeltaZ<i>``.  No global
    sort: writers order rows inside their files.
    """
    from panelcast.functions.series import delta_name, forecast_name

    joined = df1.join(df2.withColumnRenamed(predictionCol, delta_name(i)), joinCol, "inner")
    return joined.withColumn(forecast_name(i), F.col(delta_name(i)) + F.col(timeSeriesCol))


def SavePredictions(df: DataFrame, timeSeriesCol: str, regressionType: str, forecast_days: int,  # noqa: N802
                    feature_nLags: int, filename: str, sparksession=None, date_col: str = "Date",
                    mode: str = "errorifexists"):
    """Difference, forecast horizons 1..H, write ``<filename>train.csv`` / ``<filename>test.csv``.

    Returns ``(metrics_train, metrics_test)`` as ``{'forecast_<i>day': value}``
    with the regressor's reported metric.
    """
    panel = _single_panel(df.select(date_col, timeSeriesCol), date_col).withColumnRenamed(timeSeriesCol, VALUE)
    result = forecast_panel(panel, ForecastConfig(horizons=forecast_days, lags=feature_nLags,
                                                  regressor=regressionType))
    metric = LEGACY_METRIC[regressionType]
    out = {"train": {}, "test": {}}
    with result.computed() as (predictions, metrics):
        write_legacy_csv(predictions, filename, value_name=timeSeriesCol, ts_name=date_col, mode=mode)
        for r in metrics.select("split", "horizon", metric).collect():  # 2 x H rows
            out[r["split"]][f"forecast_{r['horizon']}day"] = r[metric]
    return out["train"], out["test"]


def CheckStationarity(df: DataFrame, timeSeriesCol: str, date_col: str = "Date") -> dict:  # noqa: N802
    """Augmented Dickey-Fuller (constant, lag order by AIC) of one series, as a dict."""
    panel = _single_panel(df.select(date_col, timeSeriesCol), date_col).withColumnRenamed(timeSeriesCol, VALUE)
    row = adf_autolag(panel).first()
    return {} if row is None else {k: row[k] for k in row.asDict() if k != SERIES}


class _OneSeries:
    """Mixin: the input DataFrame is one series ordered by ``date_col``."""

    def __init__(self, date_col: str = "Date"):
        super().__init__()
        self._date_col = date_col

    def _transform(self, df: DataFrame) -> DataFrame:
        return _back(super()._transform(_single_panel(df, self._date_col)), self._date_col)


class LagGather(_OneSeries, LagFeatures):
    """``<col>_LagBy_<i>`` for i = 1..n."""


class MovingAverageSmoothing(_OneSeries, MovingAverage):
    """``<col>_<n>_MovingAvg`` over the current and n previous dates."""


class TrendGather(_OneSeries, TrendSign):
    """``<col>_Lag_<i>_Sign`` for i = 1..n."""
