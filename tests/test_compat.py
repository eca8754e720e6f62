"""The original call shapes on one-series DataFrames with a Date column."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast import compat
from panelcast.session import fresh_path

Y = [10, 12, 12, 9, 15, 20, 18, 21, 25, 24]


@pytest.fixture(scope="module")
def stock(spark):
    base = dt.date(2018, 1, 1)
    rows = [(base + dt.timedelta(days=t), float(y), 1.0) for t, y in enumerate(Y)]
    return spark.createDataFrame(list(reversed(rows)), "Date date, Close double, Open double")


def test_difference_and_generators(stock):
    d = compat.Difference(stock, "Close", "Diff_Close").orderBy("Date")
    assert [r["Diff_Close"] for r in d.collect()] == [0, 2, 0, -3, 6, 5, -2, 3, 4, -1]
    lg = compat.LagGather().setLagLength(2).setInputCol("Close")
    out = lg.transform(stock).orderBy("Date").collect()
    assert [r["Close_LagBy_2"] for r in out] == [None, None] + Y[:-2]
    assert lg.getFeatureNames() == ["Close_LagBy_1", "Close_LagBy_2"]
    ma = compat.MovingAverageSmoothing().setLagLength(1).setInputCol("Close").transform(stock)
    assert "Close_1_MovingAvg" in ma.columns and "Date" in ma.columns
    tg = compat.TrendGather().setLagLength(1).setInputCol("Close").transform(stock).orderBy("Date")
    assert [r["Close_Lag_1_Sign"] for r in tg.collect()] == [None, 1, 0, -1, 1, 1, -1, 1, 1, -1]


def test_time_series_split(stock):
    train, test = compat.TimeSeriesSplit(stock, 0.7)
    assert train.count() == 8 and test.count() == 2
    assert sorted(r["Row Number"] for r in test.collect()) == [8, 9]


def test_forecast_one_horizon(spark):
    from panelcast.sources.panel import read_table

    ev = read_table(spark, SF_SMALL, "events").where("event_type = 'click'").select(
        F.col("ts").alias("Date"), F.col("value").alias("Close"))
    diff = compat.Difference(ev, "Close", "Diff_Close")
    test, train, p_test, p_train, m_test, m_train = compat.Forecast(
        diff.select("Date", "Close", "Diff_Close"), 2, 2, "Diff_Close", "LinearRegression")
    n = ev.count()
    assert train.count() + test.count() == n - 2  # the first 2 rows have missing lags
    assert {"Date", "Row Number", "Diff_Close", "Diff_Close_LagBy_1", "label", "prediction"} <= set(p_train.columns)
    assert -1.0 <= m_train <= 1.0 and m_test <= 1.0  # R^2 for the linear model


def test_predict_chains_horizons(stock):
    train, _ = compat.TimeSeriesSplit(stock, 0.7)
    preds = train.select("Row Number", F.lit(1.0).alias("prediction"))
    one = compat.Predict(1, train.select("Row Number", "Date", "Close"), preds, "Close", "prediction", "Row Number")
    two = compat.Predict(2, one, preds, "forecast_1day", "prediction", "Row Number")
    rows = two.orderBy("Date").collect()
    assert all(r["forecast_2day"] == r["Close"] + 2.0 and r["DeltaZ1"] == 1.0 for r in rows)
    assert len(rows) == 8


def test_save_predictions_and_stationarity(spark):
    from panelcast.sources.panel import read_table

    ev = read_table(spark, SF_SMALL, "events").where("event_type = 'view'").select(
        F.col("ts").alias("Date"), F.col("value").alias("Close"))
    name = fresh_path(spark, "compat") + "/LR_view_"
    m_train, m_test = compat.SavePredictions(ev, "Close", "RandomForestRegression", 3, 2, name)
    assert sorted(m_test) == ["forecast_1day", "forecast_2day", "forecast_3day"] and all(v > 0 for v in m_test.values())
    back = spark.read.option("header", "true").csv(name + "test.csv")
    assert back.columns == ["Row Number", "Date", "Close", *[c for h in (1, 2, 3) for c in (f"DeltaZ{h}", f"forecast_{h}day", f"actual_{h}day")]]
    st = compat.CheckStationarity(ev, "Close")
    assert st["p_value"] < 0.05 and st["n"] > 0
