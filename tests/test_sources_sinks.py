"""CSV source, prediction / metric sinks and the legacy CSV layout."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast import ForecastConfig, forecast_panel
from panelcast.plans.report import read_predictions, write_legacy_csv
from panelcast.session import fresh_path
from panelcast.sources.files import read_csv_series
from panelcast.sources.panel import events_by_type


def test_csv_one_file_per_ticker(spark):
    d = tempfile.mkdtemp(prefix="pc-csv-")
    for name, rows in {"apple": [("01/03/2018", 10.0), ("01/02/2018", 9.5)], "fb": [("01/02/2018", 3.0)]}.items():
        with open(os.path.join(d, f"{name}.csv"), "w") as fh:
            fh.write("Date,Open,Close\n")
            for dt, v in rows:
                fh.write(f"{dt},0,{v}\n")
    p = read_csv_series(spark, d, date_format="MM/dd/yyyy", series_from_file=True)
    rows = p.orderBy("series_id", "ts").collect()
    assert [(r["series_id"], r["ts"].day, r["value"]) for r in rows] == [("apple", 2, 9.5), ("apple", 3, 10.0), ("fb", 2, 3.0)]
    assert dict(p.dtypes)["ts"] == "timestamp_ntz"


def test_forecast_write_and_read_back(spark):
    r = forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=2, lags=1))
    path = fresh_path(spark, "test-out")
    r.write(path)
    back = read_predictions(spark, f"{path}/predictions")
    assert back.count() == r.predictions.count()
    assert {x[0] for x in back.select("split").distinct().collect()} == {"train", "test"}
    m = spark.read.parquet(f"{path}/metrics")
    assert m.count() == r.metrics.count() == 5 * 2 * 2
    try:
        r.write(path)
        raise AssertionError("default mode must refuse to overwrite")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)


def test_legacy_csv_layout(spark):
    r = forecast_panel(events_by_type(spark, SF_SMALL).where(F.col("series_id") == "click"),
                       ForecastConfig(horizons=2, lags=1))
    base = fresh_path(spark, "legacy") + "/LR_Click"
    write_legacy_csv(r.predictions, base)
    train = spark.read.option("header", "true").csv(base + "train.csv")
    test = spark.read.option("header", "true").csv(base + "test.csv")
    assert train.columns == test.columns == ["Row Number", "Date", "Close", "DeltaZ1", "forecast_1day", "actual_1day",
                                             "DeltaZ2", "forecast_2day", "actual_2day"]
    assert train.count() + test.count() == r.predictions.count()


def test_legacy_metric_tables(spark):
    from panelcast.plans.report import write_legacy_metric_tables

    r = forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=3, lags=1))
    prefix = fresh_path(spark, "legacy-metrics") + "/"
    write_legacy_metric_tables(r.metrics, "LinearRegression", prefix, range(1, 4))
    t = spark.read.option("header", "true").option("inferSchema", "true").csv(prefix + "RMSE_test_LinearRegression.csv")
    assert t.columns == ["Ticker", "forecast_1day", "forecast_2day", "forecast_3day"]
    assert t.count() == 5
    want = {r_["series_id"]: r_["r2"] for r_ in r.metrics.where("split = 'test' and horizon = 2").collect()}
    got = {x["Ticker"]: x["forecast_2day"] for x in t.collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_only_dates_and_timestamps_order_a_series(spark):
    import pytest

    from panelcast.sources.panel import as_panel, ties

    text = spark.createDataFrame([("01/02/2024", 1.0), ("12/31/2023", 2.0)], "ts string, value double")
    with pytest.raises(TypeError):
        as_panel(text)
    p = as_panel(text.select(F.to_date("ts", "MM/dd/yyyy").alias("ts"), "value"))
    assert ties(p).count() == 0 and ties(p.unionByName(p)).count() == 2


def test_chart_has_each_columns_ends_and_extremes(spark):
    from collections import defaultdict

    from panelcast.plans.report import forecast_chart, forecast_long

    pred = forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=2, lags=0)).predictions
    pred = pred.withColumn("series_id", F.when(F.col("series_id") != "view", F.col("series_id")))
    got = {(r.series_id, r.split, r.horizon, r.kind, r.pixel): r for r in forecast_chart(pred, [1, 2], pixels=7).collect()}
    spans = {r.series_id: (r.a, r.z) for r in pred.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).collect()}
    lines = defaultdict(list)
    micro = lambda t: t.days * 86_400_000_000 + t.seconds * 1_000_000 + t.microseconds
    for r in forecast_long(pred, [1, 2]).collect():
        if r.value is not None:
            a, z = spans[r.series_id]
            lines[r.series_id, r.split, r.horizon, r.kind, micro(r.ts - a) * 7 // (micro(z - a) + 1)].append((r.ts, r.tiebreak, r.value))
    assert got.keys() == lines.keys() and len(got) <= 6 * 2 * 2 * 2 * 8
    for k, points in lines.items():
        points.sort()
        values = [p[2] for p in points]
        r = got[k]
        assert (r.points, r.first_ts, r.first, r.last_ts, r["last"], r.low, r.high) == (
            len(points), points[0][0], values[0], points[-1][0], values[-1], min(values), max(values))
    assert {k[4] for k in got} == set(range(7))
