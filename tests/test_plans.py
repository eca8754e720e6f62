"""Physical-plan properties that matter at scale (checked with explain)."""
import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast import ForecastConfig, forecast_panel
from panelcast.plans import catalog
from panelcast.plans.forecast import build_features
from panelcast.sources.panel import events_by_type, events_single


def _explain(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _final_plan(df):
    """The adaptive plan after it ran (collect runs this DataFrame's own QueryExecution)."""
    qe = df._jdf.queryExecution()
    df.collect()
    plan = qe.executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan.split("== Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark):
    p = events_by_type(spark, SF_SMALL).where(F.col("series_id") == "click")
    f, _, _ = build_features(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=None))
    plan = _explain(f)
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters:"))
    assert "EqualTo(event_type,click)" in pushed and "IsNotNull(ts)" in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_forecast_scans_and_shuffles_the_panel_once(spark):
    r = forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=3, lags=2, hot_series_rows=None))
    plan = _final_plan(r.predictions)
    assert plan.count("FileScan parquet") == 1
    assert "ReusedExchange" in plan
    # no row-at-a-time or scalar Python UDF; Python only runs on the per-series statistics
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("MapInPandas") == 1


def test_top_k_limits_before_the_shuffle(spark):
    plan = _explain(catalog.preview_first_k(spark, SF_SMALL), "simple")
    partial = plan.index("WindowGroupLimit")
    assert "Partial" in plan[partial:] and plan.index("Exchange") < plan.rindex("Partial")


def test_blocked_windows_partition_by_block(spark):
    f, _, _ = build_features(events_single(spark, SF_SMALL),
                             ForecastConfig(horizons=2, lags=1, hot_series_rows=0, block_rows=100,
                                            rows_per_partition=150))
    plan = _explain(f, "simple")
    assert "Exchange hashpartitioning(series_id" in plan and "_blk" in plan
    assert "Exchange SinglePartition" not in plan


def test_a_computed_forecast_is_read_from_one_written_table(spark):
    r = forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=2, lags=1, hot_series_rows=None))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with r.computed() as (predictions, metrics):
        for df in (predictions, metrics):
            plan = _explain(df, "simple")
            assert plan.count("FileScan") == 1 and "events" not in plan
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_one_look_for_hot_series_per_chain(spark):
    from panelcast.operators import ordered
    from panelcast.operators.features import Differencer, LagFeatures

    p = events_by_type(spark, SF_SMALL)
    heat = ordered.Heat.of(p, 5_000_000)
    out = LagFeatures(inputCol="d", lagLength=2).setHeat(heat).transform(Differencer(inputCol="value", outputCol="d").setHeat(heat).transform(p))
    assert _explain(out, "simple").count("FileScan") == 1


def test_hot_protection_for_other_key_and_order_columns(spark):
    from panelcast.operators.features import LagFeatures
    from panelcast.operators.split import row_index, time_split

    p = events_by_type(spark, SF_SMALL).withColumnsRenamed({"series_id": "kind", "ts": "at", "tiebreak": "no"}).withColumn("ts", F.lit("text"))
    kw = dict(inputCol="value", lagLength=2, seriesCol="kind", orderCols=["at", "no"])
    cols = ["kind", "at", "no", "value", "ts", "value_LagBy_1", "value_LagBy_2"]
    hot = LagFeatures(hotSeriesRows=0, blockRows=40, **kw).transform(p)
    assert hot.columns == cols and "_blk" in _explain(hot, "simple")
    assert hot.exceptAll(LagFeatures(hotSeriesRows=-1, **kw).transform(p)).count() == 0
    for op in (row_index, time_split):
        a = op(p, key=("kind",), order=("at", "no"), hot_series_rows=0, rows_per_partition=60)
        b = op(p, key=("kind",), order=("at", "no"), hot_series_rows=None)
        assert sorted(a.columns) == sorted(b.columns) and a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == p.count()


def test_hot_series_join_coefficients_per_block(spark):
    import re

    p = events_by_type(spark, SF_SMALL).unionByName(events_single(spark, SF_SMALL))
    r = forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=500, block_rows=64,
                                         rows_per_partition=200))
    plan = re.sub(r"#\d+L?", "", _explain(r.predictions, "simple"))
    # the hot piece meets its coefficients on (series_id, _blk), the key it is already partitioned by
    assert re.search(r"Join \[series_id, _blk\], \[series_id, _blk\], LeftOuter", plan)


def test_chart_points_are_not_sorted(spark):
    """First and last come by one number for time and tiebreak, so that the aggregate holds its groups and not its rows."""
    from panelcast.plans.report import forecast_chart

    pred = spark.createDataFrame(forecast_panel(events_by_type(spark, SF_SMALL), ForecastConfig(horizons=2, lags=0)).predictions.toArrow())
    chart, by_time = forecast_chart(pred, [1, 2], pixels=7), forecast_chart(pred.withColumn("tiebreak", F.struct("tiebreak")), [1, 2], pixels=7)
    assert "SortAggregate" not in chart._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, chart.collect()), key=str) == sorted(map(tuple, by_time.collect()), key=str)
