"""Registered queries: one per operator of the survey's inventory.

Each query takes ``(spark, sf_dir)``, reads the driver's tables and returns
a DataFrame.  Floating results that come out of aggregation or model
fitting are rounded to 6 decimals so that the DuckDB oracle (which sums in
another order) compares equal; inputs and exact differences are not
rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.series import delta_name, forecast_name
from panelcast.operators import ordered
from panelcast.operators.features import Differencer, LagFeatures, LeadLabel, MovingAverage, TrendSign
from panelcast.operators.metrics import metric_table
from panelcast.operators.split import complete_cases, row_index, time_split, undifference_long
from panelcast.operators.stationarity import adf_autolag, adf_test, dickey_fuller
from panelcast.operators.trees import DECISION_TREE, GBT, LINEAR, RANDOM_FOREST
from panelcast.plans.forecast import ForecastConfig, Generator, feature_vectors, forecast_horizon, forecast_panel, register_generator
from panelcast.plans.report import forecast_chart, forecast_long, read_predictions, write_predictions
from panelcast.sources import panel as P
from panelcast.sources.panel import SERIES, TIEBREAK, TS, VALUE

H = 5  # horizons in the registered forecasts (reference workloads: 5)
LAGS = 3  # lags in the registered feature queries (reference workloads: 3)
HOT_ROWS = 5_000_000  # a longer series takes the blocked path
R = 6  # decimals kept for aggregated / fitted values


def _round(df: DataFrame, cols, digits: int = R) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _pred_cols(hs):
    return [delta_name(h) for h in hs] + [forecast_name(h) for h in hs]


# --- sources, projections ----------------------------------------------------
def scan_panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.events_by_type(spark, sf)


def scan_orders_daily(spark, sf):
    return P.orders_daily(spark, sf)


def scan_csv(spark, sf):
    """CSV source: the panel written as header CSV, read back with an explicit date format."""
    from panelcast.session import fresh_path
    from panelcast.sources.files import read_csv_series, write_csv_series

    path = fresh_path(spark, "csv")
    write_csv_series(P.events_by_type(spark, sf), path)
    return read_csv_series(spark, path, date_format="yyyy-MM-dd HH:mm:ss.SSSSSS", series_col="series_id",
                           tiebreak_col="tiebreak")


def scan_vendor_files(spark, sf):
    """All events as one CSV file per series, read back by the data source."""
    from panelcast.session import fresh_path
    from panelcast.sources.vendor import read_vendor_files, write_vendor_files

    folder = fresh_path(spark, "vendor-files")
    write_vendor_files(P.events_by_user(spark, sf), folder)
    return read_vendor_files(spark, folder)


def project_series(spark, sf):
    ev = P.read_table(spark, sf, "events")
    return ev.select(F.col("event_type").alias(SERIES), TS, VALUE)


def series_counts(spark, sf):
    return ordered.series_sizes(P.events_by_user(spark, sf))


def preview_first_k(spark, sf, k: int = 2):
    """First ``k`` rows of every series: a top-k per group.

    ``row_number() <= k`` lets Spark insert a map-side WindowGroupLimit, so
    at most ``k`` rows per series and input partition are shuffled.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(SERIES).orderBy(TS, TIEBREAK)
    p = P.events_by_user(spark, sf).withColumn("_rn", F.row_number().over(w))
    return p.where(F.col("_rn") <= k).select(
        SERIES, TS, TIEBREAK, VALUE, (F.col("_rn") - 1).cast("bigint").alias("row_number")
    )


# --- windows -----------------------------------------------------------------
def difference(spark, sf):
    return Differencer(inputCol=VALUE, outputCol="diff").transform(P.events_by_type(spark, sf))


def lag_features(spark, sf):
    return LagFeatures(inputCol=VALUE, lagLength=LAGS).transform(P.events_by_user(spark, sf))


def moving_average(spark, sf):
    df = MovingAverage(inputCol=VALUE, lagLength=LAGS).transform(P.events_by_type(spark, sf))
    return _round(df, [f"{VALUE}_{LAGS}_MovingAvg"])


def trend_sign(spark, sf):
    return TrendSign(inputCol=VALUE, lagLength=LAGS).transform(P.events_by_type(spark, sf))


def lead_label(spark, sf):
    """Clamped labels at horizons 1..5 of the difference, in one skew-safe pass."""
    from panelcast.functions.series import clamped_lead

    p = Differencer(inputCol=VALUE, outputCol="diff").transform(P.events_by_type(spark, sf))
    return ordered.apply_by_series(
        p, lambda d, w: d.select("*", *[clamped_lead("diff", h, w).alias(f"label_{h}") for h in range(1, H + 1)]),
        0, H,
    )


def row_index_q(spark, sf):
    return row_index(P.events_by_type(spark, sf))


def row_index_blocked(spark, sf):
    """The skew-safe index on one long series (range partitions + offsets)."""
    p = P.events_single(spark, sf)
    n = p.count()
    return ordered.index_rows(p, n, rows_per_partition=max(1, n // 7)).withColumnRenamed(
        ordered.IDX, "row_number"
    )


def lag_features_blocked(spark, sf):
    """Difference, 3 lags and 5 clamped labels on one long series via halo blocks."""
    from panelcast.plans.forecast import _local_features

    p = P.events_single(spark, sf)
    n = p.count()
    x = ordered.index_rows(p, n, rows_per_partition=max(1, n // 7))
    hs = list(range(1, H + 1))
    out = ordered.blocked_window(
        x, lambda d, w: _local_features(d, w, ForecastConfig(horizons=H, lags=LAGS), hs), ordered.IDX, max(64, n // 10), LAGS + 1, H
    )
    return out.select(SERIES, TS, TIEBREAK, VALUE, "diff", *[f"lag_{i}" for i in range(1, LAGS + 1)],
                      *[f"label_{h}" for h in hs])


# --- filters, split ------------------------------------------------------------
def _features_h1(spark, sf):
    """Difference, lags and label in a chain of transformers that looks for hot series once; also what it found."""
    p = P.events_by_type(spark, sf)
    heat = ordered.Heat.of(p, HOT_ROWS)
    for t in (Differencer(inputCol=VALUE, outputCol="diff"), LagFeatures(inputCol="diff", lagLength=LAGS),
              LeadLabel(inputCol="diff", outputCol="label", horizon=1)):
        p = t.setHeat(heat).transform(p)
    return p, heat


def complete_cases_q(spark, sf):
    return complete_cases(_features_h1(spark, sf)[0])


def time_split_q(spark, sf):
    features, heat = _features_h1(spark, sf)
    df = time_split(complete_cases(features), hot_series_rows=heat)
    return df.select(SERIES, TS, TIEBREAK, "row_number", "n_rows", "split")


# --- a null key that is hot, next to ordinary series ---------------------------------
def _mixed(spark, sf):
    """Panel whose null key holds 40 % of the rows, and a threshold that makes it the hot one."""
    ev = P.read_table(spark, sf, "events")
    key = F.when(~F.col("event_type").isin("view", "click"), F.col("event_type"))
    p = P.as_panel(ev, series=key, ts="ts", value="value", tiebreak="event_id")
    return p, max(1, int(0.3 * p.count()))


def difference_mixed_heat(spark, sf):
    p, hot = _mixed(spark, sf)
    return Differencer(inputCol=VALUE, outputCol="diff", hotSeriesRows=hot, blockRows=max(16, hot // 5)).transform(p)


def time_split_mixed_heat(spark, sf):
    p, hot = _mixed(spark, sf)
    df = time_split(p, hot_series_rows=hot, rows_per_partition=max(1, hot // 4))
    return df.select(SERIES, TS, TIEBREAK, "row_number", "n_rows", "split")


def forecast_mixed_heat(spark, sf):
    p, hot = _mixed(spark, sf)
    cfg = ForecastConfig(horizons=H, lags=0, hot_series_rows=hot, block_rows=max(16, hot // 5), rows_per_partition=max(1, hot // 4))
    return _round(forecast_panel(p, cfg).predictions, _pred_cols(range(1, H + 1)))


def actual_at_horizon(spark, sf):
    """Value h rows ahead inside the row's split, clamped at the split's end.

    Windows stay per series (train rows precede test rows), so hot series
    take the blocked path like every other bounded-frame window.
    """
    from panelcast.plans.forecast import _actual_columns

    df = time_split(P.events_by_type(spark, sf)).select(SERIES, TS, TIEBREAK, "split", VALUE)
    return ordered.apply_by_series(df, lambda d, w: d.select("*", *_actual_columns(w, range(1, H + 1))), 0, H)


# --- models ------------------------------------------------------------------------
def _linear0(spark, sf, panel=P.events_by_type, **kw):
    return forecast_panel(panel(spark, sf), ForecastConfig(horizons=H, lags=0, **kw))


def fit_linear(spark, sf):
    r = _linear0(spark, sf)
    c = r.coefficients.select(SERIES, "horizon", "n_train", "intercept",
                              F.element_at("coefficients", 1).alias("coef"))
    return _round(c, ["intercept", "coef"])


def forecast_panel_q(spark, sf):
    return _round(_linear0(spark, sf).predictions, _pred_cols(range(1, H + 1)))


def forecast_users(spark, sf):
    return _round(_linear0(spark, sf, P.events_by_user).predictions, _pred_cols(range(1, H + 1)))


def forecast_orders(spark, sf):
    # order values run to 1e6: compare forecasts in cents, the unit of the data
    return _round(_linear0(spark, sf, P.orders_daily).predictions, _pred_cols(range(1, H + 1)), 2)


def forecast_blocked(spark, sf):
    """Whole forecast of one long series through the skew-safe blocked path."""
    r = _linear0(spark, sf, P.events_single, hot_series_rows=0, block_rows=1000, rows_per_partition=1500)
    return _round(r.predictions, _pred_cols(range(1, H + 1)))


def forecast_one(spark, sf):
    rows, _ = forecast_horizon(P.events_by_type(spark, sf), 2, ForecastConfig(horizons=H, lags=0))
    return _round(rows, ["prediction"])


def score_linear(spark, sf):
    rows, _ = forecast_horizon(P.events_by_user(spark, sf), 1, ForecastConfig(horizons=1, lags=0))
    return _round(rows.select(SERIES, TS, TIEBREAK, "split", "label", "prediction"), ["prediction"])


def metric_rmse(spark, sf):
    m = _linear0(spark, sf).metrics
    return _round(m.select(SERIES, "horizon", "split", "n", "rmse"), ["rmse"])


def metric_r2(spark, sf):
    m = _linear0(spark, sf).metrics
    return _round(m.select(SERIES, "horizon", "split", "n", "r2"), ["r2"])


def metric_table_q(spark, sf):
    t = metric_table(_linear0(spark, sf).metrics, "rmse", "test", range(1, H + 1))
    return _round(t, [f"forecast_{h}day" for h in range(1, H + 1)])


def forecast_long_q(spark, sf):
    return _round(forecast_long(_linear0(spark, sf).predictions, range(1, H + 1)), ["value"])


def forecast_chart_q(spark, sf):
    return _round(forecast_chart(_linear0(spark, sf).predictions, range(1, H + 1), pixels=100), ["first", "last", "low", "high"])


def undifference(spark, sf):
    """Long-form undifferencing of the true future changes: rebuilds the level."""
    p = lead_label(spark, sf)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"label_{h}").alias("dz"))
                               for h in range(1, H + 1)]))
    long = p.select(SERIES, TS, TIEBREAK, VALUE, rows.alias("_r")).select(SERIES, TS, TIEBREAK, VALUE, "_r.*")
    return undifference_long(long, VALUE, "dz").drop("dz")


def sink_roundtrip(spark, sf):
    from panelcast.session import fresh_path

    path = fresh_path(spark, "predictions")
    write_predictions(_linear0(spark, sf).predictions, path, mode="errorifexists")
    return _round(read_predictions(spark, path), _pred_cols(range(1, H + 1)))


def forecast_nulls(spark, sf):
    """Every seventh value missing: rows complete at some horizons only stay in the predictions."""
    ev = P.read_table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 != 3, F.col("value")))
    p = P.as_panel(ev, series="event_type", ts="ts", value="value", tiebreak="event_id")
    return _round(forecast_panel(p, ForecastConfig(horizons=H, lags=0)).predictions, _pred_cols(range(1, H + 1)))


def join_predictions(spark, sf):
    """Prices with their predictions: every price row, matched on its key (null-safe)."""
    from panelcast.plans.report import join_predictions as join

    pred = _linear0(spark, sf).predictions.select(SERIES, TS, TIEBREAK, "row_number", "split", *[forecast_name(h) for h in range(1, H + 1)])
    return _round(join(P.events_by_type(spark, sf), pred), [forecast_name(h) for h in range(1, H + 1)])


def metric_sink_roundtrip(spark, sf):
    """Both metric files of a forecast, written and read back."""
    from panelcast.plans.report import write_legacy_metric_tables
    from panelcast.session import fresh_path

    prefix = fresh_path(spark, "metric-files") + "/"
    write_legacy_metric_tables(_linear0(spark, sf).metrics, LINEAR, prefix, range(1, H + 1))
    names = [f"forecast_{h}day" for h in range(1, H + 1)]
    out = None
    for split in ("train", "test"):
        t = spark.read.schema(", ".join(["Ticker string", *[f"{n} double" for n in names]])).option("header", "true").csv(
            f"{prefix}RMSE_{split}_{LINEAR}.csv").select("Ticker", F.lit(split).alias("split"), *names)
        out = t if out is None else out.unionByName(t)
    return _round(out, names)


def legacy_csv_roundtrip(spark, sf):
    """One series in the reference's two CSV files, written from one run and read back."""
    from panelcast.plans.report import read_legacy_csv, write_legacy_csv
    from panelcast.session import fresh_path

    name = fresh_path(spark, "legacy-files") + "/LR_all_"
    with forecast_panel(P.events_single(spark, sf), ForecastConfig(horizons=H, lags=0)).computed() as (predictions, _):
        write_legacy_csv(predictions, name)
    schema = ", ".join(["`Row Number` bigint", "Date timestamp_ntz", "Close double",
                        *[f"{c} double" for h in range(1, H + 1) for c in (f"DeltaZ{h}", f"forecast_{h}day", f"actual_{h}day")]])
    out = None
    for split in ("train", "test"):
        t = read_legacy_csv(spark, name, split, schema).withColumn("split", F.lit(split))
        out = t if out is None else out.unionByName(t)
    return _round(out, _pred_cols(range(1, H + 1)))


def forecast_generators(spark, sf):
    """A moving average and a trend sign of the change as model features next to a lag."""
    cfg = ForecastConfig(horizons=H, lags=1, generators=(("moving_average", 2), ("trend_sign", 1)))
    return _round(forecast_panel(P.events_by_type(spark, sf), cfg).predictions, _pred_cols(range(1, H + 1)))


def forecast_own_generator(spark, sf):
    """A generator defined here: the range of the change over the current and two previous rows; half the series go through blocks."""
    name = lambda n: f"range_{n}"
    register_generator("change_range", Generator(
        lambda n, c, w: {name(n): F.max(c).over(w.rowsBetween(-n, 0)) - F.min(c).over(w.rowsBetween(-n, 0))}, lambda n: [name(n)]))
    panel = P.events_by_type(spark, sf)
    middle = panel.groupBy(SERIES).count().agg(F.percentile_approx("count", 0.5)).first()[0]
    r = forecast_panel(panel, ForecastConfig(horizons=H, lags=1, generators=(("change_range", 2),), hot_series_rows=middle,
                                             block_rows=max(middle // 5, 10), rows_per_partition=max(middle // 3, 10)))
    return _round(r.predictions, _pred_cols(range(1, H + 1)))


def forecast_purged(spark, sf):
    """Training rows whose label lies beyond the split boundary are left out."""
    return _round(_linear0(spark, sf, purge_gap=True).predictions, _pred_cols(range(1, H + 1)))


def forecast_tail_drop(spark, sf):
    """Rows whose label lies beyond the series end have none."""
    return _round(_linear0(spark, sf, tail="drop").predictions, _pred_cols(range(1, H + 1)))


def metric_price_level(spark, sf):
    """RMSE and R2 of the forecast level against the actual level."""
    from panelcast.operators.metrics import level_metrics

    return _round(level_metrics(_linear0(spark, sf).predictions, range(1, H + 1)), ["rmse", "r2"])


def _lagged(regressor=None, **kw):
    def q(spark, sf):
        cfg = ForecastConfig(horizons=H, lags=LAGS, **({"regressor": regressor} if regressor else {}), **kw)
        return _round(forecast_panel(P.events_by_type(spark, sf), cfg).predictions, _pred_cols(range(1, H + 1)))
    return q


def forecast_single_series(spark, sf):
    """The notebook workload's shape: one series, 6 horizons, 4 lags, linear."""
    r = forecast_panel(P.events_single(spark, sf), ForecastConfig(horizons=6, lags=4))
    return _round(r.predictions, _pred_cols(range(1, 7)))


def feature_vectors_q(spark, sf):
    """The vector column of the second horizon, spread out again."""
    from pyspark.ml.functions import vector_to_array

    rows = feature_vectors(P.events_by_user(spark, sf), 2, lags=LAGS).withColumn("x", vector_to_array("features"))
    return rows.select(SERIES, "ts", TIEBREAK, VALUE, *[F.col("x")[j].alias(f"x{j}") for j in range(LAGS + 1)], "label", "split")


def _past_and_later(spark, sf):
    """The events up to three quarters of their time, and those after."""
    events = P.events_by_type(spark, sf)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    cut = F.lit((first + 3 * last) // 4)
    return events.where(micros <= cut), events.where(micros > cut)


def score_new_rows(spark, sf):
    """Fit on the past, save, load, score the later rows with the history that the model kept."""
    from panelcast.plans.model import PanelForecaster, PanelForecastModel
    from panelcast.session import fresh_path

    past, later = _past_and_later(spark, sf)
    path = fresh_path(spark, "saved-model")
    PanelForecaster(horizons=H, lags=LAGS).fit(past).write().save(path)
    names = [c for h in range(1, H + 1) for c in (f"DeltaZ{h}", f"forecast_{h}day")]
    return _round(PanelForecastModel.load(path).transform(later), names)


def score_new_rows_forest(spark, sf):
    """The same with a forest, in two steps: the first half of the later rows is the second half's history."""
    from panelcast.plans.model import PanelForecaster

    past, later = _past_and_later(spark, sf)
    model = PanelForecaster(horizons=H, lags=LAGS, regressor=RANDOM_FOREST, seed=7).fit(past)
    middle = later.agg(F.percentile_approx("ts", 0.5)).first()[0]
    first, second = later.where(F.col("ts") <= F.lit(middle)), later.where(F.col("ts") > F.lit(middle))
    names = [c for h in range(1, H + 1) for c in (f"DeltaZ{h}", f"forecast_{h}day")]
    return _round(model.transform(first).unionByName(model.advanced(first).transform(second)), names)


def stationarity_df(spark, sf):
    return _round(dickey_fuller(P.events_by_type(spark, sf)), ["slope", "stat"])


def stationarity_adf(spark, sf):
    return _round(adf_test(P.events_by_type(spark, sf), lags=2),
                  ["stat", "p_value", "crit_1pct", "crit_5pct", "crit_10pct"])


def stationarity_autolag(spark, sf):
    return _round(adf_autolag(P.events_by_type(spark, sf)),
                  ["stat", "p_value", "crit_1pct", "crit_5pct", "crit_10pct", "aic"])


def stationarity_autolag_bounded(spark, sf):
    """The lag search up to three lags."""
    return _round(adf_autolag(P.events_by_type(spark, sf), maxlag=3),
                  ["stat", "p_value", "crit_1pct", "crit_5pct", "crit_10pct", "aic"])


QUERIES = {
    "scan_panel": scan_panel,
    "scan_orders_daily": scan_orders_daily,
    "scan_csv": scan_csv,
    "scan_vendor_files": scan_vendor_files,
    "project_series": project_series,
    "series_counts": series_counts,
    "preview_first_k": preview_first_k,
    "difference": difference,
    "lag_features": lag_features,
    "moving_average": moving_average,
    "trend_sign": trend_sign,
    "lead_label": lead_label,
    "row_index": row_index_q,
    "row_index_blocked": row_index_blocked,
    "lag_features_blocked": lag_features_blocked,
    "complete_cases": complete_cases_q,
    "time_split": time_split_q,
    "actual_at_horizon": actual_at_horizon,
    "fit_linear": fit_linear,
    "forecast_panel": forecast_panel_q,
    "forecast_users": forecast_users,
    "forecast_orders": forecast_orders,
    "forecast_blocked": forecast_blocked,
    "forecast_one": forecast_one,
    "score_linear": score_linear,
    "metric_rmse": metric_rmse,
    "metric_r2": metric_r2,
    "metric_table": metric_table_q,
    "forecast_long": forecast_long_q,
    "forecast_chart": forecast_chart_q,
    "undifference": undifference,
    "sink_roundtrip": sink_roundtrip,
    "stationarity_df": stationarity_df,
    "difference_mixed_heat": difference_mixed_heat,
    "time_split_mixed_heat": time_split_mixed_heat,
    "forecast_mixed_heat": forecast_mixed_heat,
    "forecast_nulls": forecast_nulls,
    "forecast_generators": forecast_generators,
    "forecast_own_generator": forecast_own_generator,
    "forecast_purged": forecast_purged,
    "forecast_tail_drop": forecast_tail_drop,
    "metric_price_level": metric_price_level,
    "join_predictions": join_predictions,
    "metric_sink_roundtrip": metric_sink_roundtrip,
    "legacy_csv_roundtrip": legacy_csv_roundtrip,
    "forecast_linear_lags": _lagged(),
    "forecast_single_series": forecast_single_series,
    "forecast_tree": _lagged(DECISION_TREE, seed=7),
    "forecast_forest": _lagged(RANDOM_FOREST, seed=7),
    "forecast_gbt": _lagged(GBT, seed=7),
    "feature_vectors": feature_vectors_q,
    "score_new_rows": score_new_rows,
    "score_new_rows_forest": score_new_rows_forest,
    "stationarity_adf": stationarity_adf,
    "stationarity_autolag": stationarity_autolag,
    "stationarity_autolag_bounded": stationarity_autolag_bounded,
}
