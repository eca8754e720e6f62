"""A fitted forecast as an object: fit once, save, load, score later rows.

:class:`PanelForecaster` is an ``Estimator`` over a panel; its model holds one
row per series (coefficients or trees) and the last rows of every series that a
feature looks back on.  ``transform`` scores new rows of those series with that
history alone: it reads no other past row, and its results are those of scoring
the whole panel in one go.  Both tables are Parquet, also when saved.

Defined cases: rows of a series without a model, and rows whose features are
incomplete, have null predictions; a series that is new starts at its first new
row; rows are ordered with the history by (ts, tiebreak), so that new rows are
meant to be later than it; rows given twice are scored twice; an empty table
gives no rows; columns other than the panel's are not kept.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions.series import delta_name, forecast_name
from panelcast.operators import ordered
from panelcast.operators.linear import coefficients_wide, fit_grouped_linear, linear_prediction
from panelcast.operators.trees import LINEAR, fit_grouped_trees, score_rows
from panelcast.plans.forecast import ForecastConfig, _back, _features_of, _local_features, _union, build_feature_pieces
from panelcast.session import fresh_path
from panelcast.sources.panel import PANEL_COLUMNS, SERIES, TIEBREAK, TS, VALUE


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of every series (each task keeps no more of one before the shuffle)."""
    latest = Window.partitionBy(SERIES).orderBy(F.desc(TS), F.desc(TIEBREAK))
    return panel.select(*PANEL_COLUMNS).withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") <= n).drop("_nth")


class PanelForecaster(Estimator):
    """Fits what :func:`forecast_panel` fits: every series, every horizon, on the first ``split_ratio`` of its rows."""

    def __init__(self, config: ForecastConfig | None = None, **overrides):
        super().__init__()
        self.config = replace(config or ForecastConfig(), **overrides)

    def _fit(self, dataset: DataFrame) -> PanelForecastModel:
        cfg, hs = self.config, list(range(1, self.config.horizons + 1))
        features = _features_of(cfg)
        rows = _union([f for f, _ in build_feature_pieces(dataset, cfg, hs)])
        if cfg.regressor == LINEAR:
            coefs = fit_grouped_linear(rows, features, {h: (f"label_{h}", f"train_{h}") for h in hs},
                                       reg_param=cfg.reg_param, elastic_net=cfg.elastic_net)
            models = _kept(coefficients_wide(coefs, hs, len(features)).withColumnRenamed(SERIES, "grp"), "model-linear")
        else:
            models = fit_grouped_trees(rows, features, {h: (f"label_{h}", f"train_{h}", delta_name(h)) for h in hs},
                                       cfg.regressor, cfg.seed, cfg.tree_mode == "pooled")
        return PanelForecastModel(cfg, models, _kept(last_rows(dataset, _back(cfg)), "model-history"))


class PanelForecastModel(Model, MLWritable, MLReadable):
    """``models``: one row per group (``grp``); ``history``: the last rows of every series."""

    def __init__(self, config: ForecastConfig, models: DataFrame, history: DataFrame):
        super().__init__()
        self.config, self.models, self.history = config, models, history

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """series_id, ts, tiebreak, value and per horizon ``DeltaZ<h>`` and ``forecast_<h>day`` of every new row."""
        cfg, hs = self.config, list(range(1, self.config.horizons + 1))
        features, columns = _features_of(cfg), [SERIES, TS, TIEBREAK, VALUE]
        new = dataset.select(*columns).withColumn("_new", F.lit(True))
        rows = new.unionByName(self.history.select(*columns).withColumn("_new", F.lit(False)))
        rows = ordered.apply_by_series(rows, lambda d, w: _local_features(d, w, cfg, []), _back(cfg), 0,
                                       cfg.hot_series_rows, cfg.block_rows, cfg.rows_per_partition)
        rows = ordered.encode_key(rows.where("_new"))
        models, names = self.models, {h: delta_name(h) for h in hs}
        if cfg.regressor == LINEAR:
            x = rows.join(models, rows[SERIES] == models["grp"], "left")
            scored = x.select(*columns, *[linear_prediction(features, h).alias(n) for h, n in names.items()])
        else:
            models = models.drop(*[c for c in models.columns if c.startswith(("feature_", "at_"))])
            if cfg.tree_mode == "pooled":
                x = rows.withColumn("grp", F.lit("all")).join(F.broadcast(models), "grp", "left")  # one row
            else:
                x = rows.join(models, rows[SERIES] == models["grp"], "left")
            scored = score_rows(x, [*columns, *features], features, names, cfg.regressor)
        running, out = F.col(VALUE), []
        for h in hs:
            running = running + F.col(names[h])
            out += [F.col(names[h]), running.alias(forecast_name(h))]
        return ordered.decode_key(scored.select(*columns, *out))

    def advanced(self, rows: DataFrame) -> PanelForecastModel:
        """The same model after ``rows``: they are the history of what comes next."""
        history = self.history.unionByName(rows.select(*self.history.columns))
        return PanelForecastModel(self.config, self.models, _kept(last_rows(history, _back(self.config)), "model-history"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PanelForecastModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        base, m = path.rstrip("/"), self.model
        m.models.write.parquet(f"{base}/models")
        m.history.write.parquet(f"{base}/history")
        m.history.sparkSession.createDataFrame([(json.dumps(asdict(m.config)),)], "value string").coalesce(1).write.text(f"{base}/config")


class _Reader(MLReader):
    def load(self, path: str) -> PanelForecastModel:
        base, spark = path.rstrip("/"), SparkSession.getActiveSession()
        values = json.loads(spark.read.text(f"{base}/config").first()[0])
        values["generators"] = tuple(tuple(g) for g in values["generators"])
        return PanelForecastModel(ForecastConfig(**values), spark.read.parquet(f"{base}/models"), spark.read.parquet(f"{base}/history"))
