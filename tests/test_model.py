"""The fitted model as an object: scoring later rows equals scoring in one go; save and load; edge rows."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, panel_from_rows
from panelcast import ForecastConfig, forecast_panel
from panelcast.operators.trees import DECISION_TREE, GBT, LINEAR, RANDOM_FOREST
from panelcast.plans.catalog import _past_and_later
from panelcast.plans.model import PanelForecaster, PanelForecastModel, last_rows

from test_forecast import _same

GENERATORS = (("moving_average", 2), ("trend_sign", 1))


@pytest.mark.parametrize("regressor,more", [(LINEAR, {"generators": GENERATORS}), (DECISION_TREE, {"tree_mode": "pooled"}), (RANDOM_FOREST, {}), (GBT, {})])
def test_later_rows_get_what_scoring_in_one_go_gives(spark, tmp_path, regressor, more):
    past, later = _past_and_later(spark, SF_SMALL)
    model = PanelForecaster(horizons=2, lags=2, regressor=regressor, seed=3, **more).fit(past)
    path = str(tmp_path / "model")
    model.write().save(path)
    model.write().overwrite().save(path)
    loaded = PanelForecastModel.load(path)
    assert loaded.config == model.config
    # in one go: all rows are new to a model without history
    bare = PanelForecastModel(model.config, model.models, model.history.limit(0))
    whole = bare.transform(past.unionByName(later)).join(later.select("series_id", "ts", "tiebreak"), ["series_id", "ts", "tiebreak"], "left_semi")
    got = loaded.transform(later)
    assert got.count() == later.count() and got.where("forecast_2day is null").count() == 0
    _same(got, whole)
    hot = PanelForecastModel(ForecastConfig(**{**model.config.__dict__, "hot_series_rows": 0, "block_rows": 20, "rows_per_partition": 60}),
                             model.models, model.history)
    _same(hot.transform(later.repartition(3)), got)


def test_the_model_is_that_of_the_forecast(spark):
    past, _ = _past_and_later(spark, SF_SMALL)
    cfg = ForecastConfig(horizons=2, lags=1)
    model = PanelForecaster(cfg).fit(past)
    bare = PanelForecastModel(cfg, model.models, model.history.limit(0))
    want = forecast_panel(past, cfg).predictions.select("series_id", "ts", "tiebreak", "DeltaZ1", "forecast_2day")
    got = bare.transform(past).join(want.select("series_id", "ts", "tiebreak"), ["series_id", "ts", "tiebreak"], "left_semi")
    _same(got.select(*want.columns), want)


def test_advanced_model_goes_on(spark):
    past, later = _past_and_later(spark, SF_SMALL)
    model = PanelForecaster(horizons=1, lags=3).fit(past)
    middle = later.agg(F.percentile_approx("ts", 0.5)).first()[0]
    first, second = later.where(F.col("ts") <= F.lit(middle)), later.where(F.col("ts") > F.lit(middle))
    _same(model.transform(first).unionByName(model.advanced(first).transform(second)), model.transform(later))


def test_edge_rows(spark):
    past = panel_from_rows(spark, [("a", t, t * t % 7) for t in range(20)] + [(None, t, t % 3) for t in range(20)] + [("short", 0, 1)])
    new = panel_from_rows(spark, [("a", 20, 5), ("a", 20, 5), (None, 20, 1), ("unknown", 20, 1), ("a", 21, None), ("short", 5, 2)])
    model = PanelForecaster(horizons=1, lags=1).fit(past)
    assert last_rows(past, 3).groupBy("series_id").count().agg(F.max("count")).first()[0] == 3
    got = model.transform(new.withColumn("grp", F.lit("clash"))).collect()
    assert len(got) == 6
    known = {(r.series_id, r.value): r.DeltaZ1 for r in got}
    assert known["a", 5.0] is not None and known[None, 1.0] is not None
    assert known["unknown", 1.0] is None and known["a", None] is None
    assert model.transform(new.limit(0)).collect() == []
