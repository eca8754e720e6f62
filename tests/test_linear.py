"""Grouped elastic net vs MLlib LinearRegression, and its edge cases."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators.linear import fit_grouped_linear, solve_elastic_net
from panelcast.plans.forecast import ForecastConfig, build_features, feature_columns
from panelcast.sources.panel import events_by_type


@pytest.fixture(scope="module")
def feats(spark):
    cfg = ForecastConfig(horizons=2, lags=3, hot_series_rows=None)
    f, _, hs = build_features(events_by_type(spark, SF_MID), cfg)
    return f.cache(), cfg, hs


def test_matches_mllib_per_series(spark, feats):
    f, cfg, hs = feats
    fcols = feature_columns(cfg.lags)
    coefs = fit_grouped_linear(f, fcols, {h: (f"label_{h}", f"train_{h}") for h in hs})
    rows = coefs.orderBy("series_id", "horizon").collect()
    assert len(rows) == 5 * len(hs)
    va = VectorAssembler(inputCols=fcols, outputCol="features")
    assert all(r["converged"] for r in rows)
    for row in rows:
        h = row["horizon"]
        train = f.where((F.col("series_id") == row["series_id"]) & F.col(f"train_{h}"))
        m = LinearRegression(labelCol=f"label_{h}", maxIter=100, regParam=0.4, elasticNetParam=0.1).fit(
            va.transform(train)
        )
        ours = np.array([row[f"coef_{j}"] for j in range(len(fcols))])
        assert np.allclose(ours, m.coefficients.toArray(), atol=1e-5, rtol=1e-4)
        assert abs(row["intercept"] - m.intercept) < 1e-5
        assert row["n_train"] == train.count()


def test_constant_label_gives_mean_intercept():
    n = np.array([10.0])
    icpt, coef, converged = solve_elastic_net(n, np.array([3.0]), np.array([0.0]), np.array([[1.0, 2.0]]),
                                   np.zeros((1, 2)), np.array([[[1.0, 0.2], [0.2, 2.0]]]), 0.4, 0.1)
    assert icpt[0] == 3.0 and np.all(coef == 0)


def test_constant_feature_gets_zero_coefficient():
    # feature 1 is constant (variance 0); feature 0 perfectly correlated with y
    n = np.array([50.0])
    cxx = np.array([[[4.0, 0.0], [0.0, 0.0]]])
    cxy = np.array([[4.0, 0.0]])
    icpt, coef, converged = solve_elastic_net(n, np.array([1.0]), np.array([4.0]), np.array([[0.0, 7.0]]), cxy, cxx, 0.4, 0.1)
    assert coef[0, 1] == 0.0 and coef[0, 0] > 0


def test_empty_group_is_nan():
    icpt, coef, converged = solve_elastic_net(np.array([0.0]), np.array([np.nan]), np.array([0.0]), np.array([[np.nan]]),
                                   np.array([[np.nan]]), np.zeros((1, 1, 1)), 0.4, 0.1)
    assert np.isnan(icpt[0]) and np.isnan(coef[0, 0]) and not converged[0]


def test_strongly_correlated_features_end_at_the_optimum():
    """Lags of a smooth level: coordinate descent alone still moves after a thousand sweeps."""
    t = np.arange(4000) / 300.0
    y = 50 * np.sin(t) + 10 * np.cos(3.1 * t)
    x = np.stack([y[3 - j:-1 - j] for j in range(3)], axis=1)
    label = y[4:]
    cxx, cxy = np.cov(x.T, bias=True)[None], np.array([[np.mean((x[:, j] - x[:, j].mean()) * label) for j in range(3)]])
    _, coef, converged = solve_elastic_net(np.array([len(x) * 1.0]), np.array([label.mean()]), np.array([label.var()]),
                                           x.mean(axis=0)[None], cxy, cxx, 0.4, 0.1)
    assert converged[0]
    sx, sy = x.std(axis=0), label.std()
    b, lam = coef[0] * sx / sy, 0.4 / sy
    slope = cxy[0] / (sx * sy) - (cxx[0] / np.outer(sx, sx)) @ b - 0.9 * lam * b
    for j in range(3):  # optimality conditions
        assert abs(slope[j] - 0.1 * lam * np.sign(b[j])) < 1e-9 if b[j] else abs(slope[j]) <= 0.1 * lam + 1e-9


def test_forty_lags_match_mllib(spark):
    from conftest import SF_SMALL
    from panelcast.operators import linear
    from panelcast.sources.panel import events_single

    cfg = ForecastConfig(horizons=2, lags=40, hot_series_rows=None)
    f, _, hs = build_features(events_single(spark, SF_SMALL), cfg)
    f, fcols = f.cache(), feature_columns(40)
    rows = {r["horizon"]: r for r in fit_grouped_linear(f.repartition(5), fcols, {h: (f"label_{h}", f"train_{h}") for h in hs}).collect()}
    assert len(rows) == 2 and all(r["converged"] for r in rows.values())
    va = VectorAssembler(inputCols=fcols, outputCol="features")
    for h, row in rows.items():
        train = f.where(F.col(f"train_{h}"))
        m = LinearRegression(labelCol=f"label_{h}", maxIter=2000, tol=1e-14, regParam=0.4, elasticNetParam=0.1).fit(va.transform(train))
        assert np.allclose([row[f"coef_{j}"] for j in range(41)], m.coefficients.toArray(), atol=1e-5)
        assert abs(row["intercept"] - m.intercept) < 1e-5 and row["n_train"] == train.count()
    assert linear.NATIVE_FEATURES < 41


def test_gram_matrices_give_the_native_fit(spark, feats, monkeypatch):
    from panelcast.operators import linear

    f, cfg, hs = feats
    fit = lambda: {(r["series_id"], r["horizon"]): r.asDict() for r in fit_grouped_linear(
        f.repartition(4), feature_columns(cfg.lags), {h: (f"label_{h}", f"train_{h}") for h in hs}).collect()}
    native = fit()
    monkeypatch.setattr(linear, "NATIVE_FEATURES", 0)
    monkeypatch.setattr(linear, "HELD_GROUPS", 1)
    gram = fit()
    assert native.keys() == gram.keys()
    for k, row in native.items():
        assert all(row[c] == pytest.approx(gram[k][c], abs=1e-9) for c in row if c != "series_id")


def test_feature_vectors_feed_any_regressor(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    from conftest import SF_SMALL
    from panelcast import forecast_panel
    from panelcast.plans.forecast import feature_vectors

    panel = events_by_type(spark, SF_SMALL).where("series_id = 'click'")
    cfg = ForecastConfig(horizons=2, lags=2, generators=(("moving_average", 3),))
    rows = feature_vectors(panel, 2, cfg)
    m = LinearRegression(maxIter=100, regParam=0.4, elasticNetParam=0.1).fit(rows.where("split = 'train'"))
    ours = forecast_panel(panel, cfg).coefficients.where("horizon = 2").first()
    assert feature_columns(2, cfg.generators) == ["diff", "lag_1", "lag_2", "ma_3"]
    assert np.allclose(ours["coefficients"], m.coefficients.toArray(), atol=1e-5)
    assert DecisionTreeRegressor().fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'")).count() > 10
