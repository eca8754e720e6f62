import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast.operators.stationarity import CRIT, adf_test, dickey_fuller, mackinnon_crit, mackinnon_p
from panelcast.sources.panel import events_by_type


def _ols_stat(y, p):
    dy = np.diff(y)
    rows = []
    for t in range(p, len(dy)):
        rows.append([1.0, y[t]] + [dy[t - i] for i in range(1, p + 1)])
    X = np.array(rows)
    target = dy[p:]
    beta, *_ = np.linalg.lstsq(X, target, rcond=None)
    resid = target - X @ beta
    s2 = resid @ resid / (len(target) - X.shape[1])
    cov = s2 * np.linalg.inv(X.T @ X)
    return beta[1] / math.sqrt(cov[1, 1]), len(target)


def test_dickey_fuller_and_adf_match_least_squares(spark):
    p = events_by_type(spark, SF_SMALL)
    key = p.select("series_id").orderBy("series_id").first()[0]
    y = np.array([r["value"] for r in p.where(F.col("series_id") == key).orderBy("ts", "tiebreak").collect()])
    df0 = dickey_fuller(p).where(F.col("series_id") == key).first()
    stat0, n0 = _ols_stat(y, 0)
    assert df0["n"] == n0 and abs(df0["stat"] - stat0) < 1e-8
    for lags in (1, 2):
        row = adf_test(p, lags=lags).where(F.col("series_id") == key).first()
        stat, n = _ols_stat(y, lags)
        assert row["n"] == n and abs(row["stat"] - stat) < 1e-8
        assert 0.0 <= row["p_value"] <= 1.0


def test_mackinnon_values_at_critical_points():
    assert abs(mackinnon_p(CRIT["1pct"][0]) - 0.01) < 2e-3
    assert abs(mackinnon_p(CRIT["5pct"][0]) - 0.05) < 2e-3
    assert abs(mackinnon_p(CRIT["10pct"][0]) - 0.10) < 2e-3
    assert mackinnon_p(5.0) == 1.0 and mackinnon_p(-30.0) == 0.0
    c = mackinnon_crit(1e12)
    assert abs(c["5pct"] - CRIT["5pct"][0]) < 1e-9


def _autolag_bruteforce(x):
    """Direct lag search: AIC over 0..maxlag on the common sample, refit on the chosen one."""
    nobs_all = len(x)
    maxlag = min(int(math.ceil(12.0 * (nobs_all / 100.0) ** 0.25)), nobs_all // 2 - 2)
    dx = np.diff(x)

    def design(p, start):
        rows, target = [], []
        for t in range(start, len(x)):
            rows.append([1.0, x[t - 1]] + [dx[t - 1 - i] for i in range(1, p + 1)])
            target.append(dx[t - 1])
        return np.array(rows), np.array(target)

    best, best_aic = None, math.inf
    for p in range(maxlag + 1):
        X, y = design(p, maxlag + 1)
        beta, *_ = np.linalg.lstsq(X, y, rcond=None)
        ssr = float(((y - X @ beta) ** 2).sum())
        n = len(y)
        aic = n * math.log(2 * math.pi) + n * math.log(ssr / n) + n + 2 * (p + 2)
        if aic < best_aic:
            best, best_aic = p, aic
    X, y = design(best, best + 1)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - X.shape[1])
    se = math.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1])
    return best, beta[1] / se, len(y), best_aic


def test_adf_autolag_matches_direct_search(spark):
    from conftest import SF_MID
    from panelcast.operators.stationarity import adf_autolag

    p = events_by_type(spark, SF_MID)
    got = {r["series_id"]: r for r in adf_autolag(p).collect()}
    assert len(got) == 5
    for key in sorted(got):
        y = np.array([r["value"] for r in p.where(F.col("series_id") == key).orderBy("ts", "tiebreak").collect()])
        lag, stat, n, aic = _autolag_bruteforce(y)
        g = got[key]
        assert g["lags"] == lag and g["n"] == n
        assert abs(g["stat"] - stat) < 1e-7 and abs(g["aic"] - aic) < 1e-6 * abs(aic)
        assert abs(g["p_value"] - mackinnon_p(stat)) < 1e-9


def test_adf_autolag_blocked_equals_plain(spark):
    from panelcast.operators.stationarity import adf_autolag

    p = events_by_type(spark, SF_SMALL)
    a = {r["series_id"]: (r["lags"], r["n"], round(r["stat"], 9)) for r in adf_autolag(p, hot_series_rows=None).collect()}
    b = {r["series_id"]: (r["lags"], r["n"], round(r["stat"], 9))
         for r in adf_autolag(p, hot_series_rows=0, block_rows=40, rows_per_partition=70).collect()}
    assert a == b


def test_adf_autolag_buckets_do_not_change_results(spark):
    from panelcast.operators.stationarity import adf_autolag
    from panelcast.sources.panel import events_by_user, events_single

    users = events_by_user(spark, SF_SMALL).where("series_id in ('1', '2', '3')")
    single = events_single(spark, SF_SMALL)
    both = {r["series_id"]: (r["lags"], r["n"], round(r["stat"], 9)) for r in adf_autolag(users.unionByName(single)).collect()}
    alone = {r["series_id"]: (r["lags"], r["n"], round(r["stat"], 9))
             for df in (users, single) for r in adf_autolag(df).collect()}
    assert both == alone and len(both) == 4


def test_series_too_short_for_a_regression_have_a_row(spark):
    from conftest import panel_from_rows
    from panelcast.operators.stationarity import adf_autolag

    rows = [("short", t, float(t)) for t in range(3)] + [(None, t, float((t * t * 7919 + 31 * t) % 101)) for t in range(60)]
    got = {r["series_id"]: r for r in adf_autolag(panel_from_rows(spark, rows)).collect()}
    assert set(got) == {"short", None}
    assert got["short"]["stat"] is None and got["short"]["n"] == 0 and got[None]["stat"] is not None
