"""(Augmented) Dickey-Fuller unit-root test for every series at once.

Regression per series (constant, no trend)::

    dy_t = a + g * y_(t-1) + sum_i c_i * dy_(t-i) + e,   i = 1..p

statistic = g / se(g).  The regression rows come from the same skew-safe
feature pass as the forecast (differences and their lags), the sums come
from one grouped aggregation, so no series is ever gathered in one place.

* ``dickey_fuller`` (p = 0): built-in ``regr_*`` aggregates only.
* ``adf_test`` (fixed p): centred moment matrix per series from
  ``covar_pop``, then the small OLS solves, MacKinnon p-values and critical
  values, vectorised in ``mapInPandas`` over one row per series.

* ``adf_autolag``: the lag order chosen by AIC per series (the usual
  default of the test), from lagged product sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import ordered
from panelcast.session import shared_dir
from panelcast.sources.panel import SERIES, VALUE

# --- fixed values: MacKinnon (1994) p-value surface, constant, one variable ---
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_STAR = -1.61
TAU_SMALLP = (2.1659, 1.4412, 0.038269)
TAU_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)
# --- fixed values: MacKinnon (2010) critical values, constant, one variable ---
# each row: tau_inf, then coefficients of 1/n, 1/n^2, 1/n^3
CRIT = {
    "1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "10pct": (-2.56677, -1.5384, -2.809, 0.0),
}


def mackinnon_p(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic (constant case)."""
    if stat is None or not math.isfinite(stat):
        return float("nan")
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefs = TAU_SMALLP if stat <= TAU_STAR else TAU_LARGEP
    z = sum(c * stat ** i for i, c in enumerate(coefs))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def mackinnon_crit(nobs: float) -> dict:
    return {k: sum(c / nobs ** i for i, c in enumerate(v)) for k, v in CRIT.items()}


def _regression_rows(panel: DataFrame, lags: int, **cfg_kw) -> DataFrame:
    """``(series_id, dy, y1, dy_lag_1..p)`` for every t >= p + 1."""
    from panelcast.plans.forecast import ForecastConfig, build_features

    cfg = ForecastConfig(horizons=1, lags=lags + 1, **cfg_kw)
    feats, _, _ = build_features(panel, cfg, hs=[1])
    return feats.where(F.col(f"lag_{lags + 1}").isNotNull()).select(
        SERIES,
        F.col("diff").alias("dy"),
        (F.col(VALUE) - F.col("diff")).alias("y1"),
        *[F.col(f"lag_{i}").alias(f"dy_lag_{i}") for i in range(1, lags + 1)],
    )


def dickey_fuller(panel: DataFrame, **cfg_kw) -> DataFrame:
    """``(series_id, n, slope, stat)`` of the plain Dickey-Fuller regression."""
    rows = _regression_rows(panel, 0, **cfg_kw)
    agg = rows.groupBy(SERIES).agg(
        F.regr_count("dy", "y1").alias("n"),
        F.regr_slope("dy", "y1").alias("slope"),
        F.regr_sxx("dy", "y1").alias("_sxx"),
        F.regr_syy("dy", "y1").alias("_syy"),
    )
    var = (F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")) / (F.col("n") - 2) / F.col("_sxx")
    stat = F.when((F.col("n") > 2) & (F.col("_sxx") > 0) & (var > 0), F.col("slope") / F.sqrt(var))
    return agg.select(SERIES, "n", "slope", stat.alias("stat"))


def adf_test(panel: DataFrame, lags: int = 1, **cfg_kw) -> DataFrame:
    """``(series_id, n, lags, stat, p_value, crit_1pct, crit_5pct, crit_10pct)``."""
    rows = _regression_rows(panel, lags, **cfg_kw)
    xs = ["y1"] + [f"dy_lag_{i}" for i in range(1, lags + 1)]
    k = len(xs)
    aggs = [F.count("dy").alias("n"), F.var_pop("dy").alias("vy")]
    aggs += [F.covar_pop(x, "dy").alias(f"cxy_{j}") for j, x in enumerate(xs)]
    aggs += [F.covar_pop(xs[a], xs[b]).alias(f"cxx_{a}_{b}") for a in range(k) for b in range(a, k)]
    stats = rows.groupBy(SERIES).agg(*aggs)
    schema = T.StructType([
        T.StructField(SERIES, T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("lags", T.IntegerType()),
        T.StructField("stat", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("crit_1pct", T.DoubleType()),
        T.StructField("crit_5pct", T.DoubleType()),
        T.StructField("crit_10pct", T.DoubleType()),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = len(pdf)
            n = pdf["n"].to_numpy(dtype=float)
            sxx = np.zeros((g, k, k))
            for a in range(k):
                for b in range(a, k):
                    v = pdf[f"cxx_{a}_{b}"].to_numpy(dtype=float) * n
                    sxx[:, a, b] = v
                    sxx[:, b, a] = v
            sxy = np.stack([pdf[f"cxy_{j}"].to_numpy(dtype=float) * n for j in range(k)], axis=1)
            syy = pdf["vy"].to_numpy(dtype=float) * n
            stat = np.full(g, np.nan)
            dof = n - k - 1
            for i in range(g):
                if not (dof[i] > 0) or not np.all(np.isfinite(sxx[i])):
                    continue
                try:
                    inv = np.linalg.inv(sxx[i])
                except np.linalg.LinAlgError:
                    continue
                beta = inv @ sxy[i]
                sse = syy[i] - beta @ sxy[i]
                var = sse / dof[i] * inv[0, 0]
                if var > 0:
                    stat[i] = beta[0] / math.sqrt(var)
            crit = [mackinnon_crit(v) if v > 0 else {c: float("nan") for c in CRIT} for v in n]
            yield pd.DataFrame({
                SERIES: pdf[SERIES],
                "n": pdf["n"].astype("int64"),
                "lags": np.full(g, lags, dtype="int32"),
                "stat": stat,
                "p_value": [mackinnon_p(s) for s in stat],
                "crit_1pct": [c["1pct"] for c in crit],
                "crit_5pct": [c["5pct"] for c in crit],
                "crit_10pct": [c["10pct"] for c in crit],
            })

    return stats.mapInPandas(solve, schema)


def _max_lag(nobs: Column, maxlag: int | None) -> Column:
    """Default lag bound ``ceil(12 * (nobs/100)^(1/4))``, at most ``nobs // 2 - 2``."""
    cap = F.floor(nobs / 2) - 2
    rule = F.ceil(F.lit(12.0) * F.pow(nobs / F.lit(100.0), F.lit(0.25))) if maxlag is None else F.lit(maxlag)
    return F.least(rule.cast("bigint"), cap.cast("bigint"))


def adf_autolag(panel: DataFrame, maxlag: int | None = None, **cfg_kw) -> DataFrame:
    """ADF with the lag order chosen by AIC, per series.

    For each series with ``nobs`` values and bound ``m`` (see
    :func:`_max_lag`), regressions with 0..m lagged differences are
    compared by AIC on the common sample ``t >= m + 1``; the chosen order
    ``b`` is then re-estimated on its own sample ``t >= b + 1``.

    Distributed as:

    * blocks of at most ``block_rows`` rows with the rows before them that
      their lags need; each gives, for k = 0..m, the sums of
      ``dy_t * dy_(t-k)`` and ``y_(t-1) * dy_(t-k)``, which are added up by
      series and k: no row carries lagged columns, and 2 (m + 1) numbers stay
      of a block whatever its length;
    * the first and last m + 2 rows of each series, which turn these sums
      into the moments of any sample (they only differ at the edges);
    * per series one Cholesky factor of the moments, whose leading parts are
      those of all orders, so that one forward solve gives every order's AIC.

    Returns ``(series_id, n, lags, stat, p_value, crit_1pct, crit_5pct,
    crit_10pct, aic)``; ``n`` counts the observations of the final
    regression.
    """
    from panelcast.operators.split import complete_cases
    from panelcast.plans.forecast import ForecastConfig
    from panelcast.sources.panel import PANEL_COLUMNS

    cfg = ForecastConfig(**cfg_kw)
    p = ordered.encode_key(complete_cases(panel.select(*PANEL_COLUMNS), [VALUE]))
    sizes = p.groupBy(SERIES).agg(F.count(F.lit(1)).alias("nobs"), F.avg(VALUE).alias("_c"))
    shared_dir(panel.sparkSession)  # the table is kept there
    sizes = sizes.withColumn("_m", _max_lag(F.col("nobs"), maxlag)).checkpoint(eager=True)
    # too short for any regression: a row with null results, as dickey_fuller gives
    short = sizes.where(F.col("_m") < 0).select(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (SERIES, "n") else
        (F.col(SERIES) if f.name == SERIES else F.lit(0).cast("bigint").alias("n")) for f in _ADF_SCHEMA.fields])
    sizes = sizes.where(F.col("_m") >= 0)
    top = sizes.agg(F.max("_m")).first()[0]
    if top is None:
        return ordered.decode_key(short)
    indexed = None
    for part, blocked, rows in ordered.split_by_heat(ordered.decode_key(p), cfg.hot_series_rows):
        part = ordered.encode_key(part)
        x = (ordered.index_rows(part, rows, cfg.rows_per_partition) if blocked
             else part.withColumn(ordered.IDX, F.row_number().over(ordered.series_window()).cast("bigint") - 1))
        x = x.select(SERIES, VALUE, ordered.IDX)
        indexed = x if indexed is None else indexed.unionByName(x)
    indexed = indexed.join(sizes, SERIES).select(SERIES, ordered.IDX, (F.col(VALUE) - F.col("_c")).alias("y"), "_m", "nobs")
    back = top + 1
    blocks = ordered.halo_blocks(indexed, ordered.IDX, max(cfg.block_rows, back), back, 0)
    sums = (blocks.select(SERIES, ordered.BLOCK, ordered.IDX, ordered.HOME, "y", "_m").groupBy(SERIES, ordered.BLOCK)
            .applyInArrow(_lagged_products, _PRODUCTS)
            .groupBy(SERIES, "k").agg(*[F.sum(c).alias(c) for c in ("dd", "yd", "y", "yy")]))
    edges = indexed.where((F.col(ordered.IDX) <= F.col("_m") + 1) | (F.col(ordered.IDX) >= F.col("nobs") - F.col("_m") - 2))
    edges = edges.select(SERIES, F.col(ordered.IDX).alias("t"), "y", "_m", "nobs")
    return ordered.decode_key(short.unionByName(sums.groupBy(SERIES).cogroup(edges.groupBy(SERIES)).applyInPandas(_solve_autolag, _ADF_SCHEMA)))


_PRODUCTS = f"{SERIES} string, k int, dd double, yd double, y double, yy double"


def _lagged_products(key, table):
    """Of one block: for each k the sums over its own rows of dy_t dy_(t-k) and y_(t-1) dy_(t-k); at k = 0 also of y_(t-1) and its square."""
    table = table.sort_by(ordered.IDX)
    y, t = table.column("y").to_numpy(), table.column(ordered.IDX).to_numpy()
    own = table.column(ordered.HOME).to_numpy(zero_copy_only=False)[1:]
    dy, y1, m = np.diff(y), y[:-1], table.column("_m")[0].as_py()
    dy_own, y1_own = np.where(own, dy, 0.0), np.where(own, y1, 0.0)  # dy[i] belongs to t[i + 1]
    at = np.arange(min(m, len(dy) - 1) + 1)
    dd, yd = (np.array([left[k:] @ dy[:len(dy) - k] for k in at]) for left in (dy_own, y1_own))
    rest = np.zeros((2, len(at)))
    if len(at):
        rest[:, 0] = y1_own.sum(), y1_own @ y1_own
    return pa.table({SERIES: pa.array([key[0].as_py()] * len(at), pa.string()), "k": pa.array(at, pa.int32()), "dd": dd, "yd": yd, "y": rest[0], "yy": rest[1]})


class _Moments:
    """Moments of one series from its lagged product sums and its edge rows (values less a constant)."""

    def __init__(self, sums: pd.DataFrame, edges: pd.DataFrame):
        s, e = sums.sort_values("k"), edges.sort_values("t")
        self.m, self.n = int(e["_m"].iloc[0]), int(e["nobs"].iloc[0])
        self.dd, self.yd = (np.zeros(self.m + 1) for _ in range(2))
        self.dd[s["k"].to_numpy()], self.yd[s["k"].to_numpy()] = s["dd"].to_numpy(), s["yd"].to_numpy()
        self.y, self.yy = float(s["y"].sum()), float(s["yy"].sum())
        self.value = dict(zip(e["t"].tolist(), e["y"].tolist(), strict=True))

    def _rows(self, ts: range, order: int) -> np.ndarray:
        """dy_(t-i), i = 0..order, where there is one, else 0; known only near the edges."""
        d = {t: self.value[t] - self.value[t - 1] for t in self.value if t - 1 in self.value}
        return np.array([[d.get(t - i, 0.0) for i in range(order + 1)] for t in ts]).reshape(len(ts), order + 1)

    def gram(self, order: int, start: int) -> np.ndarray:
        """Moments of [1, y_(t-1), dy_(t-1) .. dy_(t-order), dy_t] over t >= start (start <= m + 1)."""
        head, tail = self._rows(range(1, start), order), self._rows(range(self.n, self.n + order), order)
        i = np.arange(order + 1)
        d = self.dd[np.abs(i[:, None] - i)] - head.T @ head - tail.T @ tail
        before = np.array([self.value[t - 1] for t in range(1, start)])
        ones = np.array([self.value[self.n - 1 - k] - self.value[start - 1 - k] for k in i])
        out = np.zeros((order + 3, order + 3))
        cross = self.yd[:order + 1] - before @ head if len(before) else self.yd[:order + 1]
        out[0, 0], out[0, 1], out[1, 1] = self.n - start, self.y - before.sum(), self.yy - before @ before
        place = np.append(np.arange(2, order + 2), order + 2)  # of lags 1.. and of dy_t
        lags = np.append(np.arange(1, order + 1), 0)
        out[0, place], out[1, place] = ones[lags], cross[lags]
        out[np.ix_(place, place)] = d[np.ix_(lags, lags)]
        return np.triu(out) + np.triu(out, 1).T


def _solve_autolag(key, sums: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    moments = _Moments(sums, edges)
    best, aic = _best_lag(moments.gram(moments.m, moments.m + 1), moments.m)
    stat, nobs = _ols_stat(moments.gram(best, best + 1))
    crit = mackinnon_crit(nobs) if nobs > 0 else {c: float("nan") for c in CRIT}
    return pd.DataFrame([{
        SERIES: key[0], "n": int(nobs), "lags": int(best), "stat": stat, "p_value": mackinnon_p(stat),
        "crit_1pct": crit["1pct"], "crit_5pct": crit["5pct"], "crit_10pct": crit["10pct"], "aic": aic,
    }])


_ADF_SCHEMA = T.StructType([
    T.StructField(SERIES, T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("lags", T.IntegerType()),
    T.StructField("stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("crit_1pct", T.DoubleType()),
    T.StructField("crit_5pct", T.DoubleType()),
    T.StructField("crit_10pct", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
])


def _ssr(sub: np.ndarray):
    xx, xy, yy = sub[:-1, :-1], sub[:-1, -1], sub[-1, -1]
    beta = np.linalg.solve(xx, xy)
    return yy - beta @ xy, beta, xx


def _best_lag(zz: np.ndarray, m: int) -> tuple[int, float]:
    """Order with the lowest AIC on the common sample (smallest order on ties); orders that cannot be estimated are passed over."""
    n, xx, xy, yy = zz[0, 0], zz[:-1, :-1], zz[:-1, -1], zz[-1, -1]
    known = m + 2  # columns that are independent of those before them
    while known >= 2:
        try:
            factor = np.linalg.cholesky(xx[:known, :known])
            break
        except np.linalg.LinAlgError:
            known -= 1
    else:
        return 0, math.inf
    explained = np.cumsum(np.linalg.solve(factor, xy[:known]) ** 2)
    best, best_aic = 0, math.inf
    for order in range(known - 1):
        ssr = yy - explained[order + 1]
        if not ssr > 0:
            continue
        llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0)
        aic = -2.0 * llf + 2.0 * (order + 2)
        if aic < best_aic:
            best, best_aic = order, aic
    return best, best_aic


def _ols_stat(sub: np.ndarray):
    """t statistic of the y_(t-1) coefficient and the number of observations."""
    n = sub[0, 0]
    ncol = sub.shape[0] - 1
    try:
        ssr, beta, xx = _ssr(sub)
        inv = np.linalg.inv(xx)
    except np.linalg.LinAlgError:
        return float("nan"), n
    dof = n - ncol
    var = ssr / dof * inv[1, 1] if dof > 0 else float("nan")
    return (beta[1] / math.sqrt(var) if var > 0 else float("nan")), n
