"""Elastic-net linear regression fitted for every series at once.

MLlib's ``LinearRegression`` fits one model per call.  Fitting one per
series (and per horizon) that way needs a Spark job per model.  Here the fit
is one aggregation:

1. ``groupBy(series_id, horizon)`` with built-in, numerically stable
   aggregates (``avg``, ``var_pop``, ``covar_pop``) of the features and
   labels over the training rows of each horizon (the wide feature row is
   exploded into one row per horizon it trains).  Spark combines them map-side (partial
   aggregation), so a hot series costs one small buffer per task, never a
   task of its own.
2. ``mapInPandas`` over that table (one row per series and horizon) solves all the small
   problems together with numpy, vectorised across series, on the
   standardised normal equations.

More than ``NATIVE_FEATURES`` features would need hundreds of separate
aggregates.  Then Arrow batches give partial Gram matrices instead: per series
and horizon the number, means and centred products of the batch's training
rows, merged inside a task, and once more per series where they are solved.

The objective is MLlib's, with ``standardization=True`` and an intercept::

    1/(2n) * sum (y - b0 - x.b)^2 + lam * (alpha*|b~|_1 + (1-alpha)/2*|b~|_2^2)

where ``b~`` are the coefficients of the standardised features and
``lam = regParam / std(y)`` (population std).  Checked against MLlib
``LinearRegression(maxIter=100, regParam=0.4, elasticNetParam=0.1)``.
Coordinate descent finds which coefficients are not zero, an exact solve of
that set ends at the optimum that MLlib's OWL-QN approaches within its
tolerance; the column ``converged`` says so per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.panel import SERIES

NATIVE_FEATURES = 6  # beyond, the aggregates no longer fit generated code
HELD_GROUPS = 256  # series and horizons that a task sums up before it tells them


def linear_stats(df: DataFrame, features: Sequence[str], label: str, key=(SERIES,)) -> DataFrame:
    """Sufficient statistics of ``label ~ features`` per key (all rows of ``df``).

    21 aggregates for 4 features: few enough buffer fields for Spark to keep
    the aggregation in whole-stage codegen.
    """
    p = len(features)
    y = f"`{label}`"
    xs = [f"`{f}`" for f in features]
    aggs = [f"count({y}) AS n", f"avg({y}) AS my", f"var_pop({y}) AS vy"]
    aggs += [f"avg({xs[j]}) AS mx_{j}" for j in range(p)]
    aggs += [f"covar_pop({xs[j]}, {y}) AS cxy_{j}" for j in range(p)]
    aggs += [
        (f"var_pop({xs[j]})" if j == k else f"covar_pop({xs[j]}, {xs[k]})") + f" AS cxx_{j}_{k}"
        for j in range(p)
        for k in range(j, p)
    ]
    return df.groupBy(*key).agg(*[F.expr(a) for a in aggs])


def training_rows(df: DataFrame, features: Sequence[str], targets: dict, key=(SERIES,)) -> DataFrame:
    """Long training table ``(key.., horizon, features.., y)``: one row per (row, target) it trains."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(label).alias("y"), F.col(flag).alias("_tr"))
        for h, (label, flag) in targets.items()
    ]))
    return (
        df.select(*key, *features, rows.alias("_r"))
        .select(*key, *features, "_r.*")
        .where(F.col("_tr"))
        .drop("_tr")
    )


def solve_elastic_net(n, my, vy, mx, cxy, cxx, reg_param, alpha, sweeps=200, rounds=200, tol=1e-12):
    """Vectorised elastic net from moments.

    Shapes: ``n, my, vy`` (G,), ``mx, cxy`` (G, p), ``cxx`` (G, p, p)
    population (co)variances.  Returns ``(intercept (G,), coef (G, p),
    converged (G,))``; groups without rows give NaN.

    Rounds of coordinate descent propose which coefficients are not zero and
    their signs; the linear system of that set is solved exactly and kept for
    a group as soon as it satisfies the optimality conditions.  Slowly
    converging groups (strongly correlated features) so end at the optimum as
    well; ``converged`` is False for a group whose set was not found.
    """
    g, p = mx.shape
    sx = np.sqrt(np.clip(np.diagonal(cxx, axis1=1, axis2=2), 0.0, None))
    sy = np.sqrt(np.clip(vy, 0.0, None))
    live = sx > 0.0  # constant features get coefficient 0, as in MLlib
    safe_sx = np.where(live, sx, 1.0)
    safe_sy = np.where(sy > 0.0, sy, 1.0)
    corr = cxx / (safe_sx[:, :, None] * safe_sx[:, None, :])
    corr = corr * (live[:, :, None] & live[:, None, :])
    r = np.where(live, cxy / (safe_sx * safe_sy[:, None]), 0.0)
    lam = reg_param / safe_sy
    l1, l2 = alpha * lam, (1.0 - alpha) * lam
    b, done = np.zeros((g, p)), ~(n > 0)
    for _ in range(rounds):
        todo = np.flatnonzero(~done)
        if not len(todo):
            break
        c, rr, w1, w2, lv, x = corr[todo], r[todo], l1[todo], l2[todo], live[todo], b[todo]
        for _ in range(sweeps):
            old = x.copy()
            for j in range(p):
                z = rr[:, j] - (c[:, j, :] * x).sum(axis=1) + c[:, j, j] * x[:, j]
                x[:, j] = np.sign(z) * np.maximum(np.abs(z) - w1, 0.0) / (1.0 + w2)
                x[:, j] = np.where(lv[:, j], x[:, j], 0.0)
            if np.nanmax(np.abs(x - old), initial=0.0) < tol:
                break
        sign = np.sign(x)
        use = (sign[:, :, None] != 0) & (sign[:, None, :] != 0)
        system = np.where(use, c, 0.0) + np.eye(p) * np.where(sign != 0, w2[:, None], 1.0)[:, :, None]
        solvable = np.linalg.matrix_rank(system) == p
        system[~solvable] = np.eye(p)
        exact = np.linalg.solve(system, np.where(sign != 0, rr - w1[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
        slack = rr - np.einsum("gjk,gk->gj", c, exact) - w2[:, None] * exact
        edge = 1e-9 * (1.0 + w1)[:, None]
        ok = solvable & np.where(sign != 0, (exact * sign > 0), (np.abs(slack) <= w1[:, None] + edge) | ~lv).all(axis=1)
        b[todo] = np.where(ok[:, None], exact, x)
        done[todo] = ok
    coef = b * (sy[:, None] / safe_sx)
    coef = np.where(sy[:, None] > 0.0, coef, 0.0)  # constant label: intercept only
    intercept = my - (coef * mx).sum(axis=1)
    empty = ~(n > 0)
    intercept = np.where(empty, np.nan, intercept)
    coef = np.where(empty[:, None], np.nan, coef)
    return intercept, coef, (done | (sy == 0.0)) & ~empty


def fit_grouped_linear(df: DataFrame, features: Sequence[str], targets: dict, key=(SERIES,),
                       reg_param: float = 0.4, elastic_net: float = 0.1) -> DataFrame:
    """Long coefficient table ``(key.., horizon, n_train, intercept, converged, coef_0..coef_(p-1))``.

    ``targets`` maps a horizon ``h`` to ``(label_col, train_flag_col)``.
    One aggregation over the exploded training rows, grouped by key and
    horizon; then one vectorised solve per batch of groups.
    """
    p = len(features)
    fields = [df.schema[k] for k in key] + [
        T.StructField("horizon", T.IntegerType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("converged", T.BooleanType()),
    ] + [T.StructField(f"coef_{j}", T.DoubleType()) for j in range(p)]
    schema = T.StructType(fields)
    names = [f.name for f in fields]
    if p > NATIVE_FEATURES:
        return _gram_fit(df, features, targets, key, reg_param, elastic_net, schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy(dtype=float)
            mx = np.stack([pdf[f"mx_{j}"].to_numpy(dtype=float) for j in range(p)], axis=1)
            cxy = np.stack([pdf[f"cxy_{j}"].to_numpy(dtype=float) for j in range(p)], axis=1)
            cxx = np.zeros((len(pdf), p, p))
            for j in range(p):
                for k in range(j, p):
                    v = pdf[f"cxx_{j}_{k}"].to_numpy(dtype=float)
                    cxx[:, j, k] = v
                    cxx[:, k, j] = v
            icpt, coef, converged = solve_elastic_net(
                n, pdf["my"].to_numpy(dtype=float), np.nan_to_num(pdf["vy"].to_numpy(dtype=float)),
                mx, np.nan_to_num(cxy), np.nan_to_num(cxx), reg_param, elastic_net,
            )
            out = {k: pdf[k] for k in key}
            out["horizon"] = pdf["horizon"].astype("int32")
            out["n_train"] = pdf["n"].astype("int64")
            out["intercept"] = icpt
            out["converged"] = converged
            for j in range(p):
                out[f"coef_{j}"] = coef[:, j]
            yield pd.DataFrame(out)[names]

    stats = linear_stats(training_rows(df, features, targets, key), features, "y", (*key, "horizon"))
    return stats.mapInPandas(solve, schema)


# --- many features: Gram matrices of Arrow batches ------------------------------
def merged_moments(a, b):
    """(n, mean, centred products) of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _gram_partials(keys: int, p: int, horizons: list[int]):
    """Rows (keys, features, label and flag per horizon) to partial moments; few per task and series."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        kinds = []

        def told():
            groups, moments = list(held), list(held.values())
            held.clear()
            columns = [pa.array([g[i] for g in groups], kinds[i]) for i in range(keys)]
            columns += [pa.array([g[keys] for g in groups], pa.int32()), pa.array([float(m[0]) for m in moments]),
                        pa.array([m[1] for m in moments], pa.list_(pa.float64())), pa.array([m[2].ravel() for m in moments], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=[*[f"key_{i}" for i in range(keys)], "horizon", "n", "mean", "products"])

        for batch in batches:
            kinds = [batch.column(i).type for i in range(keys)]
            x = np.column_stack([batch.column(keys + j).to_numpy(zero_copy_only=False).astype(float) for j in range(p)])
            group = pd.MultiIndex.from_arrays([batch.column(i).to_pylist() for i in range(keys)])
            code, found = group.factorize()
            order = np.argsort(code, kind="stable")
            edge = np.searchsorted(code[order], np.arange(len(found) + 1))
            for i, h in enumerate(horizons):
                y = batch.column(keys + p + 2 * i).to_numpy(zero_copy_only=False).astype(float)
                use = batch.column(keys + p + 2 * i + 1).fill_null(False).to_numpy(zero_copy_only=False)
                for g, name in enumerate(found):
                    rows = order[edge[g]:edge[g + 1]]
                    rows = rows[use[rows]]
                    if len(rows):
                        z = np.column_stack([x[rows], y[rows]])
                        mean = z.mean(axis=0)
                        z -= mean
                        at = (*name, h)
                        held[at] = merged_moments(held.get(at), (len(rows), mean, z.T @ z))
            if len(held) > HELD_GROUPS * len(horizons):
                yield told()
        if held:
            yield told()

    return run


def _gram_fit(df: DataFrame, features: Sequence[str], targets: dict, key, reg_param: float, elastic_net: float, schema) -> DataFrame:
    p, names = len(features), [f.name for f in schema.fields]
    kinds = ", ".join(f"key_{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(key))
    flags = [F.col(flag) for _, flag in targets.values()]
    some = flags[0]
    for flag in flags[1:]:
        some = some | flag
    rows = df.where(some).select(*key, *[F.col(f).cast("double") for f in features], *[F.col(c) for pair in targets.values() for c in pair])
    partials = rows.mapInArrow(_gram_partials(len(key), p, list(targets)), f"{kinds}, horizon int, n double, mean array<double>, products array<double>")

    def solve(group, table):
        moments = None
        for n, mean, products in zip(table.column("n").to_pylist(), table.column("mean").to_pylist(), table.column("products").to_pylist(), strict=True):
            moments = merged_moments(moments, (n, np.array(mean), np.array(products).reshape(p + 1, p + 1)))
        n, mean, c = moments
        c = c / n
        intercept, coef, converged = solve_elastic_net(np.array([n]), mean[p:], c[p, p:], mean[None, :p], c[None, :p, p], c[None, :p, :p], reg_param, elastic_net)
        values = [*[k.as_py() for k in group], int(n), float(intercept[0]), bool(converged[0]), *coef[0].tolist()]
        kinds = [*[k.type for k in group], pa.int64(), pa.float64(), pa.bool_(), *[pa.float64()] * p]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    return partials.groupBy(*[f"key_{i}" for i in range(len(key))], "horizon").applyInArrow(solve, schema)


def coefficients_wide(coefs: DataFrame, hs, p: int, key=(SERIES,)) -> DataFrame:
    """One row per key with ``icpt_<h>`` and ``coef_<h>_<j>`` (small table: one row per series)."""
    cols = []
    for h in hs:
        cols.append(f"max(CASE WHEN horizon = {int(h)} THEN intercept END) AS icpt_{h}")
        cols += [f"max(CASE WHEN horizon = {int(h)} THEN coef_{j} END) AS coef_{h}_{j}" for j in range(p)]
    return coefs.groupBy(*key).agg(*[F.expr(c) for c in cols])


def linear_prediction(features: Sequence[str], h) -> Column:
    """``icpt_<h> + sum_j coef_<h>_<j> * x_j`` as a native expression."""
    pred = F.col(f"icpt_{h}")
    for j, f in enumerate(features):
        pred = pred + F.col(f"coef_{h}_{j}") * F.col(f)
    return pred


def coefficients_report(coefs: DataFrame, p: int, key=(SERIES,)) -> DataFrame:
    """``(key.., horizon, n_train, intercept, converged, coefficients array)``."""
    arr = F.expr(f"array({', '.join(f'coef_{j}' for j in range(p))}) AS coefficients")
    return coefs.select(*key, "horizon", "n_train", "intercept", "converged", arr)
