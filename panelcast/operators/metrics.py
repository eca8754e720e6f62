"""Regression metrics as grouped aggregates.

RMSE and R^2 are the two metrics the reference's evaluator computes (it
stores R^2 under the name RMSE for the linear and single-tree models; here
both are always reported, correctly named).  They are ordinary aggregates,
so one ``groupBy`` gives them for every series, horizon and split at once
instead of one evaluator job per model.

``r2 = 1 - SSE / SST`` with ``SST = sum((y - mean(y))^2) = n * var_pop(y)``;
it is null when SST is 0 (a constant label), where MLlib would divide by 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.sources.panel import SERIES

METRIC_COLUMNS = ["n", "rmse", "r2"]


def rmse_expr(n: Column, sse: Column) -> Column:
    return F.when(n > 0, F.sqrt(sse / n))


def r2_expr(n: Column, sse: Column, var_pop: Column) -> Column:
    sst = n * var_pop
    return F.when(sst > 0, F.lit(1.0) - sse / sst)


def regression_metrics(df: DataFrame, label: str, prediction: str, by=(SERIES,)) -> DataFrame:
    """``(by.., n, rmse, r2)`` of ``label`` vs ``prediction`` over all rows of ``df``."""
    err2 = F.pow(F.col(label) - F.col(prediction), 2)
    agg = df.groupBy(*by).agg(
        F.count(F.col(label)).alias("n"),
        F.sum(err2).alias("_sse"),
        F.var_pop(F.col(label)).alias("_vy"),
    )
    return agg.select(
        *by, "n",
        rmse_expr(F.col("n"), F.col("_sse")).alias("rmse"),
        r2_expr(F.col("n"), F.col("_sse"), F.col("_vy")).alias("r2"),
    )


def wide_metrics(df: DataFrame, targets: dict, key=(SERIES,)) -> DataFrame:
    """Metrics for several horizons and both splits in one aggregation.

    ``targets`` maps ``h -> (label, prediction, train_flag, test_flag)``.
    Returns the long table ``(key.., horizon, split, n, rmse, r2)``; a split
    without rows has no metric row.
    """
    aggs = []
    for h, (label, pred, train, test) in targets.items():
        for split, flag in (("train", train), ("test", test)):
            y = f"CASE WHEN `{flag}` THEN `{label}` END"
            e2 = f"CASE WHEN `{flag}` THEN power(`{label}` - `{pred}`, 2) END"
            aggs += [
                f"count({y}) AS _n_{h}_{split}",
                f"sum({e2}) AS _sse_{h}_{split}",
                f"var_pop({y}) AS _vy_{h}_{split}",
            ]
    wide = df.groupBy(*key).agg(*[F.expr(a) for a in aggs])
    # one stack() generator unpivots (horizon, split) into rows
    values = []
    for h in targets:
        for split in ("train", "test"):
            n, sse, vy = f"_n_{h}_{split}", f"_sse_{h}_{split}", f"_vy_{h}_{split}"
            values += [
                f"{int(h)}", f"'{split}'", n,
                f"CASE WHEN {n} > 0 THEN sqrt({sse} / {n}) END",
                f"CASE WHEN {n} * {vy} > 0 THEN 1.0D - {sse} / ({n} * {vy}) END",
            ]
    stack = f"stack({len(values) // 5}, {', '.join(values)}) AS (horizon, split, n, rmse, r2)"
    return wide.select(*key, F.expr(stack)).where(F.col("n") > 0)


def level_metrics(predictions: DataFrame, hs, key=(SERIES,)) -> DataFrame:
    """The same long table on the price level: forecast against actual value, by the rows' split."""
    from panelcast.functions.series import actual_name, forecast_name

    flags = [F.expr(f"split = '{split}' AND `{forecast_name(h)}` IS NOT NULL").alias(f"_{split}_{h}") for h in hs for split in ("train", "test")]
    return wide_metrics(predictions.select("*", *flags),
                        {h: (actual_name(h), forecast_name(h), f"_train_{h}", f"_test_{h}") for h in hs}, key)


def metric_table(metrics: DataFrame, metric: str = "rmse", split: str = "test",
                 horizons=None, key=(SERIES,)) -> DataFrame:
    """One row per series, one column ``forecast_<h>day`` per horizon (the legacy report)."""
    if horizons is None:
        horizons = sorted(r[0] for r in metrics.select("horizon").distinct().collect())
    piv = (
        metrics.where(F.col("split") == split)
        .groupBy(*key)
        .pivot("horizon", list(horizons))
        .agg(F.first(metric))
    )
    return piv.select(*key, *[F.col(str(h)).alias(f"forecast_{h}day") for h in horizons])
