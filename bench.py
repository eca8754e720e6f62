"""

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is run once to
warm up, then ``$BENCH_REPS`` times (default 3); the median is reported.
Feature passes are forced with the ``noop`` sink (full evaluation, nothing
collected); forecasts write predictions and metrics to a fresh folder under
the shared checkpoint folder.  The session keeps shuffles at 2 x cores
tasks (no AQE coalescing: sf0.1 shuffles are a few MB).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from panelcast import ForecastConfig, forecast_panel  # noqa: E402
from panelcast.operators.trees import RANDOM_FOREST  # noqa: E402
from panelcast.plans.forecast import build_features  # noqa: E402
from panelcast.session import local_session  # noqa: E402
from panelcast.sources.panel import events_by_type, events_by_user, events_single  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))


def _noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def feature_pass(panel_fn, **kw):
    def run(spark):
        cfg = ForecastConfig(horizons=5, lags=3, **kw)
        f, _, _ = build_features(panel_fn(spark, SF_DIR), cfg)
        _noop(f)
    return run


def forecast(panel_fn, **kw):
    """Whole forecast: predictions and metrics written to a fresh shared folder."""
    from panelcast.session import fresh_path

    def run(spark):
        r = forecast_panel(panel_fn(spark, SF_DIR), ForecastConfig(horizons=5, lags=3, **kw))
        r.write(fresh_path(spark, "bench"))
    return run


def mllib_per_series(panel_fn):
    """The reference's shape: one MLlib LinearRegression fit per series x horizon."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from panelcast.plans.forecast import feature_columns

    def run(spark):
        cfg = ForecastConfig(horizons=5, lags=3, hot_series_rows=None)
        f, _, hs = build_features(panel_fn(spark, SF_DIR), cfg)
        x = VectorAssembler(inputCols=feature_columns(3), outputCol="features", handleInvalid="keep").transform(f)
        x = x.cache()
        keys = [r[0] for r in x.select("series_id").distinct().collect()]
        for k in keys:
            part = x.where(F.col("series_id") == k)
            for h in hs:
                LinearRegression(labelCol=f"label_{h}", maxIter=100, regParam=0.4, elasticNetParam=0.1).fit(
                    part.where(F.col(f"train_{h}"))
                )
        x.unpersist()
    return run


QUERIES = {
    "features_by_user": feature_pass(events_by_user),
    "features_by_type": feature_pass(events_by_type),
    "linear_by_user": forecast(events_by_user),
    "linear_by_type": forecast(events_by_type),
    "forest_by_user": forecast(events_by_user, regressor=RANDOM_FOREST, seed=7),
    "forest_by_user_pooled": forecast(events_by_user, regressor=RANDOM_FOREST, seed=7, tree_mode="pooled"),
    "features_single_global": feature_pass(events_single, hot_series_rows=None),
    "features_single_blocked": feature_pass(events_single, hot_series_rows=0, block_rows=10_000,
                                            rows_per_partition=12_500),
}

# comparison only (not part of the headline total): the one-fit-per-call shape
REFERENCE_SHAPES = {
    "mllib_linear_per_series_by_type": mllib_per_series(events_by_type),
}


def main():
    spark = local_session(app="panelcast-bench", cores=CPUS, shuffle_partitions=int(CPUS) * 2,
                          coalesce_shuffles=False)
    only = set(sys.argv[1:])

    def measure(fn):
        fn(spark)  # warm-up
        runs = []
        for _ in range(REPS):
            t0 = time.perf_counter()
            fn(spark)
            runs.append(time.perf_counter() - t0)
        return round(statistics.median(runs), 3)

    times, shapes = {}, {}
    for table, out in ((QUERIES, times), (REFERENCE_SHAPES, shapes)):
        for name, fn in table.items():
            if only and name not in only:
                continue
            out[name] = measure(fn)
            print(f"# {name}: {out[name]}s", file=sys.stderr)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "reference_shape": shapes,
        "sf": sf,
        "cpus": int(CPUS),
        "spark": spark.version,
        "reps": REPS,
    }))


if __name__ == "__main__":
    main()
