"""Properties of the multi-horizon forecast plan."""
from collections.abc import Iterator

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, panel_from_rows
from panelcast import ForecastConfig, forecast_panel
from panelcast.operators import trees
from panelcast.operators.trees import DECISION_TREE, GBT, RANDOM_FOREST
from panelcast.sources.panel import events_by_type, events_by_user, events_single

Y = [10, 12, 12, 9, 15, 20, 18, 21, 25, 24]


def _same(a, b, cols=None, tol=1e-9):
    cols = cols or a.columns
    ra = sorted(tuple(r[c] for c in cols) for r in a.select(*cols).collect())
    rb = sorted(tuple(r[c] for c in cols) for r in b.select(*cols).collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tol * max(1.0, abs(u)), (x, y)
            else:
                assert u == v, (x, y)


def test_hand_series_shape(spark):
    p = panel_from_rows(spark, [("a", t, y) for t, y in enumerate(Y)])
    r = forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=None))
    rows = r.predictions.orderBy("ts").collect()
    # 1 lag drops the first row: N = 9, k = int(9*0.7) = 6 -> 7 train, 2 test
    assert [x["split"] for x in rows] == ["train"] * 7 + ["test"] * 2
    assert [x["row_number"] for x in rows] == list(range(9))
    # actual clamps inside each split
    assert [x["actual_2day"] for x in rows] == [9, 15, 20, 18, 21, 21, 21, 24, 24]
    for x in rows:
        assert abs(x["forecast_2day"] - (x["value"] + x["DeltaZ1"] + x["DeltaZ2"])) < 1e-9


def test_blocked_path_equals_plain_path(spark):
    p = events_by_type(spark, SF_MID)
    plain = forecast_panel(p, ForecastConfig(horizons=3, lags=2, hot_series_rows=None))
    blocked = forecast_panel(p, ForecastConfig(horizons=3, lags=2, hot_series_rows=0, block_rows=97,
                                               rows_per_partition=900))
    _same(plain.predictions, blocked.predictions)
    _same(plain.metrics, blocked.metrics)


def test_mixed_hot_and_plain_series(spark):
    p = events_by_type(spark, SF_SMALL).unionByName(events_single(spark, SF_SMALL))
    plain = forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=None))
    mixed = forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=500, block_rows=64,
                                             rows_per_partition=200))
    _same(plain.predictions, mixed.predictions)


def test_many_series_equal_each_alone(spark):
    p = events_by_user(spark, SF_SMALL)
    together = forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=None)).predictions
    keys = [r[0] for r in p.select("series_id").distinct().limit(3).collect()]
    for k in keys:
        alone = forecast_panel(p.where(F.col("series_id") == k), ForecastConfig(horizons=2, lags=1)).predictions
        _same(together.where(F.col("series_id") == k), alone)


def test_undifferencing_true_changes_gives_level(spark):
    from panelcast.plans.forecast import build_features

    cfg = ForecastConfig(horizons=3, lags=0, hot_series_rows=None)
    f, _, _ = build_features(events_by_type(spark, SF_SMALL), cfg)
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("ts", "tiebreak")
    x = f.select("*", F.lead("value", 3).over(w).alias("v3"))
    bad = x.where(F.col("v3").isNotNull() & (F.abs(F.col("value") + F.col("label_1") + F.col("label_2")
                                                   + F.col("label_3") - F.col("v3")) > 1e-9))
    assert bad.count() == 0


def test_metrics_match_mllib_evaluator(spark):
    p = events_by_type(spark, SF_SMALL)
    r = forecast_panel(p, ForecastConfig(horizons=1, lags=2, hot_series_rows=None))
    f = r.features.join(r.metrics.select("series_id").distinct(), "series_id")
    scored = r.scored
    key = p.select("series_id").first()[0]
    test = scored.where((F.col("series_id") == key) & F.col("test_1"))
    ev = RegressionEvaluator(labelCol="label_1", predictionCol="DeltaZ1")
    m = r.metrics.where((F.col("series_id") == key) & (F.col("split") == "test")).first()
    assert abs(m["rmse"] - ev.setMetricName("rmse").evaluate(test)) < 1e-9
    assert abs(m["r2"] - ev.setMetricName("r2").evaluate(test)) < 1e-9
    assert m["n"] == test.count()
    assert f.count() > 0


@pytest.mark.parametrize("regressor", [DECISION_TREE, RANDOM_FOREST])
def test_tree_predictions_within_label_range(spark, regressor):
    p = events_by_type(spark, SF_SMALL)
    r = forecast_panel(p, ForecastConfig(horizons=2, lags=2, regressor=regressor, seed=3, hot_series_rows=None))
    lo, hi = r.features.where("train_1").agg(F.min("label_1"), F.max("label_1")).first()
    pl, ph = r.predictions.agg(F.min("DeltaZ1"), F.max("DeltaZ1")).first()
    assert lo - 1e-6 <= pl and ph <= hi + 1e-6  # labels are summed in millionths


def test_tree_fixed_seed_reproducible(spark):
    p = events_by_type(spark, SF_SMALL)
    cfg = ForecastConfig(horizons=1, lags=1, regressor=RANDOM_FOREST, seed=11, hot_series_rows=None)
    a = forecast_panel(p, cfg).predictions
    b = forecast_panel(p, cfg).predictions
    _same(a, b)


@pytest.mark.parametrize("regressor", [DECISION_TREE, RANDOM_FOREST, GBT])
def test_tree_models_do_not_depend_on_layout_or_heat(spark, regressor):
    p = events_by_type(spark, SF_SMALL).unionByName(events_single(spark, SF_SMALL).withColumn("series_id", F.lit(None).cast("string")))
    cfg = dict(horizons=2, lags=1, regressor=regressor, seed=5)
    plain = forecast_panel(p, ForecastConfig(hot_series_rows=None, **cfg)).predictions
    mixed = forecast_panel(p.repartition(7), ForecastConfig(hot_series_rows=500, block_rows=64, rows_per_partition=200, **cfg)).predictions
    named = lambda x: x.withColumn("series_id", F.coalesce("series_id", F.lit("null")))
    _same(named(plain), named(mixed))
    assert plain.where("DeltaZ1 is null or DeltaZ2 is null").count() == 0
    assert plain.where("series_id is null").count() > 900


def test_one_tree_model_per_series_at_any_number_of_series(spark):
    p = events_by_user(spark, SF_SMALL)
    r = forecast_panel(p, ForecastConfig(horizons=2, lags=2, regressor=DECISION_TREE))
    assert r.models.count() == 2 * p.select("series_id").distinct().count()
    pooled = forecast_panel(p, ForecastConfig(horizons=2, lags=2, regressor=DECISION_TREE, tree_mode="pooled"))
    assert pooled.models.count() == 2 and pooled.predictions.count() == r.predictions.count()
    # a model of its own fits a series at least as closely as the shared one
    fit = lambda x: x.metrics.where("split = 'train'").agg(F.avg("r2")).first()[0]
    assert fit(r) > fit(pooled)


def test_a_tree_equals_a_greedy_one_by_hand():
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 32, size=(300, 3)), rng.integers(-1000, 1000, size=300).astype(float)

    def split(rows, depth):
        if depth == 5 or len(rows) < 2:
            return {tuple(rows): y[rows].mean()}
        best = (1e-9, None)
        for f in range(3):
            for b in range(31):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if len(left) and len(right):
                    gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[rows].sum() ** 2 / len(rows)
                    if gain > best[0]:
                        best = (gain, (left, right))
        if best[1] is None:
            return {tuple(rows): y[rows].mean()}
        return split(best[1][0], depth + 1) | split(best[1][1], depth + 1)

    label = (y * 2**20).astype(np.int64)
    feature, at, value = trees.grow(bins, np.ones((300, 2), np.int64), np.stack([label, label], axis=1))
    leaf = trees.leaf_of(bins, feature, at)
    assert (leaf[:, 0] == leaf[:, 1]).all()
    got = {tuple(np.flatnonzero(leaf[:, 0] == k)): value[1, k] / 2**20 for k in set(leaf[:, 0].tolist())}
    want = split(np.arange(300), 0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("regressor", [DECISION_TREE, RANDOM_FOREST, GBT])
def test_a_group_grown_by_parts_has_the_trees_of_the_whole(monkeypatch, regressor):
    rng = np.random.default_rng(8)
    bins, y = rng.integers(0, 32, size=(700, 4)).astype(np.int8), rng.integers(-(2**32), 2**32, size=700)
    w = None if regressor == DECISION_TREE else trees.weights(rng.integers(0, 2**32, size=(700, trees.TREES)), regressor).astype(np.int8)
    whole = trees.fit_rows(regressor, bins, y, w, 3)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 64)
    for a, b in zip(whole, trees.fit_rows(regressor, bins, y, w, 3), strict=True):
        assert (a == b).all()


def test_a_long_group_takes_little_memory():
    """nothing as long as the group's rows times its trees is held in eight bytes a number."""
    import tracemalloc

    import pyarrow as pa

    rows, rng = 60_000, np.random.default_rng(9)
    table = pa.table({"grp": pa.array(["a"] * rows), "bins": pa.array(list(rng.integers(0, 32, size=(rows, 4)).astype(np.int8)), pa.list_(pa.int8())),
                      "y": pa.array(list(rng.integers(-(2**32), 2**32, size=(rows, 1))), pa.list_(pa.int64())),
                      "draws": pa.array([d.tobytes() for d in rng.integers(0, 2**32, size=(rows, trees.TREES), dtype=np.uint32)], pa.binary())})
    fit = trees._fit_group(RANDOM_FOREST, 4, [1], 7)
    tracemalloc.start()
    out = fit((pa.scalar("a"),), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 1 and most < 30e6, most  # 60,000 x 20 weights of eight bytes are 9.6 MB; ten such arrays were held


def test_a_pass_over_a_long_groups_chunks_takes_the_memory_of_one():
    """what a task makes in a level's pass is as long as a chunk, however many chunks the group has."""
    import tracemalloc

    import pyarrow as pa

    rows, p, depth, rng = 50_000, 4, 4, np.random.default_rng(12)
    bins, y = rng.integers(0, 32, size=(rows, p)).astype(np.int8), rng.integers(-(2**32), 2**32, size=rows)
    draws = rng.integers(0, 2**32, size=(rows, trees.TREES), dtype=np.uint32)
    table = pa.table({"grp": pa.array(["a"] * rows), "bins": pa.array(list(bins), pa.list_(pa.int8())),
                      "y": pa.array(list(y[:, None]), pa.list_(pa.int64())), "draws": pa.array([d.astype(">u4").tobytes() for d in draws], pa.binary())})
    feature, at = rng.integers(-1, p, size=(trees.TREES, trees.INNER)), rng.integers(0, 31, size=(trees.TREES, trees.INNER))
    state = {"horizon": 1, "feature": feature.tobytes(), "at": at.tobytes(), "value": np.zeros((trees.TREES, trees.LEAVES), np.int64).tobytes()}
    chunks = []

    def given():
        for chunk in trees._chunks(RANDOM_FOREST, p, 1, trees.CHUNK_ROWS)(iter(table.to_batches(max_chunksize=10_000))):
            chunks.append(chunk.num_rows)
            yield chunk.append_column("trees", pa.array([[state]]))

    tracemalloc.start()
    got = list(trees._partials(RANDOM_FOREST, p, [1], depth, 0)(given()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and chunks == [1] * -(-rows // trees.CHUNK_ROWS)
    w = trees.weights(draws.astype(np.int64), RANDOM_FOREST)
    want = trees.histograms(bins, trees.leaf_of(bins, feature, at, depth), w, w * y[:, None], 2**depth)
    for c, v in zip(("n", "s"), want, strict=True):
        assert got[0].column(c)[0].as_py() == v.tobytes()
    assert most < 30e6, most  # one array of rows x trees is 8 MB, and several were held


def test_histograms_of_many_tasks_are_added_up_as_they_come(spark):
    """a level's step holds the histograms of some tasks, not of all, whose number grows with the table."""
    import tracemalloc

    import pyarrow as pa

    p, depth, tasks = 4, 4, 200
    rng = np.random.default_rng(10)
    n = rng.integers(0, 9, size=(trees.TREES, 2**depth, p, trees.BINS))
    s, empty = n * rng.integers(-9, 9, size=n.shape), [np.full((trees.TREES, trees.INNER), -1), *[np.zeros((trees.TREES, k), np.int64) for k in (trees.INNER, trees.LEAVES)]]
    names = ["grp", "horizon", "n", "s", "feature", "at", "value"]

    def rows(*columns):
        kinds = (pa.string(), pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(columns, kinds, strict=True)], names=names)

    def given():
        for i in range(tasks):
            if i == tasks // 2:  # the trees so far come anywhere
                yield rows("a", 1, None, None, *[x.tobytes() for x in empty])
            yield rows("a", 1, n.tobytes(), s.tobytes(), None, None, None)

    step = trees._advanced(RANDOM_FOREST, p, depth, 0, 7)
    tracemalloc.start()
    got = list(step((pa.scalar("a"), pa.scalar(1)), given()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    here = slice(2**depth - 1, 2 ** (depth + 1) - 1)
    feature, at = trees.best_splits(tasks * n, tasks * s, trees.allowed_features(p, 7)[:, here])
    assert (np.frombuffer(got[0].column("feature")[0].as_py(), np.int64).reshape(-1, trees.INNER)[:, here] == feature).all()
    value = trees.leaf_values(*trees.split_sums(tasks * n, tasks * s, feature, at), 1.0)
    assert (np.frombuffer(got[0].column("value")[0].as_py(), np.int64).reshape(-1, trees.LEAVES) == value).all()
    assert most < 20e6, most  # all of them are 131 MB

    # what Spark hands over: no more rows of a key at once than chunks
    def lengths(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    with trees._few_records(spark):
        sizes = [r.rows for r in spark.range(0, 100, 1, 4).groupBy(F.col("id") < 0).applyInArrow(lengths, "rows bigint").collect()]
    assert sum(sizes) == 100 and max(sizes) <= trees.BATCH_CHUNKS


def test_masks_lead_to_the_leaf_of_the_walk():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, size=(500, 4))
    feature, at = rng.integers(-1, 4, size=(20, trees.INNER)), rng.integers(0, 31, size=(20, trees.INNER))
    masks = trees.masks_of(feature, at, 4)
    left = np.full((500, 20), 2**31 - 1)
    for j in range(4):
        left &= masks[:, j, :].T[bins[:, j]]
    leaf = trees.leaf_of(bins, feature, at)
    assert (left == np.where(leaf > 0, 1 << np.maximum(leaf - 1, 0), 0)).all()


def _fitted(spark, panel, regressor, **kw):
    cfg = ForecastConfig(horizons=2, lags=2, regressor=regressor, seed=5, hot_series_rows=None, **kw)
    return {(r.grp, r.horizon): (r.feature, r.at, r.value) for r in forecast_panel(panel, cfg).models.collect()}


@pytest.mark.parametrize("regressor", [DECISION_TREE, RANDOM_FOREST, GBT])
def test_groups_larger_than_a_task_get_the_same_trees(spark, monkeypatch, regressor):
    if regressor == GBT:
        monkeypatch.setattr(trees, "TREES", 3)  # each round is several passes
    p = events_by_type(spark, SF_SMALL).where("series_id in ('click', 'view')").unionByName(events_single(spark, SF_SMALL))
    whole = _fitted(spark, p, regressor)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 150)  # 'all' is packed into chunks, the others are not
    assert _fitted(spark, p.repartition(5), regressor) == whole
    monkeypatch.setattr(trees, "BROADCAST_BYTES", 0)
    if regressor == RANDOM_FOREST:
        assert _fitted(spark, p, regressor) == whole


@pytest.mark.parametrize("regressor", [DECISION_TREE, RANDOM_FOREST])
def test_trees_do_not_depend_on_scale(spark, regressor):
    p = events_by_type(spark, SF_SMALL)
    whole = _fitted(spark, p, regressor)
    for factor in (1e-8, 1e8):
        scaled = _fitted(spark, p.withColumn("value", F.col("value") * factor), regressor)
        assert {k: v[:2] for k, v in scaled.items()} == {k: v[:2] for k, v in whole.items()}
        far = max(abs(a - b) for k, v in scaled.items() for a, b in zip(v[2], whole[k][2]))
        assert far <= 16  # of 2**32 parts of the largest label


def test_a_null_series_is_a_series_of_its_own(spark):
    p = events_by_type(spark, SF_SMALL)
    n = p.where("series_id = 'view'").count()
    null = p.withColumn("series_id", F.when(F.col("series_id") != "view", F.col("series_id")))
    for hot in (None, n - 1, 0):
        r = forecast_panel(null, ForecastConfig(horizons=2, lags=1, hot_series_rows=hot, block_rows=50, rows_per_partition=70))
        got = r.predictions.withColumn("series_id", F.coalesce("series_id", F.lit("view")))
        _same(got, forecast_panel(p, ForecastConfig(horizons=2, lags=1, hot_series_rows=None)).predictions)


def test_predictions_hold_every_row_that_a_horizon_scored(spark):
    p = events_by_type(spark, SF_SMALL).withColumn("value", F.when(F.col("tiebreak") % 5 != 1, F.col("value")))
    r = forecast_panel(p, ForecastConfig(horizons=3, lags=1, hot_series_rows=None))
    want = {h: r.metrics.where(F.col("horizon") == h).agg(F.sum("n")).first()[0] for h in (1, 2, 3)}
    assert {h: r.predictions.where(f"DeltaZ{h} is not null").count() for h in (1, 2, 3)} == want
    with r.computed() as (predictions, metrics):
        _same(predictions, r.predictions)
        _same(metrics, r.metrics)


def test_unknown_regressor_rejected():
    with pytest.raises(ValueError):
        ForecastConfig(regressor="ARIMA")


def test_a_transformer_of_ones_own_is_a_generator(spark):
    from panelcast.operators.features import SeriesTransformer
    from panelcast.plans.forecast import GENERATORS, generator_of, register_generator

    class Highest(SeriesTransformer):
        """Highest and lowest value of the current and 2 n previous rows."""

        def getFeatureNames(self):
            return [f"{self.getInputCol()}_{kind}" for kind in ("high", "low")]

        def _columns(self, w):
            frame = w.rowsBetween(-2 * self.getLagLength(), 0)
            return [f(self.getInputCol()).over(frame).alias(n) for f, n in zip((F.max, F.min), self.getFeatureNames())]

        def _reach(self):
            return 2 * self.getLagLength(), 0

    register_generator("highest", generator_of(Highest))
    try:
        cfg = dict(horizons=2, lags=1, generators=(("highest", 3), ("moving_average", 2)))
        p = events_by_type(spark, SF_SMALL)
        plain = forecast_panel(p, ForecastConfig(hot_series_rows=None, **cfg))
        blocked = forecast_panel(p, ForecastConfig(hot_series_rows=0, block_rows=20, rows_per_partition=70, **cfg))
        _same(plain.predictions, blocked.predictions)
        row = plain.features.where("diff_high is not null").orderBy(F.desc("ts")).first()
        before = p.where((F.col("series_id") == row["series_id"]) & (F.col("ts") <= F.lit(row["ts"]))).orderBy(F.desc("ts"), F.desc("tiebreak")).limit(8).collect()
        changes = [a["value"] - b["value"] for a, b in zip(before, before[1:])]
        assert row["diff_high"] == max(changes) and row["diff_low"] == min(changes)
        assert len(plain.coefficients.first()["coefficients"]) == 5
    finally:
        del GENERATORS["highest"]
    with pytest.raises(ValueError):
        ForecastConfig(generators=(("highest", 3),))
