"""Hand-worked series (FIXTURES.md) and edge cases for the window operators."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import panel_from_rows
from panelcast.operators.features import Differencer, LagFeatures, LeadLabel, MovingAverage, TrendSign
from panelcast.operators.split import complete_cases, time_split

Y = [10, 12, 12, 9, 15, 20, 18, 21, 25, 24]


def _col(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


@pytest.fixture(scope="module")
def hand(spark):
    return panel_from_rows(spark, [("a", t, y) for t, y in enumerate(Y)])


def test_clamped_lead(hand):
    out = LeadLabel(inputCol="value", outputCol="lead3", horizon=3).transform(hand)
    assert _col(out, "lead3") == [9, 15, 20, 18, 21, 25, 24, 24, 24, 24]


def test_difference_first_row_zero(hand):
    out = Differencer(inputCol="value").transform(hand)
    assert _col(out, "Diff_value") == [0, 2, 0, -3, 6, 5, -2, 3, 4, -1]


def test_trend_sign_ties_zero(hand):
    out = TrendSign(inputCol="value", lagLength=1).transform(hand)
    assert _col(out, "value_Lag_1_Sign") == [None, 1, 0, -1, 1, 1, -1, 1, 1, -1]


def test_moving_average_n_plus_one_rows(hand):
    out = MovingAverage(inputCol="value", lagLength=2).transform(hand)
    got = _col(out, "value_2_MovingAvg")
    want = [10, 11, 11.3333, 11, 12, 14.6667, 17.6667, 19.6667, 21.3333, 23.3333]
    assert all(abs(a - b) < 1e-4 for a, b in zip(got, want))


def test_lags_and_feature_names(hand):
    t = LagFeatures(inputCol="value", lagLength=2)
    out = t.transform(t.transform(hand).drop("value_LagBy_1", "value_LagBy_2"))
    assert t.getFeatureNames() == ["value_LagBy_1", "value_LagBy_2"]  # stateless
    assert _col(out, "value_LagBy_2") == [None, None] + Y[:-2]


def test_split_k_plus_one_train_rows(hand):
    out = time_split(hand)
    splits = _col(out, "split")
    assert splits.count("train") == 8 and splits.count("test") == 2


def test_split_n90_double_arithmetic(spark):
    p = panel_from_rows(spark, [("a", t, t) for t in range(90)])
    out = time_split(p)
    # int(90 * 0.7) == 62 in double arithmetic, so 63 train rows
    assert out.where("split = 'train'").count() == 63


def test_descending_input_order_is_reordered(spark):
    p = panel_from_rows(spark, [("a", t, y) for t, y in reversed(list(enumerate(Y)))])
    out = Differencer(inputCol="value").transform(p.repartition(3))
    assert _col(out, "Diff_value") == [0, 2, 0, -3, 6, 5, -2, 3, 4, -1]


def test_null_and_nan_dropped_by_complete_cases(spark):
    p = panel_from_rows(spark, [("a", 0, 1.0), ("a", 1, None), ("a", 2, float("nan")), ("a", 3, 4.0)])
    assert complete_cases(p).count() == 2


def test_null_predecessor_gives_null_difference(spark):
    p = panel_from_rows(spark, [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)])
    out = Differencer(inputCol="value").transform(p)
    assert _col(out, "Diff_value") == [0.0, None, None]


def test_single_row_and_constant_series(spark):
    p = panel_from_rows(spark, [("one", 0, 5.0)] + [("flat", t, 2.0) for t in range(5)])
    d = Differencer(inputCol="value").transform(p)
    lead = LeadLabel(inputCol="Diff_value", horizon=2).transform(d)
    one = lead.where("series_id = 'one'").collect()[0]
    assert one["Diff_value"] == 0.0 and one["label"] == 0.0
    assert {r["label"] for r in lead.where("series_id = 'flat'").collect()} == {0.0}
    s = TrendSign(inputCol="value", lagLength=1).transform(p).where("series_id = 'flat'")
    assert [r["value_Lag_1_Sign"] for r in s.orderBy("ts").collect()] == [None, 0.0, 0.0, 0.0, 0.0]


def test_empty_panel(spark):
    p = panel_from_rows(spark, [("a", 0, 1.0)]).where(F.lit(False))
    assert LagFeatures(inputCol="value", lagLength=3).transform(p).count() == 0
    assert time_split(p).count() == 0


def test_series_do_not_leak_into_each_other(spark):
    p = panel_from_rows(spark, [("a", t, t) for t in range(5)] + [("b", t, 100 + t) for t in range(5)])
    out = LagFeatures(inputCol="value", lagLength=1).transform(p)
    firsts = out.where("tiebreak = 0").collect()
    assert all(r["value_LagBy_1"] is None for r in firsts)
    assert not math.isnan(out.where("series_id = 'b' and tiebreak = 1").collect()[0]["value_LagBy_1"])


def test_transformers_blocked_path_equals_plain(spark):
    from conftest import SF_SMALL
    from panelcast.sources.panel import events_single

    p = events_single(spark, SF_SMALL)
    for make in (lambda hot: LagFeatures(inputCol="value", lagLength=3, hotSeriesRows=hot, blockRows=50),
                 lambda hot: MovingAverage(inputCol="value", lagLength=3, hotSeriesRows=hot, blockRows=50),
                 lambda hot: TrendSign(inputCol="value", lagLength=2, hotSeriesRows=hot, blockRows=50),
                 lambda hot: Differencer(inputCol="value", hotSeriesRows=hot, blockRows=50),
                 lambda hot: LeadLabel(inputCol="value", horizon=4, hotSeriesRows=hot, blockRows=50)):
        plain = make(-1).transform(p)
        blocked = make(0).transform(p)
        assert plain.exceptAll(blocked).count() == 0 and blocked.exceptAll(plain).count() == 0


def test_row_index_and_split_blocked_equal_plain(spark):
    from conftest import SF_SMALL
    from panelcast.operators.split import row_index
    from panelcast.sources.panel import events_by_type

    p = events_by_type(spark, SF_SMALL)
    for fn in (lambda hot: row_index(p, hot_series_rows=hot, rows_per_partition=90),
               lambda hot: time_split(p, hot_series_rows=hot, rows_per_partition=90)):
        a, b = fn(None), fn(0)
        assert a.count() == b.count() == p.count()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_the_sketch_proposes_every_hot_series(spark, monkeypatch):
    from panelcast.operators import ordered

    sizes = {**{f"k{i}": 3 + i % 40 for i in range(3000)}, "hot": 2500, "warm": 700, None: 1500}
    rows = spark.createDataFrame([(k, n) for k, n in sizes.items()], "series_id string, n int")
    panel = rows.selectExpr("series_id", "explode(sequence(1, n)) AS tiebreak").repartition(7)
    total = sum(sizes.values())
    for limit in (39, 41, 700, 699, 2000, total, None):
        heat = ordered.Heat.of(panel, limit)
        want = sorted(str(k) for k, n in sizes.items() if limit is not None and n > limit)
        keys = [] if heat.keys is None else [r[0] for r in ordered.decode_key(heat.keys.withColumnRenamed("_hot", "series_id")).collect()]
        assert sorted(map(str, keys)) == want
        assert heat.rows == sum(n for k, n in sizes.items() if str(k) in want)
    monkeypatch.setattr(ordered, "SKETCH_KEYS", 0)  # all keys are counted
    assert ordered.Heat.of(panel, 699).rows == 700 + 2500 + 1500
