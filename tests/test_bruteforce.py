"""Features, split and actuals against a brute-force per-series model.

Random panels (short and long series, nulls and NaNs, shuffled input
order) go through the plain per-series windows and through the blocked
hot-series path with tiny blocks; both must equal a direct Python
computation of the definitions.
"""
import math
import random

import pytest

from conftest import panel_from_rows
from panelcast import ForecastConfig
from panelcast.plans.forecast import _outputs_blocked, _outputs_plain, build_features

LAGS, H, RATIO = 2, 3, 0.7


def _present(v):
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def expected(values):
    """Per-row dict of the feature/split definitions for one series (list of values in time order)."""
    n = len(values)
    diff = []
    for t, v in enumerate(values):
        prev = values[t - 1] if t > 0 else v
        diff.append(None if (v is None or prev is None) else v - prev)
    rows = []
    for t in range(n):
        lags = [diff[t - i] if t - i >= 0 else None for i in range(1, LAGS + 1)]
        labels = [diff[min(t + h, n - 1)] for h in range(1, H + 1)]
        base = [values[t], diff[t]] + lags
        comp = [all(_present(x) for x in base + [labels[h]]) for h in range(H)]
        rows.append(dict(diff=diff[t], lags=lags, labels=labels, comp=comp))
    for h in range(H):
        idx = [t for t in range(n) if rows[t]["comp"][h]]
        k = math.floor(len(idx) * RATIO)
        for rn, t in enumerate(idx):
            rows[t].setdefault("rn", {})[h] = rn
            rows[t].setdefault("train", {})[h] = rn <= k
    firsts = [t for t in range(n) if rows[t]["comp"][0]]
    k = math.floor(len(firsts) * RATIO)
    out = []
    for t in range(n):
        if any(rows[t]["comp"]):
            out.append((t, "train" if sum(u <= t for u in firsts) - 1 <= k else "test"))
    actual = {}
    for pos, (t, split) in enumerate(out):
        same = [u for (u, s) in out if s == split]
        j = same.index(t)
        actual[t] = [values[same[min(j + h, len(same) - 1)]] for h in range(1, H + 1)]
    return rows, out, actual


def _random_panel(rng):
    rows = []
    for s in range(rng.randint(1, 4)):
        n = rng.choice([1, 2, 5, 17, 40, 90])
        for t in range(n):
            r = rng.random()
            v = None if r < 0.04 else (float("nan") if r < 0.07 else round(rng.uniform(-5, 5), 2))
            rows.append((f"s{s}", t, v))
    rng.shuffle(rows)
    return rows


def _eq(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return abs(a - b) < 1e-9


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("blocked", [False, True])
def test_features_split_actuals_match_bruteforce(spark, seed, blocked):
    rng = random.Random(seed)
    data = _random_panel(rng)
    panel = panel_from_rows(spark, data).repartition(3)
    cfg = ForecastConfig(horizons=H, lags=LAGS, hot_series_rows=0 if blocked else None,
                         block_rows=7, rows_per_partition=13)
    feats, paths, hs = build_features(panel, cfg)
    got = {(r["series_id"], r["tiebreak"]): r for r in feats.collect()}
    out_df = _outputs_blocked(feats, hs, cfg) if blocked else _outputs_plain(feats, hs)
    got_out = {(r["series_id"], r["tiebreak"]): r for r in out_df.collect()}

    series = {}
    for s, t, v in data:
        series.setdefault(s, {})[t] = v
    n_out = 0
    for s, by_t in series.items():
        values = [by_t[t] for t in sorted(by_t)]
        rows, out, actual = expected(values)
        for t, exp in enumerate(rows):
            g = got[(s, t)]
            assert _eq(g["diff"], exp["diff"]), (s, t)
            for i in range(LAGS):
                assert _eq(g[f"lag_{i + 1}"], exp["lags"][i]), (s, t, i)
            for h in range(H):
                assert _eq(g[f"label_{h + 1}"], exp["labels"][h]), (s, t, h)
                assert bool(g[f"c{h + 1}_flag"]) == exp["comp"][h], (s, t, h)
                if exp["comp"][h]:
                    assert g[f"rn_{h + 1}"] == exp["rn"][h]
                    assert bool(g[f"train_{h + 1}"]) == exp["train"][h]
        for pos, (t, split) in enumerate(out):
            g = got_out[(s, t)]
            assert g["split"] == split and g["row_number"] == pos, (s, t)
            for h in range(H):
                assert _eq(g[f"actual_{h + 1}day"], actual[t][h]), (s, t, h)
        n_out += len(out)
    assert len(got_out) == n_out
