"""DuckDB SQL oracles for the registered queries.

Written from the operator definitions, not from the Spark code: plain
window SQL for the features and split, and the closed-form one-feature
elastic net (standardised, population moments) for the linear fit, which is
exact when the model has one feature (lags = 0).  Tables are the driver's
pre-registered views.  Aggregated / fitted doubles are rounded to 6
decimals, like the Spark side; ``+ 0.0`` turns a rounded negative zero into
0.0, which is what Spark's decimal rounding returns.
"""

from __future__ import annotations

import math

H = 5
LAGS = 3
REG, ALPHA, RATIO = 0.4, 0.1, 0.7  # fixed values of the linear model and split

PANELS = {
    "events_by_type": "SELECT event_type AS series_id, ts, event_id AS tiebreak, value FROM events WHERE ts IS NOT NULL",
    "events_by_user": (
        "SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id AS tiebreak, value FROM events WHERE ts IS NOT NULL"
    ),
    "events_single": "SELECT 'all' AS series_id, ts, event_id AS tiebreak, value FROM events WHERE ts IS NOT NULL",
    # a null key that holds 40 % of the rows
    "events_mixed": (
        "SELECT CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS series_id, ts, event_id AS tiebreak, value "
        "FROM events WHERE ts IS NOT NULL"
    ),
    "events_gaps": (
        "SELECT event_type AS series_id, ts, event_id AS tiebreak, CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS value "
        "FROM events WHERE ts IS NOT NULL"
    ),
    # up to three quarters of the time
    "events_past": (
        "SELECT event_type AS series_id, ts, event_id AS tiebreak, value FROM events WHERE epoch_us(ts) <= "
        "(SELECT (min(epoch_us(ts)) + 3 * max(epoch_us(ts))) // 4 FROM events)"
    ),
    "orders_daily": (
        "SELECT o_orderpriority AS series_id, o_orderdate AS ts, CAST(0 AS BIGINT) AS tiebreak, "
        "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value "
        "FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_orderpriority, o_orderdate"
    ),
}

W = "PARTITION BY series_id ORDER BY ts, tiebreak"


def _ahead(h):
    return f"OVER ({W} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"


def _present(c):
    return f"({c} IS NOT NULL AND NOT isnan({c}))"


def features_ctes(panel: str, hs, lags: int, more: dict[str, str] | None = None, purge: bool = False, drop: bool = False) -> str:
    """CTEs ``panel, d, f, s``: features (``more``: name to SQL), labels, flags, split per horizon."""
    more = more or {}
    lag_cols = "".join(f", lag(diff, {i}) OVER ({W}) AS lag_{i}" for i in range(1, lags + 1))
    lag_cols += "".join(f", {c} AS {name}" for name, c in more.items())
    label_cols = "".join(f", {f'lead(diff, {h}) OVER ({W})' if drop else f'last_value(diff) {_ahead(h)}'} AS label_{h}" for h in hs)
    feats = ["value", "diff"] + [f"lag_{i}" for i in range(1, lags + 1)] + list(more)
    flags = "".join(
        f", (ts IS NOT NULL AND {' AND '.join(_present(c) for c in feats + [f'label_{h}'])}) AS c{h}"
        for h in hs
    )
    runs = "".join(
        f", CAST(sum(CAST(c{h} AS BIGINT)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS rn_{h}"
        f", CAST(sum(CAST(c{h} AS BIGINT)) OVER (PARTITION BY series_id) AS BIGINT) AS tot_{h}"
        for h in hs
    )
    splits = "".join(
        f", (c{h} AND rn_{h} <= floor(tot_{h} * {RATIO}::DOUBLE){f' - {h}' if purge else ''}) AS train_{h}"
        f", (c{h} AND rn_{h} > floor(tot_{h} * {RATIO}::DOUBLE)) AS test_{h}"
        for h in hs
    )
    return (
        f"panel AS ({PANELS[panel]}), "
        f"d AS (SELECT *, value - first_value(value) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS diff FROM panel), "
        f"f0 AS (SELECT *{lag_cols}{label_cols} FROM d), "
        f"f1 AS (SELECT *{flags} FROM f0), "
        f"f2 AS (SELECT *{runs} FROM f1), "
        f"s AS (SELECT *{splits} FROM f2)"
    )


def linear0_ctes(panel: str, hs) -> str:
    """Adds ``coef`` (long) and ``scored`` (with DeltaZ<h>) for the 1-feature model."""
    stats = " UNION ALL ".join(
        f"SELECT series_id, {h} AS horizon, count(label_{h}) FILTER (WHERE train_{h}) AS n, "
        f"avg(label_{h}) FILTER (WHERE train_{h}) AS my, var_pop(label_{h}) FILTER (WHERE train_{h}) AS vy, "
        f"avg(diff) FILTER (WHERE train_{h}) AS mx, var_pop(diff) FILTER (WHERE train_{h}) AS vx, "
        f"covar_pop(diff, label_{h}) FILTER (WHERE train_{h}) AS cxy FROM s GROUP BY series_id"
        for h in hs
    )
    lam = f"({REG} / sqrt(vy))"
    b = (f"CASE WHEN vx > 0 AND vy > 0 THEN sign(cxy / (sqrt(vx) * sqrt(vy))) * "
         f"greatest(abs(cxy / (sqrt(vx) * sqrt(vy))) - {ALPHA} * {lam}, 0) / (1 + {1 - ALPHA} * {lam}) "
         f"* (sqrt(vy) / sqrt(vx)) ELSE 0 END")
    coef = (f"coef AS (SELECT series_id, horizon, n AS n_train, "
            f"CASE WHEN n > 0 THEN my - ({b}) * mx END AS intercept, CASE WHEN n > 0 THEN {b} END AS coef "
            f"FROM ({stats}))")
    wide = ", ".join(
        f"max(intercept) FILTER (WHERE horizon = {h}) AS i{h}, max(coef) FILTER (WHERE horizon = {h}) AS b{h}"
        for h in hs
    )
    dz = ", ".join(f"i{h} + b{h} * diff AS DeltaZ{h}" for h in hs)
    return (
        f"{coef}, coefw AS (SELECT series_id, {wide} FROM coef GROUP BY series_id), "
        f"scored AS (SELECT s.*, {dz} FROM s LEFT JOIN coefw ON s.series_id IS NOT DISTINCT FROM coefw.series_id)"
    )


#: generated features of the change: mean of the current and two previous rows, sign against the previous row
GENERATED = {
    "ma_2": f"avg(diff) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "sign_1": f"CAST(sign(diff - lag(diff, 1) OVER ({W})) AS DOUBLE)",
}
CHANGE_RANGE = {
    "range_2": f"max(diff) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - min(diff) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"}
SWEEPS = 300  # of coordinate descent; every group of the test data is at its optimum long before


def linear_ctes(hs, lags: int, more=()) -> str:
    """Adds ``coef`` and ``scored`` for the model with lags: coordinate descent over the moments, as a recursion."""
    feats = ["diff"] + [f"lag_{i}" for i in range(1, lags + 1)] + list(more)
    p = len(feats)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    stats = " UNION ALL ".join(
        f"SELECT series_id, {h} AS horizon, count(*) AS n, avg(label_{h}) AS my, sqrt(var_pop(label_{h})) AS sy, "
        + ", ".join([f"avg({f}) AS mx{j}, sqrt(var_pop({f})) AS sx{j}, covar_pop({f}, label_{h}) AS xy{j}" for j, f in enumerate(feats)]
                    + [f"covar_pop({feats[j]}, {feats[k]}) AS xx{j}_{k}" for j, k in pairs])
        + f" FROM s WHERE train_{h} GROUP BY series_id"
        for h in hs
    )
    norm = ", ".join([f"xy{j} / (sx{j} * sy) AS r{j}" for j in range(p)]
                     + [f"xx{j}_{k} / (sx{j} * sx{k}) AS c{j}_{k}" for j, k in pairs if j != k])
    names = [f"b{j}" for j in range(p)]
    steps = []
    for j in range(p):  # the coefficients before j are this sweep's
        others = " - ".join([""] + [f"m.c{min(j, k)}_{max(j, k)} * {f'n{k}' if k < j else f'it.b{k}'}" for k in range(p) if k != j])
        steps.append(f"(m.r{j}{others}) AS z{j}, sign(z{j}) * greatest(abs(z{j}) - {ALPHA} * {REG} / m.sy, 0) "
                     f"/ (1 + {1 - ALPHA} * {REG} / m.sy) AS n{j}")
    same = "it.series_id IS NOT DISTINCT FROM m.series_id AND it.horizon = m.horizon"
    coef = ", ".join([f"b{j} * sy / sx{j} AS coef_{j}" for j in range(p)])
    wide = ", ".join(f"max(intercept) FILTER (WHERE horizon = {h}) AS i{h}, "
                     + ", ".join(f"max(coef_{j}) FILTER (WHERE horizon = {h}) AS w{h}_{j}" for j in range(p)) for h in hs)
    dz = ", ".join(f"i{h}" + "".join(f" + w{h}_{j} * {f}" for j, f in enumerate(feats)) + f" AS DeltaZ{h}" for h in hs)
    return (
        f"st AS ({stats}), m AS (SELECT *, {norm} FROM st), "
        f"it(series_id, horizon, i, {', '.join(names)}) AS (SELECT series_id, horizon, 0, {', '.join('0::DOUBLE' for _ in names)} FROM m "
        f"UNION ALL SELECT series_id, horizon, i + 1, {', '.join(f'n{j}' for j in range(p))} FROM "
        f"(SELECT it.series_id, it.horizon, it.i, {', '.join(steps)} FROM it JOIN m ON {same} WHERE it.i < {SWEEPS})), "
        f"raw AS (SELECT m.series_id, m.horizon, m.n, m.my, {', '.join(f'm.mx{j}' for j in range(p))}, {coef} "
        f"FROM it JOIN m ON {same} WHERE it.i = {SWEEPS}), "
        f"coef AS (SELECT *, my - ({' + '.join(f'coef_{j} * mx{j}' for j in range(p))}) AS intercept FROM raw), "
        f"coefw AS (SELECT series_id, {wide} FROM coef GROUP BY series_id), "
        f"scored AS (SELECT s.*, {dz} FROM s LEFT JOIN coefw ON s.series_id IS NOT DISTINCT FROM coefw.series_id)"
    )


#: Fixed values of the tree models: cut points in deviations, cumulated Poisson(0.8) chances in 2**32 parts.
TREE_CUTS = (
    "[-1.862731867, -1.534120544, -1.318010897, -1.15034938, -1.009990169, -0.887146559, -0.776421761, -0.67448975, -0.579132162, "
    "-0.488776411, -0.402250065, -0.318639364, -0.237202109, -0.157310685, -0.078412413, 0.0, 0.078412413, 0.157310685, 0.237202109, "
    "0.318639364, 0.402250065, 0.488776411, 0.579132162, 0.67448975, 0.776421761, 0.887146559, 1.009990169, 1.15034938, 1.318010897, "
    "1.534120544, 1.862731867]")


def _poisson_sql() -> str:
    """How often a row counts in a forest's tree, from a draw u below 2**32."""
    return "(" + " + ".join(
        f"CASE WHEN u >= CAST('{sum(math.exp(-0.8) * 0.8 ** i / math.factorial(i) for i in range(k + 1)) * 2**32!r}' AS DOUBLE) THEN 1 ELSE 0 END"
        for k in range(8)) + ")"


def tree_ctes(kind: str, seed: int):
    """Adds ``scored`` for depth-5 trees grown level by level: ``kind`` is "tree", "forest" (20 trees) or "gbt" (20 rounds)."""
    def ctes(hs, lags: int) -> str:
        feats = ["diff"] + [f"lag_{i}" for i in range(1, lags + 1)]
        p, bs = len(feats), ", ".join(f"b{j}" for j in range(lags + 1))
        trains = " OR ".join(f"train_{h}" for h in hs)
        moments = ", ".join(f"stddev_pop({f}) AS d{j}, CASE WHEN stddev_pop({f}) > 0 THEN round(avg({f}) / stddev_pop({f}), 6) ELSE 0.0 END AS m{j}"
                            for j, f in enumerate(feats))
        largest = ", ".join(f"CASE WHEN train_{h} THEN abs(label_{h}) END" for h in hs)
        bins = ", ".join(f"len(list_filter({TREE_CUTS}, lambda z: z < CASE WHEN d{j} > 0 THEN s.{f} / d{j} - m{j} ELSE 0.0 END)) AS b{j}"
                         for j, f in enumerate(feats))
        long = " UNION ALL ".join(
            f"SELECT series_id, ts, tiebreak, {h} AS horizon, train_{h} AS tr, unit, CAST(floor(label_{h} / unit * 4294967296.0 + 0.5) AS BIGINT) AS y, "
            f"{bs} FROM binned WHERE " + " AND ".join(_present(f) for f in feats) for h in hs)
        drawn = (f"SELECT r.*, t.t, CAST(concat('0x', substr(md5(concat('k', series_id, '|', epoch_us(ts), '|', tiebreak, '|', {seed}, '|', t.t // 4)), "
                 f"1 + 8 * (t.t % 4), 8)) AS BIGINT) AS u FROM rows0 r, range(20) t(t)")
        weight = {"tree": "1", "forest": _poisson_sql(), "gbt": "CASE WHEN u < 0.8 * 4294967296.0 THEN 1 ELSE 0 END"}[kind]
        out = [
            f"scales AS MATERIALIZED (SELECT series_id, {moments}, CASE WHEN max(greatest({largest}, 0.0)) > 0 THEN max(greatest({largest}, 0.0)) ELSE 1.0 END AS unit "
            f"FROM s WHERE {trains} GROUP BY series_id)",
            f"binned AS MATERIALIZED (SELECT s.*, unit, {bins} FROM s JOIN scales t ON s.series_id IS NOT DISTINCT FROM t.series_id)",
            f"rows0 AS MATERIALIZED ({long})",
            "drawn AS MATERIALIZED (" + ("SELECT *, 0 AS t, 0 AS u FROM rows0" if kind == "tree" else drawn) + ")",
            f"weighted AS MATERIALIZED (SELECT * EXCLUDE (u), {weight} AS w FROM drawn)",
            f"allowed AS MATERIALIZED (SELECT t, node, f FROM (SELECT t, node, f, row_number() OVER (PARTITION BY t, node ORDER BY "
            f"md5(concat(t, '|', node, '|', f, '|', {seed})), f) AS k FROM range(20) t(t), range(31) n(node), range({p}) f(f)) "
            f"WHERE k <= {math.ceil(p / 3)})",
        ]
        key = "series_id, horizon, t"

        def grown(name: str, source: str, step: str) -> str:
            """CTEs name_0 .. name_5 (rows with their node) and name_v (leaves' values)."""
            out.append(f"{name}_0 AS MATERIALIZED (SELECT *, 0 AS node FROM {source})")
            for d in range(5):
                hist = " UNION ALL ".join(f"SELECT {key}, node, {j} AS f, b{j} AS b, sum(w) AS n, sum(w * y) AS x FROM {name}_{d} WHERE tr GROUP BY ALL"
                                          for j in range(p))
                own = f"PARTITION BY {key}, node, f"
                cumulated = (f"SELECT *, CAST(sum(n) OVER ({own} ORDER BY b) AS DOUBLE) AS nl, CAST(sum(x) OVER ({own} ORDER BY b) AS DOUBLE) AS sl, "
                             f"CAST(sum(n) OVER ({own}) AS DOUBLE) AS na, CAST(sum(x) OVER ({own}) - sum(x) OVER ({own} ORDER BY b) AS DOUBLE) AS sr FROM ({hist})")
                apart = "(sl * (na - nl) - sr * nl)"
                gains = (f"SELECT {key}, node, f, b, {apart} * {apart} / (nl * (na - nl) * na) AS gain FROM ({cumulated}) WHERE nl > 0 AND na > nl"
                         + (" AND (t, node, f) IN (SELECT (t, node, f) FROM allowed)" if kind == "forest" else ""))
                out.append(f"{name}_s{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, node ORDER BY gain DESC, f, b) AS k "
                           f"FROM ({gains})) WHERE k = 1 AND gain > 0)")
                here = " ".join(f"WHEN p.f = {j} AND r.b{j} > p.b THEN 1" for j in range(p))
                out.append(f"{name}_{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), 2 * r.node + 1 + CASE {here} ELSE 0 END AS node FROM {name}_{d} r "
                           f"LEFT JOIN {name}_s{d} p ON r.series_id IS NOT DISTINCT FROM p.series_id AND r.horizon = p.horizon AND r.t = p.t AND r.node = p.node)")
            out.append(f"{name}_v AS MATERIALIZED (SELECT {key}, node, CAST(floor(CAST(sum(w * y) AS DOUBLE) / CAST(sum(w) AS DOUBLE) * {step} + 0.5) AS BIGINT) AS v "
                       f"FROM {name}_5 WHERE tr GROUP BY ALL HAVING sum(w) > 0)")
            return (f"{name}_5 r LEFT JOIN {name}_v v ON r.series_id IS NOT DISTINCT FROM v.series_id AND r.horizon = v.horizon AND r.t = v.t AND r.node = v.node")

        if kind == "gbt":
            for t in range(20):
                label = "y" if t == 0 else "2 * (w.y - l.so_far)"
                source = f"(SELECT w.* EXCLUDE (y), {label} AS y FROM weighted w WHERE t = 0)" if t == 0 else (
                    f"(SELECT w.* EXCLUDE (y), {label} AS y FROM weighted w JOIN so{t - 1} l ON w.series_id IS NOT DISTINCT FROM l.series_id "
                    f"AND w.ts = l.ts AND w.tiebreak = l.tiebreak AND w.horizon = l.horizon WHERE w.t = {t})")
                joined = grown(f"r{t}", source, "1.0" if t == 0 else "0.1")
                before = "" if t == 0 else (f" JOIN so{t - 1} l ON r.series_id IS NOT DISTINCT FROM l.series_id AND r.ts = l.ts AND r.tiebreak = l.tiebreak "
                                            f"AND r.horizon = l.horizon")
                out.append(f"so{t} AS MATERIALIZED (SELECT r.series_id, r.ts, r.tiebreak, r.horizon, r.unit, {'' if t == 0 else 'l.so_far + '}coalesce(v.v, 0) AS so_far "
                           f"FROM {joined}{before})")
            out.append("told AS (SELECT series_id, ts, tiebreak, horizon, CAST(so_far AS DOUBLE) * (unit / 4294967296.0) AS v FROM so19)")
        else:
            mean = " / 20.0" if kind == "forest" else ""
            joined = grown("r", "weighted", "1.0")
            out.append(f"told AS (SELECT r.series_id, ts, tiebreak, r.horizon, CAST(sum(coalesce(v.v, 0)) AS DOUBLE){mean} * (any_value(unit) / 4294967296.0) AS v "
                       f"FROM {joined} GROUP BY r.series_id, ts, tiebreak, r.horizon)")
        dz = ", ".join(f"max(v) FILTER (WHERE horizon = {h}) AS DeltaZ{h}" for h in hs)
        out += [
            f"dz AS (SELECT series_id, ts, tiebreak, {dz} FROM told GROUP BY ALL)",
            "scored AS (SELECT s.*, " + ", ".join(f"dz.DeltaZ{h}" for h in hs) + " FROM s LEFT JOIN dz "
            "ON s.series_id IS NOT DISTINCT FROM dz.series_id AND s.ts = dz.ts AND s.tiebreak = dz.tiebreak)",
        ]
        return ", ".join(out)

    return ctes


def predictions_ctes(hs, digits: int = 6) -> str:
    """Adds ``pred``: output rows with row_number, split, forecasts and actuals.

    A row complete at any horizon is in it; its side is that of the first
    horizon's boundary; what a horizon lacks is null.
    """
    h0 = hs[0]
    some = " OR ".join(f"c{h}" for h in hs)
    acts = ", ".join(
        f"last_value(value) OVER (PARTITION BY series_id, split ORDER BY ts, tiebreak "
        f"ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) AS act_{h}"
        for h in hs
    )
    cols = []
    run = "value"
    for h in hs:
        run = f"{run} + DeltaZ{h}"
        cols += [
            f"CASE WHEN c{h} THEN (round(DeltaZ{h}, {digits}) + 0.0) END AS DeltaZ{h}",
            f"CASE WHEN c{h} THEN (round({run}, {digits}) + 0.0) END AS forecast_{h}day",
            f"CASE WHEN c{h} THEN act_{h} END AS actual_{h}day",
        ]
    return (
        f"o AS (SELECT *, CASE WHEN rn_{h0} <= floor(tot_{h0} * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM scored "
        f"WHERE {some}), "
        f"o2 AS (SELECT *, row_number() OVER ({W}) - 1 AS row_number, {acts} FROM o), "
        f"pred AS (SELECT series_id, ts, tiebreak, row_number, split, value, {', '.join(cols)} FROM o2)"
    )


def forecast_sql(panel: str, hs=range(1, H + 1), digits: int = 6, **options) -> str:
    hs = list(hs)
    return (f"WITH {features_ctes(panel, hs, 0, **options)}, {linear0_ctes(panel, hs)}, {predictions_ctes(hs, digits)} "
            f"SELECT * FROM pred")


def forecast_lags_sql(panel: str, hs, lags: int, model=linear_ctes) -> str:
    hs = list(hs)
    return f"WITH RECURSIVE {features_ctes(panel, hs, lags)}, {model(hs, lags)}, {predictions_ctes(hs)} SELECT * FROM pred"


def _normal_sql(z: str) -> str:
    """The normal distribution function by Simpson's rule."""
    term = f"CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power({z} * i / 2000.0, 2) / 2)"
    return f"(0.5 + {z} / 6000.0 * list_sum([{term} FOR i IN range(2001)]) / sqrt(2 * pi()))"


def _mackinnon_sql(stat: str, n: str) -> str:
    """p_value and critical values of a Dickey-Fuller statistic with a constant (MacKinnon's fixed values)."""
    small = f"(2.1659 + 1.4412 * {stat} + 0.038269 * {stat} * {stat})"
    large = f"(1.7339 + 0.93202 * {stat} - 0.12745 * power({stat}, 2) - 0.010368 * power({stat}, 3))"
    p = (f"CASE WHEN {stat} > 2.74 THEN 1.0 WHEN {stat} < -18.83 THEN 0.0 WHEN {stat} <= -1.61 THEN {_normal_sql(small)} "
         f"ELSE {_normal_sql(large)} END")
    crit = {"1pct": (-3.43035, -6.5393, -16.786, -79.433), "5pct": (-2.86154, -2.8903, -4.234, -40.040), "10pct": (-2.56677, -1.5384, -2.809, 0.0)}
    cols = [f"round({a} + ({b}) / {n} + ({c}) / power({n}, 2) + ({d}) / power({n}, 3), 6) AS crit_{k}" for k, (a, b, c, d) in crit.items()]
    return f"round({p}, 6) AS p_value, {', '.join(cols)}"


def _ols_ctes(name: str, source: str, lags: int) -> str:
    """CTE ``name``: n, slope, sxx, syy of dy on y1 in ``source``, both freed of a constant and of l1..l<lags>, one after another."""
    out, last = [], source
    for i in range(1, lags + 1):
        rest = [f"l{k}" for k in range(i + 1, lags + 1)] + ["y1", "dy"]
        freed = ", ".join(f"{c} - regr_intercept({c}, l{i}) OVER w - regr_slope({c}, l{i}) OVER w * l{i} AS {c}" for c in rest)
        out.append(f"{name}_{i} AS (SELECT series_id, {freed} FROM {last} WINDOW w AS (PARTITION BY series_id))")
        last = f"{name}_{i}"
    out.append(f"{name} AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n, regr_slope(dy, y1) AS slope, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy "
               f"FROM {last} GROUP BY series_id)")
    return ", ".join(out)


def _lagged_rows(lags: int) -> str:
    lag_cols = "".join(f", lag(dy, {i}) OVER ({W}) AS l{i}" for i in range(1, lags + 1))
    return (f"panel AS ({PANELS['events_by_type']}), r AS (SELECT *, value - lag(value) OVER ({W}) AS dy, lag(value) OVER ({W}) AS y1, "
            f"row_number() OVER ({W}) - 1 AS t FROM panel), rows_ AS (SELECT *{lag_cols} FROM r)")


def _stat(lags) -> str:
    return f"slope / sqrt((syy - slope * slope * sxx) / (n - {lags} - 2) / sxx)"


def adf_sql(lags: int) -> str:
    """Fixed lag order."""
    return (f"WITH {_lagged_rows(lags)}, used AS (SELECT * FROM rows_ WHERE t >= {lags + 1}), {_ols_ctes('o', 'used', lags)}, "
            f"st AS (SELECT series_id, n, {lags} AS lags, {_stat(lags)} AS s FROM o) "
            f"SELECT series_id, n, CAST(lags AS INTEGER) AS lags, round(s, 6) + 0.0 AS stat, {_mackinnon_sql('s', 'n')} FROM st")


def autolag_sql(top: int) -> str:
    """Lag order 0..top by AIC on the common sample, then that order's own sample (series long enough for ``top``)."""
    common = ", ".join(_ols_ctes(f"a{i}", "common", i) for i in range(top + 1))
    own = ", ".join(f"u{i} AS (SELECT * FROM rows_ WHERE t >= {i + 1}), {_ols_ctes(f'b{i}', f'u{i}', i)}" for i in range(top + 1))
    aics = " UNION ALL ".join(
        f"SELECT series_id, {i} AS lags, n * ln(2 * pi()) + n * ln((syy - slope * slope * sxx) / n) + n + 2 * ({i} + 2) AS aic FROM a{i}" for i in range(top + 1))
    finals = " UNION ALL ".join(f"SELECT series_id, {i} AS lags, n, {_stat(i)} AS s FROM b{i}" for i in range(top + 1))
    return (f"WITH {_lagged_rows(top)}, common AS (SELECT * FROM rows_ WHERE t >= {top + 1}), {common}, {own}, "
            f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY aic, lags) AS k FROM ({aics})) WHERE k = 1), "
            f"st AS (SELECT f.*, aic FROM ({finals}) f JOIN best b ON f.series_id IS NOT DISTINCT FROM b.series_id AND f.lags = b.lags) "
            f"SELECT series_id, n, CAST(lags AS INTEGER) AS lags, round(s, 6) + 0.0 AS stat, {_mackinnon_sql('s', 'n')}, round(aic, 6) AS aic FROM st")


def new_rows_sql(hs, lags: int) -> str:
    """The linear model of the past applied to the later rows, with features over all rows."""
    feats = ["diff"] + [f"lag_{i}" for i in range(1, lags + 1)]
    lag_cols = "".join(f", lag(diff, {i}) OVER ({W}) AS lag_{i}" for i in range(1, lags + 1))
    cols, running = [], "value"
    for h in hs:
        delta = f"(i{h}" + "".join(f" + w{h}_{j} * {f}" for j, f in enumerate(feats)) + ")"
        running = f"{running} + {delta}"
        cols += [f"round({delta}, 6) + 0.0 AS DeltaZ{h}", f"round({running}, 6) + 0.0 AS forecast_{h}day"]
    return (
        f"WITH RECURSIVE {features_ctes('events_past', hs, lags)}, {linear_ctes(hs, lags)}, every AS ({PANELS['events_by_type']}), "
        f"changes AS (SELECT *, value - first_value(value) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS diff FROM every), "
        f"lagged AS (SELECT *{lag_cols} FROM changes) "
        f"SELECT lagged.series_id, ts, tiebreak, value, {', '.join(cols)} FROM lagged LEFT JOIN coefw ON lagged.series_id IS NOT DISTINCT FROM coefw.series_id "
        f"WHERE epoch_us(ts) > (SELECT (min(epoch_us(ts)) + 3 * max(epoch_us(ts))) // 4 FROM events)")


def _with_forecast(panel: str, hs, tail: str) -> str:
    hs = list(hs)
    return f"WITH {features_ctes(panel, hs, 0)}, {linear0_ctes(panel, hs)}, {predictions_ctes(hs)} {tail}"


def metrics_sql(panel: str, metric_cols: str, hs=range(1, H + 1)) -> str:
    hs = list(hs)
    parts = []
    for h in hs:
        for split in ("train", "test"):
            e2 = f"power(label_{h} - DeltaZ{h}, 2)"
            parts.append(
                f"SELECT series_id, {h} AS horizon, '{split}' AS split, count(*) AS n, "
                f"CASE WHEN count(*) > 0 THEN sqrt(sum({e2}) / count(*)) END AS rmse, "
                f"CASE WHEN count(*) * var_pop(label_{h}) > 0 THEN 1 - sum({e2}) / (count(*) * var_pop(label_{h})) END AS r2 "
                f"FROM scored WHERE {split}_{h} GROUP BY series_id"
            )
    return (f"WITH {features_ctes(panel, hs, 0)}, {linear0_ctes(panel, hs)}, m AS ({' UNION ALL '.join(parts)}) "
            f"SELECT {metric_cols} FROM m")


def _simple(panel: str, body: str) -> str:
    return f"WITH panel AS ({PANELS[panel]}) {body}"


def oracle_queries() -> dict[str, str]:
    hs = list(range(1, H + 1))
    lagv = ", ".join(f"lag(value, {i}) OVER ({W}) AS value_LagBy_{i}" for i in range(1, LAGS + 1))
    signs = ", ".join(
        f"CAST(sign(value - lag(value, {i}) OVER ({W})) AS DOUBLE) AS value_Lag_{i}_Sign" for i in range(1, LAGS + 1)
    )
    diff = f"value - first_value(value) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
    labels = ", ".join(f"last_value(diff) {_ahead(h)} AS label_{h}" for h in hs)
    f_h1 = (
        f"WITH panel AS ({PANELS['events_by_type']}), d AS (SELECT *, {diff} AS diff FROM panel), "
        f"f AS (SELECT *, {', '.join(f'lag(diff, {i}) OVER ({W}) AS diff_LagBy_{i}' for i in range(1, LAGS + 1))}, "
        f"last_value(diff) {_ahead(1)} AS label FROM d), "
        f"cc AS (SELECT * FROM f WHERE ts IS NOT NULL AND "
        f"{' AND '.join(_present(c) for c in ['value', 'diff', 'label'] + [f'diff_LagBy_{i}' for i in range(1, LAGS + 1)])} "
        f"AND series_id IS NOT NULL AND tiebreak IS NOT NULL)"
    )
    one_h = 2
    f1 = features_ctes("events_by_type", [one_h], 0)
    l1 = linear0_ctes("events_by_type", [one_h])
    fu = features_ctes("events_by_user", [1], 0)
    lu = linear0_ctes("events_by_user", [1])
    long_rows = " UNION ALL ".join(
        f"SELECT series_id, ts, tiebreak, split, {h} AS horizon, 'forecast' AS kind, forecast_{h}day AS value FROM pred "
        f"UNION ALL SELECT series_id, ts, tiebreak, split, {h} AS horizon, 'actual' AS kind, (round(actual_{h}day, 6) + 0.0) AS value FROM pred"
        for h in hs
    )
    undiff = " UNION ALL ".join(f"SELECT series_id, ts, tiebreak, value, {h} AS horizon, label_{h} AS dz FROM lab" for h in hs)
    df_rows = (
        f"WITH panel AS ({PANELS['events_by_type']}), r AS (SELECT series_id, value - lag(value) OVER ({W}) AS dy, "
        f"lag(value) OVER ({W}) AS y1 FROM panel), "
        f"a AS (SELECT series_id, CAST(regr_count(dy, y1) AS BIGINT) AS n, regr_slope(dy, y1) AS slope, regr_sxx(dy, y1) AS sxx, "
        f"regr_syy(dy, y1) AS syy FROM r WHERE y1 IS NOT NULL GROUP BY series_id), "
        f"v AS (SELECT *, (syy - slope * slope * sxx) / (n - 2) / sxx AS var FROM a) "
        f"SELECT series_id, n, (round(slope, 6) + 0.0) AS slope, "
        f"(round(CASE WHEN n > 2 AND sxx > 0 AND var > 0 THEN slope / sqrt(var) END, 6) + 0.0) AS stat FROM v"
    )
    return {
        "scan_panel": PANELS["events_by_type"],
        "scan_orders_daily": PANELS["orders_daily"],
        "scan_csv": PANELS["events_by_type"],
        "scan_vendor_files": PANELS["events_by_user"],
        "project_series": "SELECT event_type AS series_id, ts, value FROM events",
        "series_counts": _simple("events_by_user", "SELECT series_id, count(*) AS n_rows FROM panel GROUP BY series_id"),
        "preview_first_k": _simple(
            "events_by_user",
            f"SELECT series_id, ts, tiebreak, value, row_number FROM "
            f"(SELECT *, row_number() OVER ({W}) - 1 AS row_number FROM panel) WHERE row_number < 2",
        ),
        "difference": _simple("events_by_type", f"SELECT *, {diff} AS diff FROM panel"),
        "lag_features": _simple("events_by_user", f"SELECT *, {lagv} FROM panel"),
        "moving_average": _simple(
            "events_by_type",
            f"SELECT *, (round(avg(value) OVER ({W} ROWS BETWEEN {LAGS} PRECEDING AND CURRENT ROW), 6) + 0.0) "
            f"AS value_{LAGS}_MovingAvg FROM panel",
        ),
        "trend_sign": _simple("events_by_type", f"SELECT *, {signs} FROM panel"),
        "lead_label": _simple(
            "events_by_type", f"SELECT *, {labels} FROM (SELECT *, {diff} AS diff FROM panel)"
        ),
        "row_index": _simple("events_by_type", f"SELECT *, row_number() OVER ({W}) - 1 AS row_number FROM panel"),
        "row_index_blocked": _simple("events_single", f"SELECT *, row_number() OVER ({W}) - 1 AS row_number FROM panel"),
        "lag_features_blocked": (
            f"WITH panel AS ({PANELS['events_single']}), d AS (SELECT *, {diff} AS diff FROM panel) "
            f"SELECT series_id, ts, tiebreak, value, diff, "
            f"{', '.join(f'lag(diff, {i}) OVER ({W}) AS lag_{i}' for i in range(1, LAGS + 1))}, {labels} FROM d"
        ),
        "complete_cases": f"{f_h1} SELECT * FROM cc",
        "time_split": (
            f"{f_h1}, t AS (SELECT *, row_number() OVER ({W}) - 1 AS row_number, "
            f"count(*) OVER (PARTITION BY series_id) AS n_rows FROM cc) "
            f"SELECT series_id, ts, tiebreak, row_number, n_rows, "
            f"CASE WHEN row_number <= floor(n_rows * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM t"
        ),
        "actual_at_horizon": _simple(
            "events_by_type",
            f", t AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM panel), "
            f"u AS (SELECT *, CASE WHEN rn <= floor(n * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM t) "
            f"SELECT series_id, ts, tiebreak, split, value, "
            + ", ".join(
                f"last_value(value) OVER (PARTITION BY series_id, split ORDER BY ts, tiebreak "
                f"ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) AS actual_{h}day"
                for h in hs
            )
            + " FROM u",
        ).replace(") , t AS", "), t AS"),
        "fit_linear": (
            f"WITH {features_ctes('events_by_type', hs, 0)}, {linear0_ctes('events_by_type', hs)} "
            f"SELECT series_id, horizon, n_train, (round(intercept, 6) + 0.0) AS intercept, (round(coef, 6) + 0.0) AS coef FROM coef"
        ),
        "forecast_panel": forecast_sql("events_by_type"),
        "forecast_users": forecast_sql("events_by_user"),
        "forecast_orders": forecast_sql("orders_daily", digits=2),
        "forecast_blocked": forecast_sql("events_single"),
        "forecast_one": (
            f"WITH {f1}, {l1} SELECT series_id, ts, tiebreak, rn_{one_h} AS row_number, "
            f"CASE WHEN train_{one_h} THEN 'train' ELSE 'test' END AS split, value, diff, label_{one_h} AS label, "
            f"(round(DeltaZ{one_h}, 6) + 0.0) AS prediction FROM scored WHERE c{one_h}"
        ),
        "score_linear": (
            f"WITH {fu}, {lu} SELECT series_id, ts, tiebreak, CASE WHEN train_1 THEN 'train' ELSE 'test' END AS split, "
            f"label_1 AS label, (round(DeltaZ1, 6) + 0.0) AS prediction FROM scored WHERE c1"
        ),
        "metric_rmse": metrics_sql("events_by_type", "series_id, horizon, split, n, (round(rmse, 6) + 0.0) AS rmse"),
        "metric_r2": metrics_sql("events_by_type", "series_id, horizon, split, n, (round(r2, 6) + 0.0) AS r2"),
        "metric_table": (
            metrics_sql("events_by_type", "*").replace(" SELECT * FROM m", "")
            + " SELECT series_id, "
            + ", ".join(f"(round(max(rmse) FILTER (WHERE horizon = {h} AND split = 'test'), 6) + 0.0) AS forecast_{h}day" for h in hs)
            + " FROM m GROUP BY series_id"
        ),
        "forecast_long": _with_forecast("events_by_type", hs, long_rows),
        "forecast_chart": _with_forecast("events_by_type", hs, (
            f", long AS ({long_rows}), spans AS (SELECT series_id, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM pred GROUP BY series_id) "
            f"SELECT long.series_id, split, horizon, kind, (epoch_us(ts) - t0) * 100 // (t1 - t0 + 1) AS pixel, count(*) AS points, "
            f"min(ts) AS first_ts, arg_min(value, (ts, tiebreak)) AS first, max(ts) AS last_ts, arg_max(value, (ts, tiebreak)) AS last, "
            f"min(value) AS low, max(value) AS high FROM long JOIN spans ON long.series_id IS NOT DISTINCT FROM spans.series_id "
            f"WHERE value IS NOT NULL GROUP BY ALL")),
        "undifference": (
            f"WITH panel AS ({PANELS['events_by_type']}), d AS (SELECT *, {diff} AS diff FROM panel), "
            f"lab AS (SELECT *, {labels} FROM d), lg AS ({undiff}) "
            f"SELECT series_id, ts, tiebreak, value, horizon, value + sum(dz) OVER (PARTITION BY series_id, ts, tiebreak "
            f"ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forecast FROM lg"
        ),
        "sink_roundtrip": forecast_sql("events_by_type"),
        "difference_mixed_heat": _simple("events_mixed", f"SELECT *, {diff} AS diff FROM panel"),
        "time_split_mixed_heat": _simple(
            "events_mixed",
            f", t AS (SELECT *, row_number() OVER ({W}) - 1 AS row_number, count(*) OVER (PARTITION BY series_id) AS n_rows FROM panel) "
            f"SELECT series_id, ts, tiebreak, row_number, n_rows, "
            f"CASE WHEN row_number <= floor(n_rows * {RATIO}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM t",
        ).replace(") , t AS", "), t AS"),
        "forecast_mixed_heat": forecast_sql("events_mixed"),
        "forecast_nulls": forecast_sql("events_gaps"),
        "forecast_linear_lags": forecast_lags_sql("events_by_type", hs, LAGS),
        "forecast_single_series": forecast_lags_sql("events_single", range(1, 7), 4),
        "forecast_tree": forecast_lags_sql("events_by_type", hs, LAGS, tree_ctes("tree", 7)),
        "forecast_forest": forecast_lags_sql("events_by_type", hs, LAGS, tree_ctes("forest", 7)),
        "forecast_gbt": forecast_lags_sql("events_by_type", hs, LAGS, tree_ctes("gbt", 7)),
        "forecast_purged": forecast_sql("events_by_type", purge=True),
        "forecast_tail_drop": forecast_sql("events_by_type", drop=True),
        "forecast_own_generator": (
            f"WITH RECURSIVE {features_ctes('events_by_type', hs, 1, CHANGE_RANGE)}, {linear_ctes(hs, 1, CHANGE_RANGE)}, {predictions_ctes(hs)} SELECT * FROM pred"),
        "forecast_generators": (
            f"WITH RECURSIVE {features_ctes('events_by_type', hs, 1, GENERATED)}, {linear_ctes(hs, 1, GENERATED)}, "
            f"{predictions_ctes(hs)} SELECT * FROM pred"
        ),
        "metric_price_level": _with_forecast(
            "events_by_type", hs,
            " UNION ALL ".join(
                f"SELECT series_id, {h} AS horizon, split, count(*) AS n, (round(sqrt(avg(power(f{h} - act_{h}, 2))), 6) + 0.0) AS rmse, "
                f"(round(CASE WHEN var_pop(act_{h}) > 0 THEN 1 - avg(power(f{h} - act_{h}, 2)) / var_pop(act_{h}) END, 6) + 0.0) AS r2 "
                f"FROM (SELECT *, value + {' + '.join(f'DeltaZ{k}' for k in range(1, h + 1))} AS f{h} FROM o2) WHERE c{h} GROUP BY series_id, split"
                for h in hs)),
        "join_predictions": _with_forecast(
            "events_by_type", hs,
            "SELECT p.series_id, p.ts, p.tiebreak, p.value, q.row_number, q.split, "
            + ", ".join(f"q.forecast_{h}day" for h in hs)
            + " FROM panel p LEFT JOIN pred q ON p.series_id IS NOT DISTINCT FROM q.series_id AND p.ts = q.ts AND p.tiebreak = q.tiebreak"),
        "metric_sink_roundtrip": (
            metrics_sql("events_by_type", "*").replace(" SELECT * FROM m", "")
            + " SELECT series_id AS Ticker, split, "
            + ", ".join(f"(round(max(r2) FILTER (WHERE horizon = {h}), 6) + 0.0) AS forecast_{h}day" for h in hs)
            + " FROM m GROUP BY series_id, split"
        ),
        "legacy_csv_roundtrip": _with_forecast(
            "events_single", hs,
            "SELECT row_number AS \"Row Number\", ts AS \"Date\", value AS \"Close\", "
            + ", ".join(f"DeltaZ{h}, forecast_{h}day, actual_{h}day" for h in hs) + ", split FROM pred"),
        "feature_vectors": (
            f"WITH {features_ctes('events_by_user', [2], LAGS)} SELECT series_id, ts, tiebreak, value, diff AS x0, "
            + ", ".join(f"lag_{i} AS x{i}" for i in range(1, LAGS + 1)) + ", label_2 AS label, CASE WHEN train_2 THEN 'train' ELSE 'test' END AS split FROM s WHERE c2"),
        "score_new_rows": new_rows_sql(hs, LAGS),
        "stationarity_df": df_rows,
        "stationarity_adf": adf_sql(2),
        "stationarity_autolag_bounded": autolag_sql(3),
    }
