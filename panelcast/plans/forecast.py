"""The multi-horizon forecast as one lazy Spark plan over a panel.

Per series (all series at once)::

    diff_t      = value_t - value_(t-1)          (0 on the first row)
    lag_i       = diff_(t-i), i = 1..lags        (features: diff, lag_1..lag_n)
    label_h     = diff_(t+h), clamped at the series end, h = 1..horizons
    complete_h  = no null/NaN among value, diff, lags, label_h
    rn_h        = position among complete_h rows; N_h their count
    train_h     = complete_h and rn_h <= floor(N_h * 0.7)  (k+1 rows), else test
    DeltaZh     = model_h(features)              (predicted diff h rows ahead)
    forecast_h  = value + DeltaZ1 + ... + DeltaZh
    actual_h    = value h rows ahead inside the same split, clamped at its end

Horizons are columns of one wide row instead of H separate frames joined on a
row number, so the whole forecast is one pass over the data: one shuffle by
series for all windows, one aggregation for all linear fits, one (broadcast
or co-partitioned) join of the coefficients.  Series longer than
``hot_series_rows`` go through the blocked windows of
``operators.ordered`` so no task ever holds a whole hot series.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.series import (
    actual_name,
    all_present,
    clamped_lead,
    delta_name,
    difference,
    forecast_name,
    lag,
    moving_average,
    trend_sign,
)
from panelcast.operators import ordered
from panelcast.operators.linear import (
    coefficients_report,
    coefficients_wide,
    fit_grouped_linear,
    linear_prediction,
)
from panelcast.operators.metrics import wide_metrics
from panelcast.operators.trees import LINEAR, REGRESSORS, fit_score_trees
from panelcast.sources.panel import ORDER, PANEL_COLUMNS, SERIES, TIEBREAK, TS, VALUE

SPLIT_RATIO = 0.7  # fixed value: first 70 % of each series trains


@dataclass(frozen=True)
class ForecastConfig:
    horizons: int = 5
    lags: int = 3
    regressor: str = LINEAR
    split_ratio: float = SPLIT_RATIO
    reg_param: float = 0.4
    elastic_net: float = 0.1
    tree_mode: str = "per_series"  # or "pooled": one model for all series
    seed: int | None = None
    # series with more rows than this take the blocked (skew-safe) path;
    # None disables the check, 0 sends every series through it
    hot_series_rows: int | None = 5_000_000
    block_rows: int = 1_000_000
    rows_per_partition: int = 2_000_000
    # more features of the differenced series next to its lags: ("moving_average", n) is the mean of
    # the current and n previous rows, ("trend_sign", n) the signs against the n previous rows;
    # register_generator() adds kinds
    generators: tuple[tuple[str, int], ...] = ()
    # rows before the split boundary whose label lies beyond it do not train (the last h rows at horizon h)
    purge_gap: bool = False
    # "clamp": the last h rows of a series take its last value as label; "drop": they have none
    tail: str = "clamp"
    # False: ``value`` is already the series to model (no first difference);
    # the "diff" column is then the value itself
    difference: bool = True

    def __post_init__(self):
        if self.regressor not in REGRESSORS:
            raise ValueError(f"unknown regressor {self.regressor!r}; one of {REGRESSORS}")
        if self.tail not in ("clamp", "drop"):
            raise ValueError(f"unknown tail {self.tail!r}; 'clamp' or 'drop'")
        if any(kind not in GENERATORS or n < 1 for kind, n in self.generators):
            raise ValueError(f"generators are ({' | '.join(GENERATORS)}, n >= 1), not {self.generators!r}")
        if self.horizons < 1 or self.lags < 0:
            raise ValueError("horizons >= 1 and lags >= 0 required")


@dataclass(frozen=True)
class Generator:
    """A kind of features that a :class:`ForecastConfig` names as ``(kind, n)``.

    ``columns(n, col, w)`` gives named window expressions of the column ``col``
    over ``w``, ``names(n)`` their names, ``reach(n)`` how many rows of ``col``
    they look back at most; they look at no later row.  The reach sets the halo
    of the blocked path and the history that a fitted model keeps.
    """

    columns: Callable[[int, str, WindowSpec], dict[str, Column]]
    names: Callable[[int], list[str]]
    reach: Callable[[int], int] = lambda n: n


GENERATORS: dict[str, Generator] = {
    "moving_average": Generator(lambda n, c, w: {f"ma_{n}": moving_average(c, n, w)}, lambda n: [f"ma_{n}"]),
    "trend_sign": Generator(lambda n, c, w: {f"sign_{i}": trend_sign(c, i, w) for i in range(1, n + 1)},
                            lambda n: [f"sign_{i}" for i in range(1, n + 1)]),
}


def register_generator(kind: str, generator: Generator) -> None:
    """Makes ``(kind, n)`` a feature of forecasts; a process that loads a model with it registers it too."""
    if not isinstance(generator, Generator):
        raise TypeError("a Generator is wanted; generator_of() makes one of a transformer class")
    GENERATORS[kind] = generator


def generator_of(transformer) -> Generator:
    """The generator of a transformer class of ``operators.features`` (or a subclass of its ``SeriesTransformer``)."""
    def made(n: int, col: str = "diff"):
        return transformer(inputCol=col, lagLength=n)

    def columns(n: int, col: str, w: WindowSpec) -> dict[str, Column]:
        t = made(n, col)
        return dict(zip(t.getFeatureNames(), t._columns(w), strict=True))

    def reach(n: int) -> int:
        back, ahead = made(n)._reach()
        if ahead:
            raise ValueError("a feature must not look ahead")
        return back

    return Generator(columns, lambda n: made(n).getFeatureNames(), reach)


def feature_columns(lags: int, generators=()) -> list[str]:
    names = ["diff"] + [f"lag_{i}" for i in range(1, lags + 1)] + [name for kind, n in generators for name in GENERATORS[kind].names(n)]
    if len(set(names)) < len(names):
        raise ValueError(f"features of one name: {names}")
    return names


def _features_of(cfg: ForecastConfig) -> list[str]:
    return feature_columns(cfg.lags, cfg.generators)


def _back(cfg: ForecastConfig) -> int:
    """Rows that a feature looks back."""
    return max([cfg.lags, *[GENERATORS[kind].reach(n) for kind, n in cfg.generators]]) + 1


@dataclass
class ForecastResult:
    """Lazy tables of one forecast.

    Each table read on its own runs the plan behind it; to use several, go
    through :meth:`computed` (or :meth:`write`), which runs the forecast once.
    """

    predictions: DataFrame
    metrics: DataFrame
    features: DataFrame
    scored: DataFrame
    coefficients: DataFrame | None = None
    models: DataFrame | None = None
    outputs: DataFrame | None = None
    horizons: tuple = ()

    @contextmanager
    def computed(self):
        """``(predictions, metrics)`` from one run of the forecast.

        The output rows, with labels and flags of every horizon, are written
        once to the shared folder; both tables read that, and it is removed
        afterwards.
        """
        from panelcast.session import fresh_path, remove_path

        spark = self.outputs.sparkSession
        path = fresh_path(spark, "forecast")
        self.outputs.write.parquet(path)
        try:
            out = spark.read.schema(self.outputs.schema).parquet(path)
            yield out.select(*self.predictions.columns), horizon_metrics(out, self.horizons)
        finally:
            remove_path(spark, path)

    def write(self, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
        """Write ``<path>/predictions`` (partitioned by split) and ``<path>/metrics`` from one run."""
        from panelcast.plans.report import write_metrics, write_predictions

        with self.computed() as (predictions, metrics):
            write_predictions(predictions, f"{path.rstrip('/')}/predictions", mode, fmt)
            write_metrics(metrics, f"{path.rstrip('/')}/metrics", mode, fmt)


def horizon_metrics(scored: DataFrame, hs) -> DataFrame:
    return wide_metrics(scored, {h: (f"label_{h}", delta_name(h), f"train_{h}", f"test_{h}") for h in hs})


# --- windows ---------------------------------------------------------------
def _local_features(x: DataFrame, w: WindowSpec, cfg: ForecastConfig, hs) -> DataFrame:
    """Bounded-frame part: reach ``_back(cfg)`` rows back, ``max(hs)`` ahead."""
    x = x.withColumn("diff", difference(VALUE, w) if cfg.difference else F.col(VALUE))
    cols = [lag("diff", i, w).alias(f"lag_{i}") for i in range(1, cfg.lags + 1)]
    cols += [c.alias(name) for kind, n in cfg.generators for name, c in GENERATORS[kind].columns(n, "diff", w).items()]
    ahead = clamped_lead if cfg.tail == "clamp" else (lambda c, h, w: F.lead(c, h).over(w))
    cols += [ahead("diff", h, w).alias(f"label_{h}") for h in hs]
    return x.select("*", *cols)


def _flag_exprs(cfg: ForecastConfig, hs) -> dict[str, Column]:
    base = [VALUE] + _features_of(cfg)
    return {f"c{h}": F.col(TS).isNotNull() & all_present(base + [f"label_{h}"]) for h in hs}


def _split_columns(x: DataFrame, hs, cfg: ForecastConfig) -> DataFrame:
    r = repr(float(cfg.split_ratio))
    cols = []
    for h in hs:
        comp, rn, k = f"c{h}_flag", f"(c{h}_cum - 1)", f"floor(c{h}_tot * CAST({r} AS DOUBLE))"
        cols += [
            f"CASE WHEN {comp} THEN {rn} END AS rn_{h}",
            f"({comp} AND {rn} <= {k}{f' - {h}' if cfg.purge_gap else ''}) AS train_{h}",
            f"({comp} AND {rn} > {k}) AS test_{h}",
        ]
    # output rows are complete at some horizon; their side is that of the shortest
    # horizon's boundary, so the sides of a series never interleave
    h0, some = hs[0], " OR ".join(f"c{h}_flag" for h in hs)
    side = f"CASE WHEN (c{h0}_cum - 1) <= floor(c{h0}_tot * CAST({r} AS DOUBLE)) THEN 'train' ELSE 'test' END"
    return x.selectExpr("*", *cols).selectExpr("*", f"({some}) AS _out", f"CASE WHEN {some} THEN {side} END AS split")


def _actual_columns(w: WindowSpec, hs) -> list[Column]:
    """``value`` h output rows ahead within the same split, clamped at its end.

    That is the last value of the row's own side within the next h output rows.
    """
    is_train = F.col("split") == "train"
    out = []
    for h in hs:
        frame = w.rowsBetween(0, h)
        in_train = F.last(F.when(is_train, F.col(VALUE)), ignorenulls=True).over(frame)
        in_test = F.last(F.when(~is_train, F.col(VALUE)), ignorenulls=True).over(frame)
        out.append(F.when(is_train, in_train).otherwise(in_test).alias(actual_name(h)))
    return out


# --- the two physical paths --------------------------------------------------
def _features_plain(panel: DataFrame, cfg: ForecastConfig, hs) -> DataFrame:
    w = ordered.series_window()
    x = _local_features(panel, w, cfg, hs)
    flags = _flag_exprs(cfg, hs)
    x = x.select("*", *[c.alias(f"{n}_flag") for n, c in flags.items()])
    x = ordered.running_counts_window(x, {n: F.col(f"{n}_flag") for n in flags}, w)
    x = x.withColumn(ordered.IDX, F.lit(None).cast("bigint")).withColumn(ordered.BLOCK, F.lit(None).cast("bigint"))
    return _split_columns(x, hs, cfg)


def _features_blocked(panel: DataFrame, cfg: ForecastConfig, hs, total_rows: int) -> DataFrame:
    x = ordered.index_rows(panel, total_rows, cfg.rows_per_partition)
    x = ordered.blocked_window(
        x, lambda d, w: _local_features(d, w, cfg, hs), ordered.IDX, cfg.block_rows, _back(cfg), max(hs)
    )
    flags = _flag_exprs(cfg, hs)
    x = x.select("*", *[c.alias(f"{n}_flag") for n, c in flags.items()])
    x = ordered.running_counts_blocked(x, {n: F.col(f"{n}_flag") for n in flags}, ordered.IDX)
    return _split_columns(x, hs, cfg)


def _outputs_plain(scored: DataFrame, hs) -> DataFrame:
    x = scored.where(F.col("_out"))
    w = Window.partitionBy(SERIES).orderBy(*ORDER)
    return x.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("row_number"), *_actual_columns(w, hs))


def _outputs_blocked(scored: DataFrame, hs, cfg: ForecastConfig) -> DataFrame:
    x = scored.where(F.col("_out"))
    x = ordered.running_counts_blocked(x, {"o": F.lit(True)}, ordered.IDX)
    x = x.withColumn("row_number", F.col("o_cum") - 1).drop("o_cum", "o_tot")
    return ordered.blocked_window(
        x, lambda d, w: d.select("*", *_actual_columns(w, hs)), "row_number", cfg.block_rows, 0, max(hs)
    )


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def build_feature_pieces(panel: DataFrame, cfg: ForecastConfig, hs) -> list[tuple[DataFrame, bool]]:
    """``[(features, blocked)]``: ordinary series and hot series, each keeping its partitioning.

    Their series key is encoded (``ordered.encode_key``), so that a null key
    meets its model like any other.
    """
    pieces = []
    panel = panel.select(*PANEL_COLUMNS)
    for part, blocked, rows in ordered.split_by_heat(panel, cfg.hot_series_rows):
        part = ordered.encode_key(part)
        f = _features_blocked(part, cfg, hs, rows) if blocked else _features_plain(part, cfg, hs)
        pieces.append((f.withColumn("_blocked", F.lit(blocked)), blocked))
    return pieces


def build_features(panel: DataFrame, cfg: ForecastConfig, hs=None):
    """Wide feature table for horizons ``hs`` (all pieces), the pieces' kinds, and ``hs``."""
    hs = list(hs or range(1, cfg.horizons + 1))
    pieces = build_feature_pieces(panel, cfg, hs)
    return ordered.decode_key(_union([f for f, _ in pieces])), [b for _, b in pieces], hs


def feature_vectors(panel: DataFrame, horizon: int, cfg: ForecastConfig | None = None, **overrides) -> DataFrame:
    """The panel as any MLlib regressor takes it: one row per row complete at ``horizon``.

    ``series_id, ts, tiebreak, value, features, label, split``: ``features`` is
    a dense vector in the order of :func:`feature_columns` (the change, its
    lags from 1, then each generator's columns as configured), ``label`` the
    change ``horizon`` rows ahead, ``split`` the row's side at that horizon.
    Fit on ``split = 'train'`` with the default column names.
    """
    from pyspark.ml.functions import array_to_vector

    cfg = replace(cfg or ForecastConfig(), **overrides)
    f, _, _ = build_features(panel, cfg, [horizon])
    x = F.array(*[F.col(c).cast("double") for c in _features_of(cfg)])
    return f.where(F.col(f"c{horizon}_flag")).select(
        SERIES, TS, TIEBREAK, VALUE, array_to_vector(x).alias("features"), F.col(f"label_{horizon}").cast("double").alias("label"),
        F.when(F.col(f"train_{horizon}"), "train").otherwise("test").alias("split"))


# --- fit and score -------------------------------------------------------------
def _score_linear(piece: DataFrame, blocked: bool, wide: DataFrame, fcols, hs) -> DataFrame:
    """Join the per-series coefficients without moving the piece's rows.

    Plain pieces are hash-partitioned by series: the join on ``series_id``
    shuffles only the coefficients (or AQE broadcasts them).  Blocked pieces
    are partitioned by ``(series_id, _blk)``: the coefficients are first
    expanded to one row per block (a table bounded by the number of blocks)
    and joined on both keys, so no hot series is gathered by the join.
    """
    if blocked:
        blocks = piece.select(SERIES, ordered.BLOCK).distinct()
        per_block = blocks.join(wide, SERIES, "left")
        x = piece.join(per_block, [SERIES, ordered.BLOCK], "left")
    else:
        x = piece.join(wide, SERIES, "left")
    return x.select(*piece.columns, *[linear_prediction(fcols, h).alias(delta_name(h)) for h in hs])


def fit_and_score_pieces(pieces, cfg: ForecastConfig, hs):
    """Fit on all pieces, score each piece in place.

    Returns ``(scored_pieces, coefficients, models)``.
    """
    fcols = _features_of(cfg)
    feats = _union([f for f, _ in pieces])
    if cfg.regressor == LINEAR:
        coefs = fit_grouped_linear(
            feats, fcols, {h: (f"label_{h}", f"train_{h}") for h in hs},
            reg_param=cfg.reg_param, elastic_net=cfg.elastic_net,
        )
        wide = coefficients_wide(coefs, hs, len(fcols))
        scored = [(_score_linear(f, b, wide, fcols, hs), b) for f, b in pieces]
        return scored, coefficients_report(coefs, len(fcols)), None
    scored, models = fit_score_trees(
        pieces, fcols, {h: (f"label_{h}", f"train_{h}", delta_name(h)) for h in hs},
        cfg.regressor, cfg.tree_mode, cfg.seed,
    )
    return scored, None, models


def forecast_panel(panel: DataFrame, cfg: ForecastConfig | None = None, **overrides) -> ForecastResult:
    """Forecast every series of ``panel`` at horizons 1..H.

    ``predictions``: ``series_id, ts, tiebreak, row_number, split, value`` and
    per horizon ``DeltaZ<h>, forecast_<h>day, actual_<h>day`` for every row that
    is complete at some horizon; at a horizon where it is not they are null.
    ``split`` is the row's side of the shortest horizon's boundary.
    ``metrics``: ``series_id, horizon, split, n, rmse, r2`` on the differenced
    label (the quantity each model predicts).
    """
    cfg = replace(cfg or ForecastConfig(), **overrides)
    hs = list(range(1, cfg.horizons + 1))
    pieces = build_feature_pieces(panel, cfg, hs)
    scored_pieces, coefs, models = fit_and_score_pieces(pieces, cfg, hs)
    scored = _union([s for s, _ in scored_pieces])
    metrics = horizon_metrics(scored, hs)
    # output windows per piece, before any union, so each reuses its partitioning
    out = _union([
        _outputs_blocked(s, hs, cfg) if b else _outputs_plain(s, hs) for s, b in scored_pieces
    ])
    cols = [SERIES, TS, TIEBREAK, "row_number", "split", VALUE]
    running = F.col(VALUE)
    for h in hs:
        running = running + F.col(delta_name(h))
        at = F.col(f"c{h}_flag")  # null where the row is not complete at this horizon
        cols += [F.when(at, F.col(delta_name(h))).alias(delta_name(h)), F.when(at, running).alias(forecast_name(h)),
                 F.when(at, F.col(actual_name(h))).alias(actual_name(h))]
    back = ordered.decode_key
    flags = [f"{c}_{h}" for h in hs for c in ("label", "train", "test")]
    outputs = back(out.select(*cols, *flags))
    return ForecastResult(back(out.select(*cols)), back(metrics), back(_union([f for f, _ in pieces])), back(scored),
                          None if coefs is None else back(coefs), models, outputs, tuple(hs))


def forecast_horizon(panel: DataFrame, horizon: int, cfg: ForecastConfig | None = None, **overrides):
    """One horizon on its own (the reference's single ``Forecast`` call).

    Returns ``(rows, metrics)``: every complete row with ``row_number``
    (0-based among complete rows), ``split``, features, ``label`` and
    ``prediction``; and the train/test metrics.
    """
    cfg = replace(cfg or ForecastConfig(), **overrides)
    hs = [horizon]
    scored_pieces, _, _ = fit_and_score_pieces(build_feature_pieces(panel, cfg, hs), cfg, hs)
    scored = _union([s for s, _ in scored_pieces])
    h = horizon
    rows = scored.where(F.col(f"c{h}_flag")).select(
        SERIES, TS, TIEBREAK, F.col(f"rn_{h}").alias("row_number"),
        F.when(F.col(f"train_{h}"), F.lit("train")).otherwise(F.lit("test")).alias("split"),
        VALUE, *_features_of(cfg), F.col(f"label_{h}").alias("label"),
        F.col(delta_name(h)).alias("prediction"),
    )
    metrics = horizon_metrics(scored, hs)
    return ordered.decode_key(rows), ordered.decode_key(metrics)
