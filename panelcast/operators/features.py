"""Feature generators as ``pyspark.ml`` Transformers.

Each transformer adds columns computed over the ordered rows of every
series (``partitionBy(seriesCol).orderBy(orderCols)``), so they compose in a
``Pipeline`` and run on any number of series at once.  All columns come out
of one ``select`` per transformer; Spark evaluates windows with the same
partitioning and order in one Window operator, after a single shuffle.
Series longer than ``hotSeriesRows`` are computed with the blocked windows of ``operators.ordered`` (same values, bounded tasks).

Output names keep the reference's contract:

=====================  ===================================
transformer            columns
=====================  ===================================
``LagFeatures``        ``<col>_LagBy_<i>``, i = 1..n
``MovingAverage``      ``<col>_<n>_MovingAvg`` (n+1 rows)
``TrendSign``          ``<col>_Lag_<i>_Sign``, i = 1..n
``Differencer``        ``Diff_<col>`` (or ``outputCol``)
``LeadLabel``          ``label`` (or ``outputCol``)
=====================  ===================================

``getFeatureNames`` is derived from the parameters, so transforming twice
does not grow it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window

from panelcast.functions import series as S
from panelcast.operators.ordered import apply_by_series, to_layout
from panelcast.sources.panel import ORDER, SERIES


class _SeriesParams(HasInputCol):
    lagLength = Param(Params._dummy(), "lagLength", "number of lagged steps / window size",
                      typeConverter=TypeConverters.toInt)
    seriesCol = Param(Params._dummy(), "seriesCol", "series key column",
                      typeConverter=TypeConverters.toString)
    orderCols = Param(Params._dummy(), "orderCols", "columns giving the order inside a series",
                      typeConverter=TypeConverters.toListString)
    hotSeriesRows = Param(Params._dummy(), "hotSeriesRows",
                          "series longer than this use the skew-safe blocked windows "
                          "(0: all series, negative: never)", typeConverter=TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "rows per block on the blocked path",
                      typeConverter=TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(lagLength=0, seriesCol=SERIES, orderCols=list(ORDER),
                         hotSeriesRows=5_000_000, blockRows=1_000_000)

    def setLagLength(self, value: int):
        return self._set(lagLength=value)

    def setInputCol(self, value: str):
        return self._set(inputCol=value)

    def setSeriesCol(self, value: str):
        return self._set(seriesCol=value)

    def setOrderCols(self, value):
        return self._set(orderCols=list(value))

    def getLagLength(self) -> int:
        return self.getOrDefault(self.lagLength)

    def _window(self):
        return Window.partitionBy(self.getOrDefault(self.seriesCol)).orderBy(
            *self.getOrDefault(self.orderCols)
        )


class SeriesTransformer(Transformer, _SeriesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the generators; a subclass gives ``getFeatureNames``, ``_columns(w)`` and, beyond ``lagLength`` rows, ``_reach``."""

    @keyword_only
    def __init__(self, *, inputCol=None, lagLength=None, seriesCol=None, orderCols=None,
                 hotSeriesRows=None, blockRows=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getFeatureNames(self) -> list[str]:
        """Names of the columns this transformer adds."""
        raise NotImplementedError

    def _columns(self, w):
        raise NotImplementedError

    def _reach(self) -> tuple[int, int]:
        """Rows the window looks back and ahead."""
        return self.getLagLength(), 0

    def _transform(self, df: DataFrame) -> DataFrame:
        def fn(d, w):
            return d.select("*", *self._columns(w))

        hot = self.getOrDefault(self.hotSeriesRows)
        if hot < 0:
            return fn(df, self._window())
        back, fwd = self._reach()
        x, restored = to_layout(df, [self.getOrDefault(self.seriesCol)], self.getOrDefault(self.orderCols))
        return restored(apply_by_series(x, fn, back, fwd, hot_series_rows=self._heat or hot,
                                        block_rows=self.getOrDefault(self.blockRows)))

    #: a ``Heat`` found before, for transformers of one chain
    _heat = None

    def setHeat(self, heat):
        """Use the hot series found once for a chain of transformers, instead of looking again."""
        self._heat = heat
        return self


class LagFeatures(SeriesTransformer):
    """``n`` lagged copies of the input column (null for the first i rows)."""

    def getFeatureNames(self):
        c = self.getInputCol()
        return [S.lag_name(c, i) for i in range(1, self.getLagLength() + 1)]

    def _columns(self, w):
        c = self.getInputCol()
        return [S.lag(c, i, w).alias(S.lag_name(c, i)) for i in range(1, self.getLagLength() + 1)]


class MovingAverage(SeriesTransformer):
    """Mean of the current and ``n`` previous rows (fewer at the series head)."""

    def getFeatureNames(self):
        return [S.moving_avg_name(self.getInputCol(), self.getLagLength())]

    def _columns(self, w):
        c, n = self.getInputCol(), self.getLagLength()
        return [S.moving_average(c, n, w).alias(S.moving_avg_name(c, n))]


class TrendSign(SeriesTransformer):
    """``signum(x_t - x_(t-i))`` for i = 1..n (+1 / -1, 0 on ties)."""

    def getFeatureNames(self):
        c = self.getInputCol()
        return [S.sign_name(c, i) for i in range(1, self.getLagLength() + 1)]

    def _columns(self, w):
        c = self.getInputCol()
        return [S.trend_sign(c, i, w).alias(S.sign_name(c, i)) for i in range(1, self.getLagLength() + 1)]


class Differencer(SeriesTransformer, HasOutputCol):
    """First difference, 0 on the first row of each series."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seriesCol=None, orderCols=None,
                 hotSeriesRows=None, blockRows=None):
        super(SeriesTransformer, self).__init__()
        self._set(**self._input_kwargs)

    def setOutputCol(self, value: str):
        return self._set(outputCol=value)

    def _reach(self):
        return 1, 0

    def _out(self):
        return self.getOrDefault(self.outputCol) if self.isSet(self.outputCol) else S.diff_name(self.getInputCol())

    def getFeatureNames(self):
        return [self._out()]

    def _columns(self, w):
        return [S.difference(self.getInputCol(), w).alias(self._out())]


class LeadLabel(SeriesTransformer, HasOutputCol):
    """Value ``horizon`` rows ahead, clamped to the series' last value."""

    horizon = Param(Params._dummy(), "horizon", "rows ahead", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, horizon=None, seriesCol=None, orderCols=None,
                 hotSeriesRows=None, blockRows=None):
        super(SeriesTransformer, self).__init__()
        self._setDefault(horizon=1)
        self._set(**self._input_kwargs)

    def _reach(self):
        return 0, self.getOrDefault(self.horizon)

    def setHorizon(self, value: int):
        return self._set(horizon=value)

    def setOutputCol(self, value: str):
        return self._set(outputCol=value)

    def _out(self):
        return self.getOrDefault(self.outputCol) if self.isSet(self.outputCol) else "label"

    def getFeatureNames(self):
        return [self._out()]

    def _columns(self, w):
        return [S.clamped_lead(self.getInputCol(), self.getOrDefault(self.horizon), w).alias(self._out())]
