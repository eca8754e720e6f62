"""Column builders for ordered per-series computations.

Every builder takes a column and a ``WindowSpec`` that is already partitioned
by the series key (or by series key + block, see ``operators.ordered``) and
ordered by a total order inside the series.  The builders only choose the
frame, so the same expression runs on the plain per-series window and on the
skew-safe blocked window.

All of them are built-in Spark expressions: they stay inside whole-stage
codegen and the Window operator, nothing goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


# --- legacy output naming contract (fixed values) ---------------------------
def diff_name(col: str) -> str:
    return f"Diff_{col}"


def lag_name(col: str, i: int) -> str:
    return f"{col}_LagBy_{i}"


def moving_avg_name(col: str, n: int) -> str:
    return f"{col}_{n}_MovingAvg"


def sign_name(col: str, i: int) -> str:
    return f"{col}_Lag_{i}_Sign"


def delta_name(h: int) -> str:
    return f"DeltaZ{h}"


def forecast_name(h: int) -> str:
    return f"forecast_{h}day"


def actual_name(h: int) -> str:
    return f"actual_{h}day"


# --- expressions -------------------------------------------------------------
def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def difference(c, w: WindowSpec) -> Column:
    """First difference ``x_t - x_(t-1)``; the first row of a series gives 0.

    The frame ``(-1, 0)`` holds only the row itself at the head of a series,
    so ``first`` returns ``x_t`` there.  ``first`` does not skip nulls: a null
    predecessor yields a null difference.
    """
    x = _col(c)
    return x - F.first(x).over(w.rowsBetween(-1, 0))


def lag(c, i: int, w: WindowSpec) -> Column:
    """Value ``i`` rows back; null for the first ``i`` rows of a series."""
    return F.lag(_col(c), i).over(w)


def clamped_lead(c, h: int, w: WindowSpec) -> Column:
    """Value ``h`` rows ahead, clamped to the last row of the series.

    ``last`` over ``(0, h)`` without skipping nulls: for the last ``h`` rows
    the frame is cut at the series end and returns the series' last value,
    where ``lead`` would return null.
    """
    return F.last(_col(c)).over(w.rowsBetween(0, h))


def moving_average(c, n: int, w: WindowSpec) -> Column:
    """Mean over the ``n + 1`` rows ``t-n .. t`` (shorter at the head; nulls skipped)."""
    return F.avg(_col(c)).over(w.rowsBetween(-n, 0))


def trend_sign(c, i: int, w: WindowSpec) -> Column:
    """``signum(x_t - x_(t-i))``: +1, -1, 0 on ties, null for the first ``i`` rows."""
    x = _col(c)
    return F.signum(x - F.lag(x, i).over(w))


def _present_sql(name: str) -> str:
    q = "`" + name.replace("`", "``") + "`"
    return f"({q} IS NOT NULL AND NOT isnan({q}))"


def is_present(c) -> Column:
    """Neither null nor NaN (the rule ``DataFrame.dropna`` applies to doubles)."""
    if isinstance(c, str):
        return F.expr(_present_sql(c))
    return c.isNotNull() & ~F.isnan(c)


def all_present(cols) -> Column:
    """``is_present`` for every column, as one expression."""
    names = [c for c in cols if isinstance(c, str)]
    cond = F.expr(" AND ".join(_present_sql(c) for c in names)) if names else F.lit(True)
    for c in cols:
        if not isinstance(c, str):
            cond = cond & is_present(c)
    return cond
