"""Skew-safe ordered windows for very long (hot) series.

A window ``partitionBy(series_id)`` sends a whole series to one task.  That
is the right plan for many ordinary series, but a single series holding a
third of all rows would then run in one task.  For such hot series this
module gives the same results with bounded tasks:

1. ``index_rows``: a 0-based position inside the series, computed without a
   per-series task.  Rows are range-partitioned on ``(series_id, ts,
   tiebreak)`` (balanced by sampling, so a hot series spans many
   partitions), sorted inside each partition, numbered by
   ``monotonically_increasing_id``, and checkpointed to the shared folder so
   the range bounds and numbers can never be recomputed differently after
   an executor loss.  A tiny per-(series, partition) count table turns the
   partition-local numbers into global positions.
2. ``blocked_window``: position ``div`` B gives a block; the last ``back``
   rows of a block are copied into the next block and the first ``fwd``
   rows into the previous one (halo rows).  Any window whose frame reaches
   at most ``back`` rows back and ``fwd`` rows ahead is then evaluated with
   ``partitionBy(series_id, block)``, and only the block's own rows are
   kept.  Each task holds at most ``B + back + fwd`` rows of one block.
3. ``running_counts``: unbounded running sums (``rows between unbounded
   preceding and current row``) and series totals from per-block sums,
   offsets over the small block table, and a within-block running sum.

All steps are DataFrame operations; the only tables that move whole are
the count tables, whose size is bounded by the number of partitions and
blocks, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.session import shared_dir
from panelcast.sources.panel import ORDER, SERIES, TIEBREAK, TS

IDX = "_idx"
BLOCK = "_blk"
HOME = "_home"
#: The sketch tracks so many keys per hot key there can be: its error, 3.5 / SKETCH_ROOM of the threshold, hides none.
SKETCH_ROOM = 16
SKETCH_KEYS = 1 << 19  # with more to track all keys are counted


def series_window() -> WindowSpec:
    """The plain per-series window (one task per series)."""
    return Window.partitionBy(SERIES).orderBy(*ORDER)


def to_layout(df: DataFrame, key, order):
    """``df`` with its key and order under the panel's names, and a function that undoes it on a result.

    ``key`` and ``order`` are lists of column names.  Columns that already
    have one of the panel's names but another meaning are set aside.
    """
    key, order = list(key), list(order)
    if key == [SERIES] and order == list(ORDER):
        return df, lambda out: out
    taken = {c: f"_aside_{c}" for c in (SERIES, TS, TIEBREAK) if c in df.columns}
    name = {c: taken.get(c, c) for c in df.columns}
    x = df.withColumnsRenamed(taken)
    key_col = F.col(name[key[0]]) if len(key) == 1 else F.to_json(F.struct(*[F.col(name[c]) for c in key]), {"ignoreNullFields": "false"})
    rest = [F.col(name[c]) for c in order[1:]] or [F.lit(0)]
    x = x.withColumn(SERIES, key_col).withColumn(TS, F.col(name[order[0]]) if order else F.lit(0)).withColumn(TIEBREAK, F.struct(*rest))
    return x, lambda out: out.drop(SERIES, TS, TIEBREAK).withColumnsRenamed({v: k for k, v in taken.items()})


def series_sizes(panel: DataFrame) -> DataFrame:
    """Rows per series; a partial aggregate, so hot keys are combined map-side."""
    return panel.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"))


def encode_key(df: DataFrame) -> DataFrame:
    """``df`` with a series key that is never null (``n`` for null, else ``k`` and the key as text).

    Inside the operators series are joined by equality; a null key is a
    series like any other, as it is in ``groupBy`` and in windows.
    """
    return df.withColumn(SERIES, encoded_key(F.col(SERIES)))


def encoded_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("n"))


def decode_key(df: DataFrame, key_type="string") -> DataFrame:
    """The reverse of :func:`encode_key`."""
    return df.withColumn(SERIES, F.when(F.col(SERIES) != "n", F.expr(f"substring({SERIES}, 2)")).cast(key_type))


@dataclass(frozen=True)
class Heat:
    """Which series are hot: found once per chain of operators and passed down.

    ``keys`` is a table of encoded keys (None: no series is hot), never a
    list in the driver or in the plan.  ``everything`` sends all series
    through the blocked path.  ``rows`` is the number of rows in the hot part
    of the panel it was made from.
    """

    keys: DataFrame | None = None
    rows: int = 0
    everything: bool = False

    @classmethod
    def of(cls, panel: DataFrame, hot_series_rows: int | None) -> Heat:
        """One column of ``panel`` is read; ``None`` skips the check, ``0`` makes everything hot.

        A sketch of the most frequent keys, one small buffer per task,
        proposes the hot ones; only what it proposes is counted.
        """
        if hot_series_rows is None:
            return cls()
        rows = panel.count()
        if hot_series_rows == 0:
            return cls(rows=rows, everything=True)
        if rows <= hot_series_rows:
            return cls()
        keys = panel.select(encoded_key(F.col(SERIES)).alias("_hot"))
        tracked = 1 << max(10, math.ceil(math.log2(SKETCH_ROOM * rows / hot_series_rows)))
        if tracked <= SKETCH_KEYS:
            most = math.ceil(2 * rows / hot_series_rows)  # at most half of them can be hot
            top = keys.agg(F.expr(f"approx_top_k(_hot, {min(most, tracked)}, {tracked})").alias("top"))
            keys = keys.join(F.broadcast(top.select(F.explode("top.item").alias("_hot"))), "_hot", "left_semi")
        hot = keys.groupBy("_hot").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > hot_series_rows)
        shared_dir(panel.sparkSession)
        hot = hot.checkpoint(eager=True)
        found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("n_rows").alias("rows")).first()
        if not found["keys"]:
            return cls()
        return cls(keys=hot.select("_hot"), rows=int(found["rows"]))

    def split(self, panel: DataFrame):
        """``[(part, blocked, rows)]``: ordinary series and hot series; no row is in neither."""
        if self.everything:
            return [(panel, True, self.rows)]
        if self.keys is None:
            return [(panel, False, None)]
        same = encoded_key(F.col(SERIES)) == F.col("_hot")
        return [(panel.join(self.keys, same, "left_anti"), False, None), (panel.join(self.keys, same, "left_semi"), True, self.rows)]


def split_by_heat(panel: DataFrame, hot_series_rows: int | Heat | None):
    """``[(part, blocked, rows_in_part)]``: ordinary series and hot series.

    ``hot_series_rows`` is a threshold (``None``: no check, one plain part;
    ``0``: every series is hot) or a :class:`Heat` found before.
    """
    heat = hot_series_rows if isinstance(hot_series_rows, Heat) else Heat.of(panel, hot_series_rows)
    return heat.split(panel)


def apply_by_series(df: DataFrame, fn: Callable[[DataFrame, WindowSpec], DataFrame], back: int, fwd: int,
                    hot_series_rows: int | Heat | None = 5_000_000, block_rows: int = 1_000_000,
                    rows_per_partition: int = 2_000_000) -> DataFrame:
    """``fn(df, w)`` over each series, skew-safe.

    ``fn`` adds columns with windows over ``w`` whose frames reach at most
    ``back`` rows back and ``fwd`` ahead.  Ordinary series use the plain
    per-series window; series above ``hot_series_rows`` go through
    :func:`index_rows` and :func:`blocked_window`.  Same rows, same values.
    """
    outs = []
    for part, blocked, rows in split_by_heat(df, hot_series_rows):
        if not blocked:
            outs.append(fn(part, series_window()))
            continue
        x = index_rows(encode_key(part), rows, rows_per_partition)
        y = blocked_window(x, fn, IDX, max(block_rows, back, fwd, 1), back, fwd)
        outs.append(decode_key(y.drop(IDX, BLOCK), df.schema[SERIES].dataType))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def index_rows(df: DataFrame, total_rows: int, rows_per_partition: int = 2_000_000) -> DataFrame:
    """Add ``_idx``: 0-based position of each row in its series by (ts, tiebreak).

    The series key must not be null (:func:`encode_key`).
    """
    spark = df.sparkSession
    shared_dir(spark)  # checkpoint() below writes to the shared folder
    parts = max(1, math.ceil(max(total_rows, 1) / rows_per_partition))
    cols = df.columns
    ranged = (
        df.repartitionByRange(parts, SERIES, TS, TIEBREAK)
        .sortWithinPartitions(SERIES, TS, TIEBREAK)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    pid = F.shiftright(F.col("_mid"), 33)
    stats = ranged.groupBy(SERIES, pid.alias("_pid")).agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_cnt")
    )
    w = Window.partitionBy(SERIES).orderBy("_pid")
    stats = stats.select(
        SERIES, "_pid", "_m0", (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_off")
    )
    return (
        ranged.withColumn("_pid", pid)
        .join(stats, [SERIES, "_pid"])
        .select(*cols, (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(IDX))
    )


def halo_blocks(df: DataFrame, idx_col: str, block_rows: int, back: int, fwd: int) -> DataFrame:
    """Assign blocks and copy halo rows into the neighbouring blocks."""
    if block_rows < max(back, fwd, 1):
        raise ValueError("block_rows must be at least the window reach")
    blk = F.expr(f"{idx_col} div {block_rows}")
    pos = F.col(idx_col) - blk * F.lit(block_rows)
    copies = F.array(
        F.struct(blk.alias("b"), F.lit(True).alias("h")),
        F.when(pos >= block_rows - back, F.struct((blk + 1).alias("b"), F.lit(False).alias("h"))),
        F.when((pos < fwd) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("h"))),
    )
    cols = [c for c in df.columns if c not in (BLOCK, HOME)]
    return (
        df.select(*cols, F.explode(F.filter(copies, lambda s: s.isNotNull())).alias("_c"))
        .select(*cols, F.col("_c.b").alias(BLOCK), F.col("_c.h").alias(HOME))
    )


def blocked_window(df: DataFrame, fn: Callable[[DataFrame, WindowSpec], DataFrame],
                   idx_col: str, block_rows: int, back: int, fwd: int) -> DataFrame:
    """Evaluate ``fn(df, w)`` with bounded-frame windows over halo blocks.

    ``fn`` must only use frames reaching at most ``back`` rows back and
    ``fwd`` rows ahead (nested windows add up their reaches).
    """
    x = halo_blocks(df, idx_col, block_rows, back, fwd)
    w = Window.partitionBy(SERIES, BLOCK).orderBy(idx_col)
    return fn(x, w).where(F.col(HOME)).drop(HOME)


def running_counts_window(df: DataFrame, flags: dict[str, Column], w: WindowSpec) -> DataFrame:
    """For each flag: ``<name>_cum`` (rows so far, inclusive) and ``<name>_tot``.

    ``w`` is the plain per-series window; the totals use the same
    partitioning, so neither adds an exchange.
    """
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(SERIES)
    out = []
    for name, cond in flags.items():
        one = cond.cast("bigint")
        out += [F.sum(one).over(run).alias(f"{name}_cum"), F.sum(one).over(whole).alias(f"{name}_tot")]
    return df.select("*", *out)


def running_counts_blocked(df: DataFrame, flags: dict[str, Column], idx_col: str) -> DataFrame:
    """Same outputs as :func:`running_counts_window` for block-partitioned rows.

    ``df`` must hold the ``_blk`` column from :func:`blocked_window`.  Block
    sums go through a table with one row per block; the running sum inside
    a block reuses the block partitioning (no new exchange).
    """
    flag_cols = {f"_f_{n}": c.cast("bigint") for n, c in flags.items()}
    x = df.select("*", *[c.alias(n) for n, c in flag_cols.items()])
    sums = x.groupBy(SERIES, BLOCK).agg(*[F.sum(n).alias(f"{n}_s") for n in flag_cols])
    before = Window.partitionBy(SERIES).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(SERIES)
    offs = sums.select(
        SERIES, BLOCK,
        *[F.coalesce(F.sum(f"{n}_s").over(before), F.lit(0)).alias(f"{n}_off") for n in flag_cols],
        *[F.sum(f"{n}_s").over(whole).alias(f"{n}_tot") for n in flag_cols],
    )
    run = Window.partitionBy(SERIES, BLOCK).orderBy(idx_col).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(n).over(run).alias(f"{n}_loc") for n in flag_cols])
    x = x.join(offs, [SERIES, BLOCK])
    out = []
    for name in flags:
        n = f"_f_{name}"
        out += [(F.col(f"{n}_off") + F.col(f"{n}_loc")).alias(f"{name}_cum"), F.col(f"{n}_tot").alias(f"{name}_tot")]
    return x.select(*df.columns, *out)
