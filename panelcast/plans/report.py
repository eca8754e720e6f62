"""Reports and sinks for forecast output.

* ``write_predictions`` / ``read_predictions``: Parquet (default) or CSV,
  partitioned on disk by ``split`` (two folders, as the reference writes a
  train and a test file), rows sorted by series and time inside each file.  The mode is explicit; the default refuses to overwrite.
* ``write_legacy_csv``: the reference's layout, ``<name>train.csv`` and
  ``<name>test.csv`` with header and ``Row Number, Date, Close`` names.
* ``write_legacy_metric_tables``: the reference's per-ticker metric tables.
* ``forecast_long``: one row per (row, horizon, kind) for charts;
  ``forecast_chart``: what a chart of some width shows of it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelcast.functions.series import actual_name, forecast_name
from panelcast.operators.ordered import decode_key, encode_key
from panelcast.sources.panel import SERIES, TIEBREAK, TS, VALUE


# microseconds are kept (the CSV default cuts them off)
CSV_TIME = {k: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for k in ("timestampFormat", "timestampNTZFormat")}


def write_predictions(pred: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    # no repartition: rows stay in the tasks that computed them (already
    # clustered by series); the sort matches what the partitioned writer needs
    (
        pred.sortWithinPartitions("split", SERIES, TS, TIEBREAK)
        .write.mode(mode)
        .partitionBy("split")
        .format(fmt)
        .option("header", "true")
        .save(path)
    )


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
        if schema is None:
            raise ValueError("CSV predictions need the schema they were written with")
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def join_predictions(panel: DataFrame, pred: DataFrame) -> DataFrame:
    """Every panel row with its predictions' columns (null where it has none); a null key is a key like any other."""
    keys = (SERIES, TS, TIEBREAK)
    p, q = panel.alias("p"), pred.alias("q")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}"))
    return p.join(q, same, "left").select("p.*", *[F.col(f"q.{c}").alias(c) for c in pred.columns if c not in keys])


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    metrics.write.mode(mode).format(fmt).option("header", "true").save(path)


def write_legacy_csv(pred: DataFrame, name: str, value_name: str = "Close", ts_name: str = "Date",
                     mode: str = "errorifexists") -> None:
    """``<name>train.csv`` / ``<name>test.csv`` folders in the reference's columns and order.

    ``Row Number, Date, Close``, then per horizon the change, the forecast and
    the actual value.  Two folders take two writes: pass a table that is
    already computed (``ForecastResult.computed``).
    """
    rest = [c for c in pred.columns if c not in (SERIES, TIEBREAK, TS, VALUE, "split", "row_number")]
    out = pred.select("split", F.col("row_number").alias("Row Number"), F.col(TS).alias(ts_name), F.col(VALUE).alias(value_name), *rest)
    for split in ("train", "test"):
        part = out.where(F.col("split") == split).drop("split")
        part.sortWithinPartitions("Row Number").write.mode(mode).options(header="true", **CSV_TIME).csv(f"{name}{split}.csv")


def read_legacy_csv(spark: SparkSession, name: str, split: str, schema) -> DataFrame:
    """One of the two files back, with the schema it was written with (no inference pass)."""
    return spark.read.schema(schema).options(header="true", **CSV_TIME).csv(f"{name}{split}.csv")


# fixed values: the metric the reference's evaluator computes per regressor
# (it files all of them under the name "RMSE")
LEGACY_METRIC = {
    "LinearRegression": "r2",
    "DecisionTreeRegression": "r2",
    "RandomForestRegression": "rmse",
    "GBTRegression": "rmse",
}


def write_legacy_metric_tables(metrics: DataFrame, regressor: str, prefix: str, horizons,
                               mode: str = "errorifexists") -> None:
    """``<prefix>RMSE_test_<regressor>.csv`` / ``..._train_..``: one row per series, one column per horizon.

    The value is the metric the reference reports for that regressor
    (``LEGACY_METRIC``); the key column is named ``Ticker`` as there.
    """
    from panelcast.operators.metrics import metric_table

    from panelcast.session import fresh_path, remove_path

    metric, spark = LEGACY_METRIC[regressor], metrics.sparkSession
    path = fresh_path(spark, "metrics")  # 2 x series x horizons rows, computed once for both files
    metrics.write.parquet(path)
    metrics = spark.read.schema(metrics.schema).parquet(path)
    for split in ("test", "train"):
        table = metric_table(metrics, metric, split, horizons).withColumnRenamed(SERIES, "Ticker")
        table.write.mode(mode).option("header", "true").csv(f"{prefix}RMSE_{split}_{regressor}.csv")
    remove_path(spark, path)


def forecast_long(pred: DataFrame, horizons) -> DataFrame:
    """``(series_id, ts, tiebreak, split, horizon, kind, value)`` with kind forecast/actual."""
    return _long(pred, horizons, [SERIES, TS, TIEBREAK, "split"])


def _long(pred: DataFrame, horizons, columns: list[str]) -> DataFrame:
    rows = []
    for h in horizons:
        rows.append(F.struct(F.lit(h).alias("horizon"), F.lit("forecast").alias("kind"),
                             F.col(forecast_name(h)).alias("v")))
        rows.append(F.struct(F.lit(h).alias("horizon"), F.lit("actual").alias("kind"),
                             F.col(actual_name(h)).alias("v")))
    return pred.select(*columns, F.explode(F.array(*rows)).alias("_r")).select(
        *columns, "_r.horizon", "_r.kind", F.col("_r.v").alias(VALUE)
    )


def forecast_chart(pred: DataFrame, horizons, pixels: int = 800) -> DataFrame:
    """What a chart ``pixels`` wide can show of each line, whatever the series' length.

    Per series, split, horizon, kind and pixel column the first, last,
    smallest and largest value (null values are left out) and the number of
    points: ``(series_id, split, horizon, kind, pixel, points, first_ts,
    first, last_ts, last, low, high)``.  A series' columns divide the time
    from its first to its last row; lines drawn through these points cover the
    pixels that all points would.  Both passes are partial aggregates, so a
    long series costs a task no more than its columns.  A row's time and
    tiebreak are made one number: by one Spark aggregates in a hash table, by a
    struct it would sort all points first.
    """
    if pixels < 1:
        raise ValueError("a chart has a pixel at least")
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({TS} AS TIMESTAMP_NTZ))")
    known = encode_key(pred)
    spans = known.groupBy(SERIES).agg(F.min(micros).alias("_from"), F.max(micros).alias("_to"))
    known = known.join(spans, SERIES).withColumn("_t", micros - F.col("_from"))
    at = F.struct(TS, TIEBREAK)
    if isinstance(pred.schema[TIEBREAK].dataType, IntegralType):  # 66 bits below the time; nulls are first
        tie = F.coalesce(F.col(TIEBREAK).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
        at = F.coalesce(F.col("_t"), F.lit(-1)).cast("decimal(20,0)") * F.lit(Decimal(2**65)) + tie
    known = known.withColumn("_at", at).withColumn("pixel", F.expr(f"_t * {int(pixels)}L div (_to - _from + 1)"))
    placed = _long(known, horizons, [SERIES, TS, "_at", "split", "pixel"]).where(F.col(VALUE).isNotNull())
    out = placed.groupBy(SERIES, "split", "horizon", "kind", "pixel").agg(
        F.count(F.lit(1)).alias("points"), F.min(TS).alias("first_ts"), F.min_by(VALUE, "_at").alias("first"),
        F.max(TS).alias("last_ts"), F.max_by(VALUE, "_at").alias("last"), F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    return decode_key(out)
