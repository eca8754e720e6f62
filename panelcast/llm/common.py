"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.session import fresh_path, remove_path

#: A word is a run of anything but ASCII white space (the same set ``bytes.split()`` uses).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 2_000  # of an Arrow batch; texts and sets make rows of many kilobytes
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Queries that start inside hand Python at most ``rows`` rows at once; the session's setting comes back."""
    before = spark.conf.get(_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, sizes are known.

    Its shuffles are of no use afterwards.  Spark drops the files of a shuffle
    when the driver's garbage collector finds it unused, so that is run here.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` returned, when nothing will read it any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if f"/panelcast/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"not a written table of this session: {folder}")
        remove_path(spark, folder)


def release_memory() -> None:
    """Gives memory that a Python worker no longer uses back to the system, where the system's allocator can."""
    import ctypes
    from contextlib import suppress

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """Partitions so that each holds about ``per_partition`` rows, at least the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_partition))


def numbered(rows: DataFrame, key: str, order: list[Column], range_by: list[Column], name: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``nth`` (long, from 0): a row's place among those of its key (not null) in ``order``.

    No task gets a whole key: rows are dealt out by ranges of ``key`` and
    ``range_by`` (which must not contradict ``order``) and sorted there; what
    earlier tasks hold of a key is added.  The sorted rows are written once, so
    that their numbers stand.
    """
    placed = (rows.repartitionByRange(F.col(key), *range_by).sortWithinPartitions(F.col(key), *order)
              .select(*keep, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    placed = written(placed, name)
    counts = placed.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(counts, [key, "part"]).withColumn("nth", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")
