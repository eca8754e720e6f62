"""A data source for vendor files: one CSV per ticker, read as one panel, or written.

``read_vendor_files(spark, folder)`` gives the panel of all files of a folder:
``<ticker>.csv``, or any ``.csv`` below ``series_id=<ticker>/`` as Spark writes
them.  A file is read whole by one task: up to ``PARTITIONS`` files are a partition
each, more are put together by size.  Filters on the series choose the files
before anything is opened; filters on the time are applied batch by batch while a
file is read.  They come from the arguments, and from the query itself
where the session has ``spark.sql.python.filterPushdown.enabled``.

A file is read as a stream of Arrow batches, through ``pyarrow.fs`` (local and
shared disks, HDFS, object stores); a task holds one batch of a long file, or some
thousand rows of short ones.

Defined cases: a file without rows gives none; rows without a date are left out
(they have no place in a series); an empty value is null; files that lack the
date or the value column, and dates not in the stated format, are errors; without
a tiebreak column the place in the file is the tiebreak; an empty folder is an
empty panel.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from panelcast.sources.panel import SERIES, TIEBREAK, TS, VALUE

NAME = "vendor_files"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TIMES = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


PARTITIONS = 400  # about as many for files that are not large, however many they are
PARTITION_BYTES = 128_000_000  # of several files in a partition
OPEN_BYTES = 64_000  # what opening a file costs, in bytes read
BATCH_ROWS = 10_000  # of short files, sent on together


class VendorPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def series_of(path: str) -> str:
    """The ticker of a file: its folder's ``key=value``, or its own name."""
    from urllib.parse import unquote

    *_, folder, name = ["", *path.split("/")]
    return unquote(folder.partition("=")[2]) if "=" in folder else name.removesuffix(".csv")


class VendorReader(DataSourceReader):
    """Reads the files that the ``series`` allow, the rows that ``times`` (comparison, micros) allow."""

    def __init__(self, options: dict):
        self.folder, self.date, self.value = options["path"], options.get("date", "Date"), options.get("value", "Close")
        self.format, self.tiebreak = options.get("format"), options.get("tiebreak", TIEBREAK)
        self.series: set[str] | None = None
        self.times: list[tuple[str, dt.datetime]] = []

    def keep_series(self, names: Iterable[str]) -> None:
        self.series = set(names) if self.series is None else self.series & set(names)

    def partitions(self) -> list[VendorPartition]:
        from pyarrow import fs

        filesystem, folder = fs.FileSystem.from_uri(self.folder)
        found = filesystem.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(".csv") and not f.base_name.startswith(("_", ".")))
        files = [(path, size + OPEN_BYTES) for path, size in files if self.series is None or series_of(path) in self.series]
        most = min(sum(cost for _, cost in files) / PARTITIONS, PARTITION_BYTES)
        parts: list[list[str]] = [[]]  # a scan has a partition at least
        filled = 0
        for path, cost in files:
            if parts[-1] and filled + cost > most:
                parts.append([])
                filled = 0
            parts[-1].append(path)
            filled += cost
        return [VendorPartition(paths) for paths in parts]

    def read(self, partition: VendorPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, _ = fs.FileSystem.from_uri(self.folder)
        held, n = [], 0
        for path in partition.paths:
            for rows in self._file(filesystem, path):
                held.append(rows)
                n += rows.num_rows
                if n >= BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _file(self, filesystem, path: str) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        series, times, place = series_of(path), pa.timestamp("us"), 0
        convert = csv.ConvertOptions(column_types={self.date: times, self.value: pa.float64(), self.tiebreak: pa.int64()}, strings_can_be_null=True,
                                     timestamp_parsers=[self.format] if self.format else None)
        with filesystem.open_input_file(path) as source:
            if not source.size():
                return
            for batch in csv.open_csv(source, convert_options=convert):
                ts, value = batch.column(self.date), batch.column(self.value)
                tie = batch.column(self.tiebreak) if self.tiebreak in batch.schema.names else pa.array(range(place, place + batch.num_rows), pa.int64())
                place += batch.num_rows
                keep = ts.is_valid()
                for comparison, limit in self.times:
                    keep = pc.and_(keep, pc.fill_null(getattr(pc, comparison)(ts, pa.scalar(limit, times)), False))
                rows = pa.RecordBatch.from_arrays([pa.array([series] * batch.num_rows, pa.string()), ts, tie, value],
                                                  names=[SERIES, TS, TIEBREAK, VALUE]).filter(keep)
                if rows.num_rows:
                    yield rows


class PushedVendorReader(VendorReader):
    """Takes over the query's filters on the series and the time."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (SERIES,):
                self.keep_series([f.value] if isinstance(f, EqualTo) else f.value)
            elif type(f) in _TIMES and f.attribute == (TS,):
                self.times.append((_TIMES[type(f)], f.value))
            else:
                yield f


class VendorWriter(DataSourceArrowWriter):
    """Writes rows sorted by series (then as they come), all text but for the series: a file per series and task.

    A file gets its name when it is whole, the same one if its task runs again.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from urllib.parse import quote

        from pyarrow import csv, fs
        from pyspark import TaskContext

        filesystem, folder = fs.FileSystem.from_uri(self.folder)
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05}.csv", f"_{task.taskAttemptId()}"
        text = csv.WriteOptions(include_header=False, quoting_style="none")
        series, out, place = None, None, ""

        def finish():
            if out is not None:
                out.close()
                filesystem.move(f"{place}/{attempt}", f"{place}/{name}")

        for batch in iterator:
            columns, keys = batch.select(batch.schema.names[1:]), batch.column(0)
            a = 0
            for run in pc.run_end_encode(keys).run_ends.to_pylist() if len(keys) else []:
                if out is None or keys[a].as_py() != series:
                    finish()
                    series = keys[a].as_py()
                    place = f"{folder}/{SERIES}={quote(series, safe=' ')}"
                    filesystem.create_dir(place)
                    out = filesystem.open_output_stream(f"{place}/{attempt}")
                    out.write((",".join(columns.schema.names) + "\n").encode())
                csv.write_csv(columns.slice(a, run - a), out, text)
                a = run
        finish()
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        filesystem, folder = fs.FileSystem.from_uri(self.folder)
        filesystem.create_dir(folder)
        filesystem.open_output_stream(f"{folder}/_SUCCESS").close()


class VendorFiles(DataSource):
    """``spark.read.format("vendor_files").load(folder)`` once registered."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{SERIES} string, {TS} timestamp_ntz, {TIEBREAK} bigint, {VALUE} double"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VendorWriter(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        import json

        options = dict(self.options)
        reader = (PushedVendorReader if options.get("pushdown") == "true" else VendorReader)(options)
        if "series" in options:
            reader.keep_series(json.loads(options["series"]))
        for name, comparison in (("since", "greater_equal"), ("until", "less")):
            if name in options:
                reader.times.append((comparison, dt.datetime.fromisoformat(options[name])))
        return reader


def _located(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{where.getScheme()}://{where.getAuthority() or ''}{where.getPath()}"


def read_vendor_files(spark: SparkSession, folder: str, *, date: str = "Date", value: str = "Close", fmt: str | None = None,
                      series: Iterable[str] | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """The panel (series_id, ts, tiebreak, value) of a folder's files.

    ``fmt`` is a ``strptime`` format (default: ISO 8601).  ``series`` chooses
    files, ``since`` <= ts < ``until`` rows.
    """
    import json

    spark.dataSource.register(VendorFiles)
    options = {"date": date, "value": value, "pushdown": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    if fmt:
        options["format"] = fmt
    if series is not None:
        options["series"] = json.dumps(sorted(set(series)))
    options |= {name: t.isoformat() for name, t in (("since", since), ("until", until)) if t is not None}
    return spark.read.format(NAME).options(**options).load(_located(spark, folder))


def write_vendor_files(panel: DataFrame, folder: str) -> None:
    """One CSV file (Date, tiebreak, Close) per series in a new folder; a null series has none."""
    from pyspark.sql import functions as F

    spark = panel.sparkSession
    spark.dataSource.register(VendorFiles)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(folder)
    rows = panel.where(F.col(SERIES).isNotNull()).select(
        SERIES, F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Date"), F.col(TIEBREAK).cast("string"), F.col(VALUE).cast("string").alias("Close"))
    rows.repartition(SERIES).sortWithinPartitions(SERIES, "Date", F.col(TIEBREAK).cast("bigint")).write.format(NAME).mode("append").save(_located(spark, folder))
