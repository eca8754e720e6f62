"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a series of zstandard frames that hold little-endian unsigned 32-bit
ids, then a skippable frame with the index of its documents, then the seek
table of the public "seekable" layout: for every frame its compressed size, its
size and the low 32 bits of the XXH64 of its content.  Any zstandard reader can
decompress such a file whole; a reader that wants some documents looks up the
tail and decompresses only the frames that hold them, each checked by itself.

Documents are sorted by id (null first) over all files: a range shuffle of the
texts, whose tasks tokenise and write their share as they read it, so a task
holds some megabytes and one document whatever its share.  Rows that tie on
the id are ordered by text; equal rows may be dealt to several tasks.  A task
writes files under names of its own and reports them; the report is a table
that Spark commits, and only files named in it belong to the data set, so a
task that is lost and run again leaves nothing that is read.

Folders are opened through ``pyarrow.fs`` (local and shared disks, HDFS, object
stores), whose address Spark's file system gives.

Defined cases: a null or empty text is a document of the end id alone; null
ids come first; repeated rows are separate documents; an empty table gives no
files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import small_batches, text_or_empty
from panelcast.llm.packing import word_ids

# --- fixed values of the seekable layout ----------------------------------------
SKIPPABLE, INDEX_MAGIC = 0x184D2A5E, 0x184D2A5D
SEEKABLE, CHECKSUMS = 0x8F92EAB1, 0x80

FRAME_BYTES = 262_144  # of ids; a frame ends with the first document that fills it, a longer one has several
LONG_BYTES = 4_194_304  # of ids that a frame has at most
FILE_BYTES, FILE_DOCUMENTS = 268_435_456, 1_000_000  # of ids, and documents, after which a task starts another file
BATCH_BYTES = 4_000_000  # of ids given to Spark at once
MANIFEST = "part int, nth int, file string, first_id long, last_id long, nulls long, documents long, tokens long, bytes long"


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def open_folder(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


class Writer:
    """One file: ``add`` documents in order, then ``close``."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.held, self.size = [], 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        content = b"".join(self.held)
        for a in range(0, len(content), LONG_BYTES):
            some = content[a:a + LONG_BYTES]
            frame = self.compressor.compress(some)
            self.stream.write(frame)
            self.table.append((len(frame), len(some), _checksum(some)))
        self.held, self.size = [], 0

    def close(self) -> int:
        """Bytes of the file."""
        self._flush()
        known = bytes(i is not None for i in self.ids)
        index = struct.pack("<Q", len(self.ids)) + known + struct.pack(f"<{len(self.ids)}q", *[i or 0 for i in self.ids])
        index += struct.pack(f"<{len(self.counts)}Q", *self.counts)
        frame = self.compressor.compress(index)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(frame)) + frame)
        self.table.append((8 + len(frame), 0, _checksum(index)))
        entries = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.stream.close()
        return sum(e[0] for e in self.table) + 8 + len(entries)


class Reader:
    """One file: its documents' ids and counts, and the ids of any of them."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        if struct.unpack("<II", self._at(size - 17 - 12 * frames, 8)) != (SKIPPABLE, 12 * frames + 9):
            raise ValueError("damaged seek table")
        self.packed, self.sizes, self.checks = entries.T
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        body = self._at(int(self.offsets[frames - 1]), int(self.packed[-1]))
        if struct.unpack("<II", body[:8]) != (INDEX_MAGIC, len(body) - 8):
            raise ValueError("damaged index")
        index = self.decompressor.decompress(body[8:])
        if _checksum(index) != self.checks[-1]:
            raise ValueError("damaged index")
        n = struct.unpack("<Q", index[:8])[0]
        known = np.frombuffer(index, bool, n, 8)
        ids = np.frombuffer(index, "<i8", n, 8 + n)
        self.ids = [int(i) if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # tokens before each document
        self.opened = 0  # frames decompressed so far
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        return self.source.read_at(n, offset)

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            content = self.decompressor.decompress(self._at(int(self.offsets[k]), int(self.packed[k])), max_output_size=int(self.sizes[k]))
            if len(content) != self.sizes[k] or _checksum(content) != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last, self.opened = (k, content), self.opened + 1
        return self._last[1]

    def document(self, nth: int) -> bytes:
        import numpy as np

        a, z = 4 * int(self.first[nth]), 4 * int(self.first[nth + 1])
        k, parts = int(np.searchsorted(self.starts, a, side="right")) - 1, []
        while a < z:
            start = int(self.starts[k])
            parts.append(self._frame(k)[a - start:z - start])
            a, k = int(self.starts[k + 1]), k + 1
        return b"".join(parts)


def _write(tokenizer_path: str, end_id: int, address: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, nth, writer, name = TaskContext.get().partitionId(), 0, None, ""
        end = struct.pack("<I", end_id)
        filesystem, folder = open_folder(address)
        ids_of, done = word_ids(tokenizer_path), []

        def close():
            known = [i for i in writer.ids if i is not None]
            done.append((part, nth, name, known[0] if known else None, known[-1] if known else None, len(writer.ids) - len(known),
                         len(writer.ids), writer.tokens, writer.close()))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.encoded(batch.column(1)), strict=True):
                if writer is None:
                    name = f"{part:06d}-{nth:04d}-{uuid.uuid4().hex}.ids.zst"
                    writer = Writer(filesystem.open_output_stream(f"{folder}/{name}", compression=None))
                writer.add(doc_id, ids + end)
                if 4 * writer.tokens >= FILE_BYTES or len(writer.ids) >= FILE_DOCUMENTS:
                    close()
                    writer, nth = None, nth + 1
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 9
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                                         names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def _address(spark: SparkSession, folder: str, *, make: bool = False) -> str:
    """The folder's whole address, as ``pyarrow.fs`` takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    filesystem = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        filesystem.mkdirs(path)
    where = filesystem.makeQualified(path).toUri()
    return f"{where.getScheme()}://{where.getAuthority() or ''}{where.getPath()}"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids, each followed by ``end_id``, to files in ``folder``; the table of the files.

    The tokenizer must drop white space and split at it, since words are
    encoded one by one.  Files are in the order of (part, nth).
    """
    spark = docs.sparkSession
    address = _address(spark, f"{folder}/files", make=True)
    text = text_or_empty(text_col)
    keys = ["id", "tie", "row"]  # equal rows are interchangeable, so that any order deals them out
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions("id", "tie", "text").select("id", "text")
    with small_batches(spark):
        sorted_rows.mapInArrow(_write(tokenizer_path, end_id, address), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(address: str, wanted: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = open_folder(address)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{folder}/{name}") as source:
                    reader = Reader(source)
                    out: list[list] = [[], [], [], []]
                    size = 0
                    for nth, doc_id in enumerate(reader.ids):
                        if wanted is not None and doc_id not in wanted:
                            continue
                        ids = reader.document(nth)
                        for c, v in zip(out, (doc_id, before + int(reader.first[nth]), len(ids) // 4, ids), strict=True):
                            c.append(v)
                        size += len(ids)
                        if size >= BATCH_BYTES:
                            yield _documents(out)
                            out, size = [[], [], [], []], 0
                    if out[0]:
                        yield _documents(out)

    return run


def _documents(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, folder: str, ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (their bytes) of all documents, or of those asked for.

    The driver learns one row per file (of 256 MB of ids where there are so
    many).  ``ids`` are sent to the tasks and are meant for some thousands: files
    and frames without them are not opened; to read more, read all and join.
    """
    address = _address(spark, f"{folder}/files")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files, before = [], 0
    wanted = None if ids is None else frozenset(ids)
    for r in sorted(manifest.select("part", "nth", "file", "first_id", "last_id", "tokens").collect()):
        if wanted is None or (r.first_id is not None and any(r.first_id <= i <= r.last_id for i in wanted)):
            files.append((r.file, before))
        before += r.tokens
    share = spark.createDataFrame(files, "file string, before long").repartition(max(1, len(files)))
    return share.mapInArrow(_read(address, wanted), "doc_id long, start long, n_tokens long, ids binary")
