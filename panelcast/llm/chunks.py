"""Chunks of documents: the unit in which texts meet tables of n-grams.

Scoring a text needs the table's value for each of its n-grams, which is far
too much to join one by one.  A chunk is some megabytes of documents.  It asks
for each distinct n-gram once; the table, sharded by n-gram, answers by a
join; the answers meet the chunk's texts again, and the documents are scored
there.  A task holds one chunk and its answers, whatever the sizes of corpus
and table.

Chunks are made inside the scan, without a shuffle, and are named by the task
that made them.  Both passes over the input therefore agree on them as long as
its rows come in the same partitions and order twice, as rows of files do;
a chunk that lacks an answer raises an error rather than score wrongly.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from panelcast.llm.common import release_memory

CHUNK_BYTES = 32_000_000  # text of a chunk (or one document)
PIECE_BYTES = 2_000_000  # text looked at together inside a chunk
SCORED_BYTES = 500_000  # text scored together


def chunks_of(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows in tables of about ``size`` bytes of column ``text``."""
    held, n = [], 0
    for batch in batches:
        first = 0
        for i, length in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
            n += length
            if n >= size:
                yield pa.Table.from_batches([*held, batch.slice(first, i + 1 - first)])
                held, n, first = [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def pieces_of(table: pa.Table, size: int = PIECE_BYTES) -> Iterator[pa.Table]:
    yield from chunks_of(iter(table.combine_chunks().to_batches()), size)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Chunks with names: small numbers, which cost little in every row of a question and an answer."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for i, chunk in enumerate(chunks_of(batches)):
        yield (part << 20) + i, chunk


def _single(names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def ask(docs: DataFrame, keys_of: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(chunk, gram, n): each chunk's distinct grams as longs, with the sum of the counts that ``keys_of`` gives.

    ``keys_of(piece)`` yields (grams, counts) of a piece of a chunk.  ``docs``
    has a binary column ``text``.
    """
    def run(batches):
        for name, chunk in _named(batches):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for piece in pieces_of(chunk):
                found += keys_of(piece)
                if len(found) >= 8:
                    found = [_merged(found)]
            if found:
                grams, n = _merged(found)
                for a in range(0, len(grams), 65_536):
                    g = grams[a:a + 65_536]
                    yield _single(["chunk", "gram", "n"], [pa.array(np.full(len(g), name)), pa.array(g), pa.array(n[a:a + 65_536])])
                del found, grams, n
                release_memory()

    return docs.mapInArrow(run, "chunk long, gram long, n long")


def _merged(parts):
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def payload(docs: DataFrame) -> DataFrame:
    """(chunk, packed): the chunks themselves, as compressed pieces."""
    def run(batches):
        for name, chunk in _named(batches):
            packed = []
            for piece in pieces_of(chunk, SCORED_BYTES):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_table(piece)
                packed.append(zstandard.ZstdCompressor(level=6).compress(sink.getvalue()))
            yield _single(["chunk", "packed"], [pa.array([name], pa.int64()), pa.array([packed], pa.list_(pa.binary()))])

    return docs.mapInArrow(run, "chunk long, packed array<binary>")


class Table:
    """Values of grams, found by a hash of the gram."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(len(grams), 1).bit_length() + 1
        slot = self._slot(grams)
        order = np.argsort(slot, kind="stable")
        self.grams, self.values = np.append(grams[order], 0), values[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << self.bits))]).astype(np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        """Values of ``wanted``; every one of them has to be there."""
        slot = self._slot(np.ascontiguousarray(wanted))
        at = self.first[slot]
        left = np.flatnonzero((self.grams[at] != wanted) | (at >= self.first[slot + 1]))
        while len(left):
            at[left] += 1
            if (at[left] >= self.first[slot[left] + 1]).any():
                raise RuntimeError("a chunk was not the same in both passes: checkpoint the documents first")
            left = left[self.grams[at[left]] != wanted[left]]
        return self.values[at]


def score(docs: DataFrame, answers: dict[str, DataFrame], score_piece: Callable, schema: str) -> DataFrame:
    """Rows of ``score_piece(piece, tables)`` for every piece of every chunk.

    Each of ``answers`` has (chunk, gram, value), a long; ``tables`` maps its
    name to the chunk's ``Table``.
    """
    names = list(answers)
    told = None
    for i, name in enumerate(names):
        a = answers[name].select("chunk", F.lit(i).alias("kind"), "gram", "value")
        told = a if told is None else told.unionByName(a)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kind, grams, values = (right.column(c).to_numpy() for c in ("kind", "gram", "value"))
        tables = {}
        for i, name in enumerate(names):
            tables[name] = Table(grams[kind == i], values[kind == i])
        out = []
        for pieces in left.column("packed"):
            for packed in pieces:
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                out.append(score_piece(pa.ipc.open_stream(raw).read_all(), tables))
        del tables, grams, values, kind
        release_memory()
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return payload(docs).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


FIXED = 1 << 28  # steps of one in a logarithm that is sent as a whole number


def fixed(c):
    return F.round(c * FIXED).cast("long")


def byte_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of the ``order`` bytes up to each byte of each text, and the number of codes per text.

    A text starts after ``order - 1`` line feeds and ends with one more.
    """
    pad = b"\n" * (order - 1)
    flat = np.frombuffer(pad.join([b"", *[t + b"\n" for t in texts]]), np.uint8)
    n = len(flat) - order + 1
    code = np.zeros(max(n, 0), np.int64)
    for k in range(order):
        code = (code << 8) | flat[k:n + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    keep = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return code[keep], sizes


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of each text's values; every text has at least one."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
