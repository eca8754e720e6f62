"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is turned by a random rotation, ``DIMS`` of its components at a
time are brought to even spread, shifted, and mapped to a place on a Hilbert
curve.  A place has ``BITS`` bits of each component, so that rows close together
are ordered by what still differs between them, on every curve by other
components: inside a tight cluster as over the whole table, whatever its width.
``curves`` such orderings, each from other components and with another
shift, are range-partitioned by (curve, key) in Spark and cut into blocks of
neighbouring keys.  A query looks at the blocks within its window on each
curve; the windows' candidates are ranked by their exact distance and merged.

The window on each side is ``max(min_window, window_share * rows)``.  It is a
share of the rows because near neighbours of unclustered vectors of many
dimensions are only slightly nearer than the rest: a window of constant
length would lose recall as the table grows.  It is rounded up to whole blocks.

Equal vectors are one entry of the index, which carries its ``k + 1`` smallest
ids (more can never be returned), so thousands of copies of one vector cost
one row and ties among them come out exactly.

Defined cases: rows with a null id, or a vector that is null, empty, all zero
or holds a null or non-finite component take no part; of several rows with one
id the one with the smallest vector counts; vectors of different lengths are
compared as if missing components were 0; fewer than k candidates give all of
them; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import partitions_for, release_memory, small_batches, written
from panelcast.llm.vectors import matrix, usable

DIMS, BITS = 8, 32  # components of a curve, bits of each (at most 8 and 32)
BLOCK = 2048  # index entries of a block
BLOCK_BATCH = 16  # pairs of blocks that Python gets at once


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, their bits dealt over the dimensions: (dims, n).

    The usual bitwise construction: undo the excess work of each bit plane,
    Gray-encode across dimensions.
    """
    x = cells.T.copy()
    dims, of = len(x), x.dtype.type
    for plane in range(bits - 1, 0, -1):
        low = of((1 << plane) - 1)
        for i in range(dims):
            flip = (x[i] >> of(plane)) & of(1) == 1
            swap = np.where(flip, of(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> of(plane)) & of(1) == 1, of((1 << plane) - 1), of(0))
    return x ^ turn


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, dims) with coordinates below 2**bits.

    The bits of all dimensions are interleaved from the highest down.
    """
    x = _transposed(cells.astype(np.int64), bits)
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (n, bits) that sort like the places of ``hilbert_keys``: a byte has one bit of each of up to 8 dimensions."""
    x = np.ascontiguousarray(_transposed(cells.astype(np.uint32), bits).T.astype(">u4"))
    planes = np.unpackbits(x.view(np.uint8), axis=1).reshape(*x.shape, 32)[:, :, 32 - bits:]
    return np.packbits(planes.transpose(0, 2, 1), axis=2)[:, :, 0]


class Curves:
    """The projections and shifts of all curves, from a seed."""

    def __init__(self, dim: int, curves: int, seed: int):
        rng, self.parts = np.random.default_rng(seed), []
        at, rotation = dim, None
        for _ in range(curves):
            if rotation is None or at + min(DIMS, dim) > dim:
                rotation, at = np.linalg.qr(rng.normal(size=(dim, dim)))[0], 0
            use = rotation[:, at:at + DIMS]
            at += DIMS
            self.parts.append((use, rng.random(use.shape[1])))

    def keys(self, v: np.ndarray, mean: np.ndarray, scale: float) -> Iterator[np.ndarray]:
        centred = np.nan_to_num((v - mean) / scale, nan=0.0, posinf=1e6, neginf=-1e6)
        for use, shift in self.parts:
            even = 1 / (1 + np.exp(-1.702 * np.clip(centred @ use, -50, 50)))  # close to the normal distribution function
            cells = np.minimum(((even + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield hilbert_bytes(cells, BITS)


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    """The bytes of an array as a binary column of ``width`` bytes a row."""
    n = a.nbytes // width if width else len(a)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(a))])


def _place(dim: int, curves: int, seed: int, mean: list[float], scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Curves(dim, curves, seed)
        for batch in batches:
            x = matrix(batch.column(2), dim)
            v = _fixed(x, 8 * dim)
            for i, key in enumerate(c.keys(x, np.array(mean), scale)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), i, np.int32)), _fixed(key, BITS), batch.column(0), batch.column(1), v],
                    names=["curve", "key", "id", "asks", "v"])
        release_memory()

    return run


def _blocks(dim: int):
    """Sorted rows of a partition to blocks of one curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        curve, ids, asks, v = None, [], [], []

        def block():
            i, a, x = np.concatenate(ids), np.concatenate(asks), np.concatenate(v)
            row = (curve, part, number, i.tobytes(), x.tobytes(), i[a].tobytes() if a.any() else None, x[a].tobytes() if a.any() else None)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)],
                                              names=["curve", "part", "nth", "ids", "vecs", "ask_ids", "ask_vecs"])

        for batch in batches:
            c, i = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            a, packed = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3)
            x = np.frombuffer(packed.buffers()[2], np.float64, len(i) * dim, 8 * dim * packed.offset).reshape(-1, dim) if len(i) else np.zeros((0, dim))
            at = 0
            while at < len(i):
                if ids and (curve != c[at] or sum(map(len, ids)) >= BLOCK):
                    yield block()
                    ids, asks, v, number = [], [], [], number + 1
                curve = int(c[at])
                room = BLOCK - sum(map(len, ids))
                upto = at + min(room, int(np.searchsorted(c[at:], curve, side="right")))
                ids.append(i[at:upto]), asks.append(a[at:upto]), v.append(x[at:upto])
                at = upto
        if ids:
            yield block()
        release_memory()

    return run


def _rerank(dim: int, k: int):
    """The k + 1 nearest entries of a block for each query of another (or the same) block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for row in zip(*batch.columns, strict=True):
                asks, q, ids, v = (np.frombuffer(x.as_buffer(), np.int64 if n % 2 == 0 else np.float64) for n, x in enumerate(row))
                q, v = q.reshape(-1, dim), v.reshape(-1, dim)
                with np.errstate(all="ignore"):
                    rough = (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T)
                rough = np.where(np.isfinite(rough), rough, np.inf)
                take = min(len(ids), 2 * (k + 1))  # the exact distances decide among these
                near = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
                for i in range(len(asks)):
                    away = v[near[i]] - q[i]
                    large = max(np.abs(away).max(), 1e-300) if not 1e-140 < np.abs(away).max() < 1e140 else 1.0
                    exact = np.sqrt(((away / large) ** 2).sum(axis=1)) * large
                    order = np.lexsort((ids[near[i]], exact))[:k + 1]
                    out[0].append(np.full(len(order), asks[i])), out[1].append(ids[near[i]][order]), out[2].append(exact[order])
            columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "entry", "score"])
        release_memory()

    return run


def nearest(vectors: DataFrame, *, k: int = 10, modulus: int = 100, curves: int = 16, window_share: float = 0.03,
            min_window: int = 2048, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found for every row whose id is divisible by ``modulus``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col, zero=False), "ann-rows")
    # one entry per distinct vector; its copies' smallest ids are picked before anything of a vector meets in one task
    by_id = W.partitionBy("v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    entries = written(members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    asked = rows.where(F.col("id") % modulus == 0)
    asked = written(asked.select(F.col("id").alias("query_id"), "v").join(entries, "v")
                    .select("query_id", F.col("ids")[0].alias("query")), "ann-queries")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(size.dim or 0, 1)
    stats = entries.select(*[F.coalesce(F.avg(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))), F.lit(0.0)).alias(f"m{i}") for i in range(dim)],
                           F.coalesce(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)).alias("sq")).first()
    mean = [stats[f"m{i}"] if math.isfinite(stats[f"m{i}"]) else 0.0 for i in range(dim)]
    spread = (stats.sq - sum(m * m for m in mean)) / dim
    scale = math.sqrt(spread) if math.isfinite(spread) and spread > 0 else 1.0

    entry = entries.join(asked.select("query").distinct(), F.col("ids")[0] == F.col("query"), "left").select(
        F.col("ids")[0].alias("id"), F.col("query").isNotNull().alias("asks"), "v")
    placed = entry.mapInArrow(_place(dim, curves, seed, mean, scale), "curve int, key binary, id long, asks boolean, v binary")
    parts = partitions_for(size.n * curves, 4 * BLOCK, spark)
    index = written(
        placed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
        .select("curve", "id", "asks", "v")
        .mapInArrow(_blocks(dim), "curve int, part int, nth int, ids binary, vecs binary, ask_ids binary, ask_vecs binary"), "ann-index")
    # blocks in curve order; only their names are sorted
    in_order = W.partitionBy("curve").orderBy("part", "nth")
    names = written(index.select("curve", "part", "nth", (F.octet_length("ids") / 8).alias("n"))
                    .withColumn("at", F.row_number().over(in_order))
                    .withColumn("upto", F.sum("n").over(in_order)), "ann-blocks")
    window = max(min_window, math.ceil(window_share * size.n))
    asking = index.where(F.col("ask_ids").isNotNull()).select("curve", "part", "nth", "ask_ids", "ask_vecs").join(names, ["curve", "part", "nth"])
    # blocks meet queries by stretches of the curve as long as a whole window, then by the window itself
    stretch = 2 * window + BLOCK
    low, high = F.col("upto") - F.col("n") - window, F.col("upto") + window
    q = (asking.select("curve", "ask_ids", "ask_vecs", low.alias("low"), high.alias("high"))
         .withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / stretch), F.floor(F.col("high") / stretch))))).alias("q")
    b = names.withColumn("stretch", F.floor((F.col("upto") - 1) / stretch)).alias("b")
    near = (
        q.join(b, (F.col("q.curve") == F.col("b.curve")) & (F.col("q.stretch") == F.col("b.stretch")))
        .where((F.col("b.upto") > F.col("low")) & (F.col("b.upto") - F.col("b.n") < F.col("high")))
        .select("ask_ids", "ask_vecs", F.col("b.curve").alias("curve"), "part", "nth")
    )
    found = near.join(index.select("curve", "part", "nth", "ids", "vecs"), ["curve", "part", "nth"]) \
        .select("ask_ids", "ask_vecs", "ids", "vecs").mapInArrow(_rerank(dim, k), "query long, entry long, score double")
    with small_batches(spark, BLOCK_BATCH):  # a row is a megabyte
        found = written(found, "ann-found")
    best_entries = W.partitionBy("query").orderBy("score", "entry")
    entry_rank = (found.groupBy("query", "entry").agg(F.min("score").alias("score"))
                  .withColumn("nth", F.row_number().over(best_entries)).where(F.col("nth") <= k + 1))
    listed = entry_rank.join(entries.select(F.col("ids")[0].alias("entry"), "ids"), "entry").select(
        "query", "score", F.explode("ids").alias("vec_id"))
    # every query of an entry takes the entry's list, without itself
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.join(listed, "query").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
