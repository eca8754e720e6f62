"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are turned into integers; every component is a term with a signed
weight.  Rows are put into document order by a locality key (the nearest of a
few pivots, then the id), cut into ranges of ``BLOCK`` documents and stored as
block forward indexes: the rows' weights, and per term the largest and the
smallest weight in the block.  A query's bound for a block is the sum over its
terms of the larger of weight times maximum and weight times minimum.  A query
opens blocks in the order of their bounds and scores all rows of a block by
its forward index; it stops when the next bound cannot beat its k-th result.

Two passes: while the index is written every query scores its own shard (a
shard is ``SHARD`` consecutive blocks), which gives it a first k-th score;
then chunks of queries, carrying that score, meet all shards in blocks.
Nothing else is compared, and pruning only skips what cannot be a result.

Defined cases: rows with a null id, or a vector that is null or holds a null
or non-finite component take no part; of several rows with one id the one with
the smallest vector counts; vectors of different lengths are compared as if
the missing components were 0; scores outside 64 bits are held at the limit;
fewer than k candidates give all of them; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import written
from panelcast.llm.vectors import matrix, usable

BLOCK = 256  # rows of a block
SHARD = 16  # blocks of a shard
PIVOTS = 64  # rows that name the localities (picked by hash); they only order the rows
CHUNK = 512  # queries of a chunk
EXACT = 2.0**53


def _quantise(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as doubles where that is exact, else as Python integers."""
    w = np.floor(v * scale)
    if np.isfinite(w).all() and (not w.size or np.abs(w).max() < 2.0**26):
        return w
    return np.array([[int(np.floor(x * scale)) if np.isfinite(x * scale) else int(x) * scale for x in row] for row in v], dtype=object).reshape(v.shape)


def _packed(w: np.ndarray) -> bytes:
    import pickle

    return pickle.dumps(w)


def _unpacked(b: bytes) -> np.ndarray:
    import pickle

    return pickle.loads(b)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers."""
    if a.dtype != object and b.dtype != object and a.size and b.size \
            and np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = (lambda x: x if x.dtype == object else np.array([[int(y) for y in r] for r in x], dtype=object).reshape(x.shape))
    return whole(a) @ whole(b).T


class Best:
    """The k best (score, smaller id first) of some queries."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, i: int, scores, ids) -> None:
        if len(scores) > self.k:
            kth = self.rows[i][-1][0] if len(self.rows[i]) == self.k else None
            order = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[order], ids[order]
            if kth is not None and -kth > scores[0]:
                return
        self.rows[i] = sorted(self.rows[i] + [(-s, int(d)) for s, d in zip(scores.tolist(), ids.tolist(), strict=True)])[:self.k]

    def last(self, i: int):
        return self.rows[i][-1] if len(self.rows[i]) == self.k else None


def search_shard(queries: np.ndarray, query_ids: np.ndarray, floors: list, blocks: list, best: Best) -> None:
    """Scores the queries against blocks (ids, weights, high, low), best bound first, as far as bounds require.

    ``floors[i]`` is a (negated score, id) that a result has to beat or equal, or None.
    """
    if not len(queries) or not blocks:
        return
    high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bounds = _dot(up, high) + _dot(down, low)
    least = np.array([b[0].min() for b in blocks])
    order = np.argsort(-bounds, axis=1, kind="stable")
    for i in range(len(queries)):
        for j in order[i]:
            limits = [x for x in (floors[i], best.last(i)) if x is not None]
            bound = (-bounds[i, j], int(least[j]))
            if limits and bound > min(limits):
                if bound[0] > min(limits)[0]:
                    break  # no later block can do better either
                continue
            ids, weights = blocks[j][0], blocks[j][1]
            scores = _dot(queries[i:i + 1], weights)[0]
            other = ids != query_ids[i]
            best.add(i, scores[other], ids[other])


def _index(dim: int, scale: int, k: int, modulus: int):
    """Sorted rows of a partition to shards: packed blocks, and the shard's queries with their results so far."""
    def shard(part: int, number: int, ids: np.ndarray, v: np.ndarray):
        w = _quantise(v, scale)
        blocks = [(ids[a:a + BLOCK], w[a:a + BLOCK], w[a:a + BLOCK].max(axis=0), w[a:a + BLOCK].min(axis=0)) for a in range(0, len(ids), BLOCK)]
        asks = np.flatnonzero(ids % modulus == 0)
        best = Best(len(asks), k)
        search_shard(w[asks], ids[asks], [None] * len(asks), blocks, best)
        floors = [best.last(i) for i in range(len(asks))]
        return (part, number, _packed([(b[0], b[1], b[2], b[3]) for b in blocks]),
                _packed((ids[asks], w[asks], floors)) if len(asks) else None, len(asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, BLOCK * SHARD
        ids, v = np.zeros(0, np.int64), np.zeros((0, dim))

        def batch_of(row):
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=["part", "shard", "blocks", "asks", "n_asks"])

        for batch in batches:
            ids = np.concatenate([ids, np.asarray(batch.column(0))])
            v = np.concatenate([v, matrix(batch.column(1), dim)])
            while len(ids) >= size:
                yield batch_of(shard(part, number, ids[:size], v[:size]))
                ids, v, number = ids[size:], v[size:], number + 1
        if len(ids):
            yield batch_of(shard(part, number, ids, v))

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards' queries to chunks of up to CHUNK."""
    held: list = []

    def out():
        ids = np.concatenate([h[0] for h in held])
        kinds = {h[1].dtype for h in held}
        w = np.concatenate([h[1].astype(object) if len(kinds) > 1 else h[1] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([_packed((ids, w, [f for h in held for f in h[2]]))], pa.binary())], names=["asks"])

    for batch in batches:
        for b in batch.column(0).to_pylist():
            held.append(_unpacked(b))
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield out()
                held = []
    if held:
        yield out()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for asks, blocks in zip(batch.column("asks"), batch.column("blocks"), strict=True):
                ids, w, floors = _unpacked(asks.as_py())
                best = Best(len(ids), k)
                search_shard(w, ids, floors, _unpacked(blocks.as_py()), best)
                for q, floor, found in zip(ids.tolist(), floors, best.rows, strict=True):
                    rows += [(q, d, max(min(-int(s), 2**63 - 1), -2**63)) for s, d in found if floor is None or (s, d) <= floor]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _locality(rows: DataFrame, dim: int) -> Column:
    """Number of the pivot with the largest inner product; the pivots are PIVOTS rows, a fixed number."""
    pivots = [list(r.v) + [0.0] * (dim - len(r.v)) for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]

    @F.pandas_udf("int")
    def nearest(v):
        p, out = np.array(pivots), np.zeros((len(v), dim))
        for i, x in enumerate(v):
            out[i, :len(x)] = x
        with np.errstate(all="ignore"):
            return pd.Series(np.argmax(np.nan_to_num(out @ p.T), axis=1).astype("int32"))

    return nearest("v") if pivots else F.lit(0)


def top_k(vectors: DataFrame, *, k: int = 10, scale: int = 1024, modulus: int = 100, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest integer inner product for every row whose id is divisible by ``modulus``.

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    rows = written(usable(vectors, id_col, vector_col, zero=True), "topk-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim, spark = max(size.dim or 0, 1), vectors.sparkSession
    parts = max(1, -(-size.n // (BLOCK * SHARD)))
    ordered = rows.withColumn("near", _locality(rows, dim)).repartitionByRange(parts, "near", "id").sortWithinPartitions("near", "id")
    index = written(ordered.select("id", "v").mapInArrow(
        _index(dim, scale, k, modulus), "part int, shard int, blocks binary, asks binary, n_asks int"), "topk-index")
    chunks = (index.where("n_asks > 0").select("asks")
              .repartition(max(1, -(-size.n // (modulus * CHUNK)))).mapInArrow(_chunks, "asks binary"))
    groups = min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)  # copies of the queries
    shards = index.select(F.pmod(F.hash("part", "shard"), F.lit(groups)).alias("deal"), "blocks")
    everywhere = written(chunks, "topk-chunks").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # the copies look as small as the chunks that they are made of: without the hint the driver would gather and broadcast them all
    met = everywhere.hint("merge").join(shards, "deal").select("asks", "blocks")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
