"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its ``top`` most frequent character
n-grams (one to three code points of lower-cased letters, with one space
between words) over all training texts.  A text's own list is compared with
each profile by the out-of-place distance: for each of its n-grams the
difference of the two ranks, or ``top`` where the profile lacks it.  The
nearest language wins, ties go to the smaller name.  The score is one minus
the distance over the largest possible distance.

Counting runs inside the scan, per task; only (language, n-gram, count) rows
are shuffled.  Profiles reach the tasks in bands of at most ``BAND``
languages, so what is sent has a fixed size; further bands are further passes
over the texts in the same stage.

Defined cases: a null text, or one without letters, is ``und`` with score 0,
as is every text when nothing could be learned; rows whose language or text
is null are not learned from; whole texts are used, whatever their length;
rows are independent, so repeated rows get equal results; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAND = 512  # languages compared in one pass
ROWS = 512  # texts handled at once in a task
CHARS = 4_000_000  # characters handled at once in a task (or one text)
POINT = 21  # bits of a code point


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, as many at a time as fit the limits."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= ROWS or n + len(t) > CHARS):
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t)
    if first < len(texts):
        yield first, texts[first:]


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) over the texts, ordered by owner and n-gram; owner[i] < 2**9 is text i's."""
    empty = np.zeros(0, np.int64)
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    if not points:
        return empty, empty, empty
    flat = np.concatenate(points)
    who = np.repeat(owner, [len(p) for p in points])
    kinds, ids = np.unique(flat, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in kinds])
    flat = np.where(letters[ids], flat, 32)
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == 32) & (flat[:-1] == 32)
    edge = np.concatenate([[0], np.cumsum([len(p) for p in points])[:-1]])
    same[edge] = False  # each text keeps its own leading space
    flat, who = flat[~same], who[~same]
    alphabet, ids = np.unique(flat, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    bits = int(len(alphabet)).bit_length()
    space = flat == 32
    keys = []
    for n in (1, 2, 3):
        m = len(ids) - n + 1
        if m <= 0:
            break
        gram, ok = np.zeros(m, np.int64), ~space[:m] if n == 1 else np.ones(m, bool)
        for k in range(n):
            gram = (gram << bits) | ids[k:m + k]
            if k:  # two spaces in a row: a border between texts
                ok &= ~(space[k - 1:m + k - 1] & space[k:m + k])
        keys.append(((who[:m].astype(np.int64) << (3 * bits)) | gram)[ok])
    key = np.sort(np.concatenate(keys)) if keys else empty
    if not len(key):
        return empty, empty, empty
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    key = key[start]
    gram, wide = key & ((1 << (3 * bits)) - 1), np.zeros(len(key), np.int64)
    points_of = np.concatenate([[0], alphabet.astype(np.int64)])
    for k in (2, 1, 0):
        wide = (wide << POINT) | points_of[(gram >> (k * bits)) & ((1 << bits) - 1)]
    return key >> (3 * bits), wide, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(parts):
        codes, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, some in _runs(texts):
            names = sorted(set(langs[first:first + len(some)]))
            number = {v: i for i, v in enumerate(names)}
            owner = np.array([number[v] for v in langs[first:first + len(some)]], np.int64)
            who, gram, n = gram_counts(some, owner)
            for i, name in enumerate(names):
                mine = who == i
                parts = held.setdefault(name, [])
                parts.append((gram[mine], n[mine]))
                if len(parts) > 16:
                    held[name] = [merged(parts)]
        if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
            yield from _emit(held, merged)
            held = {}
    yield from _emit(held, merged)


def _emit(held, merged):
    for name, parts in held.items():
        codes, n = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = 400) -> DataFrame:
    """Profiles (lang, gram, rank): ranks from 0, at most ``top`` per language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = W.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    return (counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= top)
            .select("lang", "gram", (F.col("rank") - 1).alias("rank")))


def _nearest(profiles: dict[str, tuple[np.ndarray, np.ndarray]], top: int):
    """Improves (lang, distance, possible) of every row by one band of languages."""
    names = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[n][0] for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, len(names)), -1, np.int32)  # last row: in no profile
    for j, n in enumerate(names):
        ranks[np.searchsorted(grams, profiles[n][0]), j] = profiles[n][1]

    def nearest(texts):
        best, dist, most = [None] * len(texts), [0] * len(texts), [0] * len(texts)
        for first, some in _runs(texts):
            who, gram, n = gram_counts(some, np.arange(len(some)))
            order = np.argsort((who << 54) | ((1 << 54) - 1 - n), kind="stable")
            who, gram = who[order], gram[order]
            begin = np.searchsorted(who, np.arange(len(some)))
            rank = np.arange(len(who)) - begin[who]
            keep = rank < top
            who, gram, rank = who[keep], gram[keep], rank[keep]
            at = np.searchsorted(grams, gram)
            at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams)
            there = ranks[at]
            away = np.where(there < 0, top, np.abs(there - rank[:, None]))
            edges = np.searchsorted(who, np.arange(len(some) + 1))
            sums = np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum(away, axis=0, dtype=np.int64)])
            sums = sums[edges[1:]] - sums[edges[:-1]]
            for i in np.flatnonzero(edges[1:] > edges[:-1]):
                j = int(np.argmin(sums[i]))
                best[first + i], dist[first + i] = names[j], int(sums[i, j])
                most[first + i] = int(edges[i + 1] - edges[i]) * top
        return best, dist, most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, dist = batch.column("lang").to_pylist(), batch.column("dist").to_pylist()
            best, away, most = nearest(texts)
            for i, name in enumerate(best):
                if name is not None and (lang[i] is None or (away[i], name) < (dist[i], lang[i])):
                    lang[i], dist[i] = name, away[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(lang, pa.string()), pa.array(dist, pa.int64()), pa.array(most, pa.int64())],
                names=["row", "text", "lang", "dist", "most"])

    return run


def identify(docs: DataFrame, profiles: DataFrame, *, keep: dict[str, Column], text_col: str = "text",
             top: int = 400) -> DataFrame:
    """``keep``'s columns plus lang_pred and score for every row of ``docs``."""
    row = F.struct(*[c.alias(n) for n, c in keep.items()])
    out = docs.select(row.alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"),
                      F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("most"))
    schema = out.schema
    numbered = profiles.withColumn("band", F.floor((F.dense_rank().over(W.orderBy("lang")) - 1) / BAND)).cache()
    try:
        last = numbered.agg(F.max("band")).first()[0]
        for band in range(0 if last is None else int(last) + 1):
            found: dict[str, list] = {}
            for r in numbered.where(F.col("band") == band).collect():  # at most BAND * top rows
                found.setdefault(r.lang, []).append((r.gram, r.rank))
            arrays = {n: (np.array([g for g, _ in v], np.int64), np.array([k for _, k in v], np.int32)) for n, v in found.items()}
            out = out.mapInArrow(_nearest(arrays, top), schema)
    finally:
        numbered.unpersist()
    return out.select("row.*", F.coalesce("lang", F.lit("und")).alias("lang_pred"),
                      F.when(F.col("most") > 0, 1 - F.col("dist") / F.col("most")).otherwise(0.0).alias("score"))
