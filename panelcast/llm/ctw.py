"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions.  A decision's node is (context, bits of
the byte so far); contexts are the last 0 to ``DEPTH`` bytes.  Every node has
a Krichevsky-Trofimov estimate from its counts of 0 and 1, and the weighted
block probability of a context is half its own estimate plus half the product
of its longer contexts'.  With the counts of the training texts fixed this
gives each node a posterior weight ``beta`` of stopping there, and the
probability of a bit is the mixture, over all depths, of the estimates on the
path of its context.  Where a longer context was never seen the mixture ends
at the longest one seen, so it remains a distribution.

The corpus is counted as distinct (context, byte) grams, which grow with it.
The tree is computed in subtrees: all grams that share their last ``SPLIT``
context bytes are in one partition; what lies above is at most 256 x 255
nodes, gathered on the driver.  Texts then get their grams' code lengths
through chunk requests (see ``chunks``).

A text is scored as its lower-cased words with single spaces between and an
end mark, which is also what the word-count base model sees.

Defined cases: a null or empty text is the end mark alone; a null id counts as
empty text when ids are hashed; rows are scored one by one, so repeated rows
get equal scores and count as often as they occur; without training texts
every bit has probability 1/2; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import chunks
from panelcast.llm.common import partitions_for, text_or_empty, written

DEPTH = 5  # bytes of the longest context
SPLIT = 2  # context bytes shared by a subtree that one task computes
GRAMS = 100_000  # grams of whole subtrees computed at once


def log_gamma(z: np.ndarray) -> np.ndarray:
    """log of the gamma function for z >= 1/2, by Stirling's series after a shift of 8."""
    z = np.asarray(z, dtype=float)
    shift = np.ones_like(z)
    for k in range(8):
        shift = shift * (z + k)
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log block probability of a zeros and b ones under the Krichevsky-Trofimov estimate."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1.0)


def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1.0)


def stopping(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its longer contexts'."""
    return 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


def weighted(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, longer) - math.log(2)


class Subtrees:
    """Nodes of depths SPLIT..DEPTH over grams (context bytes, byte) with counts n; keys are context << 8 | node."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        byte, context = grams & 255, grams >> 8
        bit = np.arange(8)[:, None]
        node = (1 << bit) | (byte >> (8 - bit))
        self.bits = (byte >> (7 - bit)) & 1
        self.keys, self.leaf = np.unique((context << 8) | node, return_inverse=True)
        self.leaf = self.leaf.reshape(8, -1)
        weight = np.broadcast_to(n, self.bits.shape)
        a = np.bincount(self.leaf.ravel(), np.where(self.bits == 0, weight, 0).ravel(), len(self.keys))
        b = np.bincount(self.leaf.ravel(), np.where(self.bits == 1, weight, 0).ravel(), len(self.keys))
        self.levels = [(a, b, None, None)]  # from DEPTH down to SPLIT: counts, log product of longer contexts, parents
        keys, block = self.keys, log_kt(a, b)
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            up = (((keys >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (keys & 255)
            keys, parent = np.unique(up, return_inverse=True)
            a, b, longer = (np.bincount(parent, x, len(keys)) for x in (a, b, block))
            self.levels.append((a, b, longer, parent))
            block = weighted(log_kt(a, b), longer)
        self.top, self.block = keys, block

    def sums(self) -> tuple[np.ndarray, ...]:
        """(key of one byte less than SPLIT, zeros, ones, log product) summed over this batch's subtrees."""
        up = (((self.top >> 8) & ((1 << (8 * (SPLIT - 1))) - 1)) << 8) | (self.top & 255)
        keys, parent = np.unique(up, return_inverse=True)
        a, b = self.levels[-1][:2]
        return (keys, *(np.bincount(parent, x, len(keys)) for x in (a, b, self.block)))

    def log_p(self, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log probability of each gram's byte, given (mixed so far, weight left, p) of the nodes above."""
        up = (((self.top >> 8) & 255) << 8) | (self.top & 255)
        mixed, left, p = (x[up] for x in top)
        parents = [None] + [level[3] for level in self.levels[1:]]
        for i in range(len(self.levels) - 1, -1, -1):
            a, b, longer, _ = self.levels[i]
            seen, kt = a + b > 0, one(a, b)
            p = np.where(seen, mixed + left * kt, p)
            if i:
                beta = stopping(log_kt(a, b), longer)
                mixed, left = mixed + left * beta * kt, left * (1 - beta)
                down = parents[i]
                mixed, left, p = mixed[down], left[down], p[down]
        of = p[self.leaf]
        return np.log(np.where(self.bits == 1, of, 1 - of)).sum(axis=0)


def _by_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of whole subtrees; rows arrive sorted by subtree."""
    mask = (1 << (8 * SPLIT)) - 1
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        grams = np.concatenate([grams, np.asarray(batch.column(0))])
        n = np.concatenate([n, np.asarray(batch.column(1))])
        if len(grams) >= GRAMS:
            tree = (grams >> 8) & mask
            cut = int(np.searchsorted(tree, tree[-1]))  # the last subtree may go on
            if cut:
                yield grams[:cut], n[:cut]
                grams, n = grams[cut:], n[cut:]
    if len(grams):
        yield grams, n


def _sums(batches):
    for grams, n in _by_subtrees(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in Subtrees(grams, n).sums()], names=["node", "a", "b", "longer"])


def _log_p(top):
    def run(batches):
        for grams, n in _by_subtrees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(Subtrees(grams, n).log_p(top))], names=["gram", "value"])

    return run


def code_lengths(counts: DataFrame) -> DataFrame:
    """(gram, value): log probability of each gram's byte after its context; counts has (gram, n), n may be 0."""
    spark = counts.sparkSession
    parts = partitions_for(counts.count(), 5 * GRAMS, spark)
    tree = F.pmod(F.shiftright("gram", 8), F.lit(1 << (8 * SPLIT)))
    laid = counts.withColumn("tree", tree).repartition(parts, "tree").sortWithinPartitions("tree").select("gram", "n")
    sums = laid.mapInArrow(_sums, "node long, a double, b double, longer double")
    a, b, longer = (np.zeros(1 << 16) for _ in range(3))
    # at most 256 x 255 rows
    for r in sums.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("longer").alias("longer")).collect():
        a[r.node], b[r.node], longer[r.node] = r.a, r.b, r.longer
    own = log_kt(a, b)
    block = np.where(a + b > 0, weighted(own, longer), 0.0)
    a0, b0, longer0 = (x.reshape(256, 256).sum(axis=0) for x in (a, b, block))
    beta0, kt0 = stopping(log_kt(a0, b0), longer0), one(a0, b0)
    mixed0, left0 = np.tile(beta0 * kt0, 256), np.tile(1 - beta0, 256)
    beta, kt = stopping(own, longer), one(a, b)
    top = (mixed0 + left0 * beta * kt, left0 * (1 - beta), np.where(a + b > 0, mixed0 + left0 * kt, np.tile(kt0, 256)))
    return laid.mapInArrow(_log_p(top), "gram long, value double")


def _texts(piece: pa.Table) -> list[list[bytes]]:
    return [t.lower().split() for t in piece.column("text").to_pylist()]


def _hash(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _grams(piece):
    codes, sizes = chunks.byte_grams([b" ".join(w) for w in _texts(piece)], DEPTH + 1)
    learn = np.repeat(piece.column("learn").to_numpy(zero_copy_only=False), sizes)
    every = np.unique(codes)
    yield every, np.zeros(len(every), np.int64)
    yield np.unique(codes[learn], return_counts=True)


def _words(piece):
    seen, counted = set(), Counter()
    for words, learn in zip(_texts(piece), piece.column("learn").to_pylist(), strict=True):
        if learn:
            counted.update(words)
        else:
            seen.update(words)
    names = list(seen - counted.keys())
    yield _hash(names), np.zeros(len(names), np.int64)
    yield _hash(list(counted)), np.fromiter(counted.values(), np.int64, len(counted))


SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, kinds: int, ends: int):
    def run(piece: pa.Table, tables) -> pa.Table:
        texts = _texts(piece)
        index: dict[bytes, int] = {}
        flat = np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), np.int64, sum(map(len, texts)))
        c = tables["words"][_hash(list(index))]
        least = total + kinds + 1
        logs, known = np.log10((np.append(c, ends) + 1) / least), np.append(c, ends) > 0
        sizes = np.array([len(t) for t in texts]) + 1
        at = np.full(sizes.sum(), len(index))  # the end mark, where no word stands
        word = np.ones(len(at), bool)
        word[np.cumsum(sizes) - 1] = False
        at[word] = flat
        codes, n = chunks.byte_grams([b" ".join(w) for w in texts], DEPTH + 1)
        score = chunks.per_text(tables["grams"][codes], n) / (chunks.FIXED * math.log(10))
        return pa.table({"id": piece.column("id"), "n_tokens": pa.array(sizes, pa.int64()),
                         "n_known": pa.array(chunks.per_text(known[at].astype(np.int64), sizes).astype(np.int64)),
                         "base_score": pa.array(chunks.per_text(logs[at], sizes)), "score": pa.array(score)})

    return run


def score_texts(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) for every row.

    ``learn`` says which rows the model and the word counts are learned from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    grams = written(chunks.ask(rows, _grams), "ctw-grams")
    words = written(chunks.ask(rows, _words), "ctw-words")
    values = written(code_lengths(written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "ctw-counts")), "ctw-values")
    word_counts = written(words.groupBy("gram").agg(F.sum("n").alias("value")), "ctw-words-counts")
    t = word_counts.agg(F.sum("value").alias("n"), F.count(F.when(F.col("value") > 0, 1)).alias("v")).first()
    ends = docs.where(F.coalesce(learn, F.lit(False))).count()
    total, kinds = int(t.n or 0) + ends, t.v + (ends > 0)
    answers = {"grams": grams.join(values, "gram").select("chunk", "gram", chunks.fixed(F.col("value")).alias("value")),
               "words": words.join(word_counts, "gram").select("chunk", "gram", "value")}
    return chunks.score(rows, answers, _score(total, kinds, ends), SCORES).withColumn("train_tokens", F.lit(total).cast("long"))
