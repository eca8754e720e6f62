"""Tree regressors (decision tree, random forest, gradient-boosted trees) for every series at once.

The reference fits one model per series and horizon.  Here a group (a series,
or all of them with ``tree_mode="pooled"``) is one key of a table of training
rows, and all models come from it:

1. Features are cut into ``BINS`` bins per group, at the quantiles of a normal
   distribution with the feature's mean and deviation over the training rows.
   Labels become whole numbers, in parts of the group's largest one.  Nothing
   depends on the scale of the data.
2. Trees are grown level by level from histograms: per node, feature and bin
   the number of training rows and the sum of their labels.  Sums of whole
   numbers are exact, so the trees do not depend on how rows are laid out, on
   which series are hot or on the path taken.
3. Bootstrap and subsampling weights come from an MD5 of the row's key, tree
   and seed, the features that a forest's node may split on from one of the
   node's number.
4. Groups of at most ``LOCAL_ROWS`` training rows are grown whole, many to a
   task.  A larger group is packed into chunks of ``CHUNK_ROWS`` rows, of which a
   task holds some; every level is one pass over the chunks, each task adds its
   chunks' histograms up, and their sums (trees x nodes x features x bins numbers,
   whatever the group's length) give the splits and the last one's the leaves.
   Boosting takes a pass per level and round, and one a round that writes the
   chunks with what the round's tree leaves of the labels.
5. Rows are scored in place.  For every tree, feature and bin the model has a
   mask of the leaves that stay within reach; the masks of a row's bins have one
   leaf in common, so a prediction is a sum over trees of one ``&`` per feature
   and one look-up, a native expression.

Hyper-parameters are the reference's fixed values (depth 5; forest and
boosting subsample 0.8; the library defaults for the rest: 20 trees with a
third of the features per node, 20 rounds with step 0.1 on twice the residual).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import ordered
from panelcast.session import fresh_path, remove_path
from panelcast.sources.panel import SERIES, TIEBREAK, TS

# --- fixed values: regressor names and their settings ----------------------
LINEAR = "LinearRegression"
DECISION_TREE = "DecisionTreeRegression"
RANDOM_FOREST = "RandomForestRegression"
GBT = "GBTRegression"
REGRESSORS = (DECISION_TREE, LINEAR, RANDOM_FOREST, GBT)
TREE_DEPTH = 5
SUBSAMPLING = 0.8
TREES = 20
STEP = 0.1

BINS = 32
LEAVES, INNER = 2**TREE_DEPTH, 2**TREE_DEPTH - 1
PARTS = 2**32  # of a group's largest label that labels and predictions are counted in
MOMENT_DIGITS = 6  # of a mean in deviations; sums of doubles differ in the last digits from layout to layout
CUTS = [round(NormalDist().inv_cdf(j / BINS), 9) for j in range(1, BINS)]
LOCAL_ROWS = 200_000  # training rows of a group that one task holds
CHUNK_ROWS = 8_192  # training rows of a chunk of a larger group, and of what is looked at together in a smaller one
BATCH_CHUNKS = 16  # that Python gets at once
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST_BYTES = 64_000_000  # of the models of all large groups; beyond, they are joined by a shuffle


def tree_count(regressor: str) -> int:
    return 1 if regressor == DECISION_TREE else TREES


# --- training rows -----------------------------------------------------------
def bin_of(t: Column) -> Column:
    """The number of cut points below a standardised feature, by comparisons that compile."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(t > F.lit(CUTS[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, BINS - 1).cast("tinyint")


def _standardised(f: str, j: int) -> Column:
    """A feature in deviations from its mean; 0 where it does not vary."""
    return F.when(F.col("deviation")[j] > 0, F.col(f) / F.col("deviation")[j] - F.col("centre")[j]).otherwise(F.lit(0.0))


def group_scales(rows: DataFrame, features: Sequence[str], labels: Sequence[tuple[str, str]]) -> DataFrame:
    """(grp, centre, deviation, unit): per feature the mean in deviations, and the deviation; the largest label.

    ``rows`` are training rows at some horizon, ``labels`` (label, train flag).
    """
    largest = F.greatest(*[F.when(F.col(flag), F.abs(F.col(y))) for y, flag in labels], F.lit(0.0))
    moments = [e for j, f in enumerate(features) for e in (F.avg(f).alias(f"m{j}"), F.stddev_pop(f).alias(f"d{j}"))]
    found = rows.groupBy("grp").agg(*moments, F.max(largest).alias("unit"))
    centre = [F.when(F.col(f"d{j}") > 0, F.round(F.col(f"m{j}") / F.col(f"d{j}"), MOMENT_DIGITS)).otherwise(0.0) for j in range(len(features))]
    return found.select("grp", F.array(*centre).alias("centre"), F.array(*[F.col(f"d{j}") for j in range(len(features))]).alias("deviation"),
                        F.when(F.col("unit") > 0, F.col("unit")).otherwise(1.0).alias("unit"))


def row_draws(trees: int, seed: int) -> Column:
    """Bytes of which four each give one tree's draw for a row."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({TS} AS TIMESTAMP_NTZ))")
    name = F.concat_ws("|", F.col(SERIES), micros, F.col(TIEBREAK).cast("string"), F.lit(seed))
    return F.concat(*[F.unhex(F.md5(F.concat_ws("|", name, F.lit(i)))) for i in range(-(-trees // 4))])


def training_rows(df: DataFrame, features: Sequence[str], targets: dict, regressor: str, seed: int, pooled: bool) -> tuple[DataFrame, DataFrame]:
    """``(rows, scales)``: grp, bins, y (one per horizon, null where the row does not train), draws; and ``group_scales``."""
    labels = [(label, flag) for label, flag, _ in targets.values()]
    some = F.col(labels[0][1])
    for _, flag in labels[1:]:
        some = some | F.col(flag)
    x = df.withColumn("grp", F.lit("all") if pooled else F.col(SERIES)).where(some)
    x = x.select("grp", SERIES, TS, TIEBREAK, *[F.col(f).cast("double").alias(f) for f in features], *[c for pair in labels for c in pair])
    scales = group_scales(x, features, labels)
    y = [F.when(F.col(flag), F.floor(F.col(label) / F.col("unit") * PARTS + 0.5)).cast("bigint") for label, flag in labels]
    draws = F.lit(b"") if regressor == DECISION_TREE else row_draws(tree_count(regressor), seed)
    rows = x.join(scales, "grp").select("grp", F.array(*[bin_of(_standardised(f, j)) for j, f in enumerate(features)]).alias("bins"),
                                        F.array(*y).alias("y"), draws.alias("draws"))
    return rows, scales


def weights(draws: np.ndarray, regressor: str) -> np.ndarray:
    """How often a row counts in each tree, from its draws (unsigned 32-bit numbers): (rows, trees)."""
    if regressor == GBT:
        return (draws < SUBSAMPLING * 2**32).astype(np.int64)
    below, total = [], 0.0  # with replacement: Poisson counts, eight at most
    for k in range(8):
        total += math.exp(-SUBSAMPLING) * SUBSAMPLING**k / math.factorial(k)
        below.append(total * 2**32)
    return np.searchsorted(np.array(below), draws.ravel(), side="right").reshape(draws.shape)


# --- growing -------------------------------------------------------------------
def allowed_features(p: int, seed: int) -> np.ndarray:
    """(trees, nodes, features): a forest's node may split on a third of the features, rounded up."""
    out = np.zeros((TREES, INNER, p), bool)
    for t in range(TREES):
        for node in range(INNER):
            order = sorted(range(p), key=lambda f: (hashlib.md5(f"{t}|{node}|{f}|{seed}".encode()).hexdigest(), f))
            out[t, node, order[:math.ceil(p / 3)]] = True
    return out


def histograms(bins: np.ndarray, node: np.ndarray, n: np.ndarray, s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(trees, width, features, bins) rows and sums of a level; ``node`` (rows, trees) counts within it.

    The sums of one call stay below 2**53, so that they are exact.
    """
    (rows, p), trees = bins.shape, n.shape[1]
    size = trees * width * BINS
    out = [np.zeros((trees, width, p, BINS), np.int64) for _ in range(2)]
    place = (np.arange(trees) * width + node) * BINS
    for f in range(p):
        slot = (place + bins[:, f, None]).ravel()
        for o, value in zip(out, (n, s), strict=True):
            o[:, :, f] = np.bincount(slot, value.ravel(), size).astype(np.int64).reshape(trees, width, BINS)
    return out[0], out[1]


def best_splits(n: np.ndarray, s: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(trees, width) feature (-1: no split) and bin of the largest reduction of squared error; ties to the first feature and bin."""
    trees, width, p, _ = n.shape
    nl, sl = np.cumsum(n, axis=3).astype(float), np.cumsum(s, axis=3)
    na, sa = n.sum(axis=3, keepdims=True).astype(float), s.sum(axis=3, keepdims=True)
    sr, sl = (sa - sl).astype(float), sl.astype(float)
    nr = na - nl
    apart = sl * nr - sr * nl  # exactly 0 where both sides have one mean
    with np.errstate(all="ignore"):
        gain = apart * apart / (nl * nr * na)
    gain = np.where((nl > 0) & (nr > 0), gain, 0.0)
    if allowed is not None:
        gain = np.where(allowed[:, :, :, None], gain, 0.0)
    gain = gain.reshape(trees, width, p * BINS)
    best = np.argmax(gain, axis=2)
    found = np.take_along_axis(gain, best[:, :, None], axis=2)[:, :, 0] > 0
    return np.where(found, best // BINS, -1), np.where(found, best % BINS, 0)


def leaf_of(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int = TREE_DEPTH) -> np.ndarray:
    """(rows, trees): the node that a row reaches in each tree after ``depth`` steps, counted within its level.

    ``feature`` and ``at`` are (trees, INNER) in heap order; an unsplit node passes everything left.
    """
    tree, node = np.arange(len(feature)), np.zeros((len(bins), len(feature)), np.int64)
    for _ in range(depth):
        f = feature[tree, node]
        node = 2 * node + 1 + ((f >= 0) & (np.take_along_axis(bins, np.maximum(f, 0), axis=1) > at[tree, node]))
    return node - (2**depth - 1)


def leaf_values(n: np.ndarray, s: np.ndarray, step: float) -> np.ndarray:
    """A leaf's mean, times ``step``, as a whole number (0 without rows)."""
    mean = np.divide(s.astype(float), n.astype(float), out=np.zeros(n.shape), where=n > 0)
    return np.floor(mean * step + 0.5).astype(np.int64)


def _parts(rows: int) -> list[slice]:
    """Stretches of ``CHUNK_ROWS`` rows, one at least."""
    return [slice(a, a + CHUNK_ROWS) for a in range(0, max(rows, 1), CHUNK_ROWS)]


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray | None = None, allowed: np.ndarray | None = None, step: float = 1.0,
         y: np.ndarray | None = None):
    """Trees over rows that one task holds: (feature, at) (trees, INNER) and value (trees, LEAVES).

    ``n`` and ``s`` (rows, trees) are how often a row counts, and its label times that; instead of ``s`` the
    labels ``y`` (rows) do.  What is as long as rows times trees is only made for some rows at once.
    """
    trees = n.shape[1]

    def counted(part: slice) -> tuple[np.ndarray, np.ndarray]:
        own = n[part].astype(np.int64)
        return own, own * y[part, None] if s is None else s[part]

    def level(depth: int, part: slice) -> tuple[np.ndarray, np.ndarray]:
        return histograms(bins[part], leaf_of(bins[part], feature, at, depth), *counted(part), 2**depth)

    def leaves(part: slice) -> list[np.ndarray]:
        leaf = leaf_of(bins[part], feature, at) + np.arange(trees) * LEAVES
        return [np.bincount(leaf.ravel(), v.ravel(), trees * LEAVES).astype(np.int64).reshape(trees, LEAVES) for v in counted(part)]

    def total(of) -> list[np.ndarray]:
        out = None
        for part in _parts(len(bins)):
            found = of(part)
            out = list(found) if out is None else [o + f for o, f in zip(out, found, strict=True)]
        return out

    feature, at = np.full((trees, INNER), -1), np.zeros((trees, INNER), np.int64)
    for depth in range(TREE_DEPTH):
        here = slice(2**depth - 1, 2 ** (depth + 1) - 1)
        sums = total(lambda part, depth=depth: level(depth, part))
        feature[:, here], at[:, here] = best_splits(*sums, None if allowed is None else allowed[:, here])
    return feature, at, leaf_values(*total(leaves), step)


def boosted_labels(y: np.ndarray, so_far: np.ndarray, t: int) -> np.ndarray:
    """What tree t of a boosting learns."""
    return y if t == 0 else 2 * (y - so_far)


def predicted(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum over trees of the leaves' values."""
    return np.take_along_axis(value.T, leaf_of(bins, feature, at), axis=0).sum(axis=1)


def fit_rows(regressor: str, bins: np.ndarray, y: np.ndarray, w: np.ndarray | None, seed: int):
    """(feature, at, value) of one group's trees at one horizon, from its rows."""
    p = bins.shape[1]
    if regressor == DECISION_TREE:
        return grow(bins, np.ones((len(y), 1), np.int8), y=y)
    if regressor == RANDOM_FOREST:
        return grow(bins, w, allowed=allowed_features(p, seed), y=y)
    out, so_far = [], np.zeros(len(y), np.int64)
    for t in range(TREES):
        tree = grow(bins, w[:, t, None], step=1.0 if t == 0 else STEP, y=boosted_labels(y, so_far, t))
        so_far = so_far + np.concatenate([predicted(bins[part], *tree) for part in _parts(len(bins))])
        out.append(tree)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def masks_of(feature: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """(trees, features, bins): which of the leaves 1.. a row with that bin may still reach, as bits 0..; none left means leaf 0."""
    masks = np.full((len(feature), p, BINS), 2 ** (LEAVES - 1) - 1, np.int64)
    for node in range(INNER):
        depth = (node + 1).bit_length() - 1
        span = LEAVES >> depth
        first = (node + 1 - 2**depth) * span
        bits = lambda a, z: (1 << max(z - 1, 0)) - (1 << max(a - 1, 0))  # noqa: E731  leaves a..z-1
        left, right = bits(first, first + span // 2), bits(first + span // 2, first + span)
        f = feature[:, node]
        goes_right = (f[:, None, None] == np.arange(p)[:, None]) & (np.arange(BINS) > at[:, node, None, None])
        goes_left = (f[:, None, None] == np.arange(p)[:, None]) & ~goes_right | (f < 0)[:, None, None]
        masks &= np.where(goes_right, ~left, -1) & np.where(goes_left, ~right, -1)
    return masks


MODEL = "grp string, horizon int, feature array<int>, at array<int>, value array<bigint>, masks array<int>"


def _model_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(grp, horizon, feature, at, value, p) to rows of ``MODEL``."""
    columns: list[list] = [[] for _ in range(6)]
    for grp, horizon, feature, at, value, p in rows:
        for c, v in zip(columns, (grp, horizon, feature.ravel(), at.ravel(), value.ravel(), masks_of(feature, at, p).ravel()), strict=True):
            c.append(v)
    kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MODEL.split(", ")])


NO_LABEL = -(2**62)


def _unpacked(table: pa.Table, p: int, horizons: int, regressor: str):
    """bins (rows, p), y (rows, horizons; ``NO_LABEL`` where the row does not train) and weights (rows, trees); one byte a bin and weight."""
    bins, y = np.empty((table.num_rows, p), np.int8), np.empty((table.num_rows, horizons), np.int64)
    w = None if regressor == DECISION_TREE else np.empty((table.num_rows, TREES), np.int8)
    a = 0
    for batch in table.to_batches(max_chunksize=CHUNK_ROWS):
        here = slice(a, a + batch.num_rows)
        bins[here] = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        y[here] = batch.column("y").flatten().fill_null(NO_LABEL).to_numpy(zero_copy_only=False).reshape(-1, horizons)
        if w is not None:
            draws = np.frombuffer(b"".join(batch.column("draws").to_pylist()), ">u4").reshape(batch.num_rows, -1)[:, :TREES]
            w[here] = weights(draws.astype(np.int64), regressor)
        a += batch.num_rows
    return bins, y, w


def _fit_group(regressor: str, p: int, horizons: list[int], seed: int):
    """All horizons of one group that a task holds."""
    def fit(key, table):
        bins, y, w = _unpacked(table, p, len(horizons), regressor)
        out = []
        for i, h in enumerate(horizons):
            at = y[:, i] != NO_LABEL
            if at.any():
                out.append((key[0].as_py(), h, *fit_rows(regressor, bins[at], y[at, i], None if w is None else w[at], seed), p))
        return pa.Table.from_batches([_model_batch(out)])

    return fit


# --- groups larger than a task ---------------------------------------------------
CHUNK = "grp string, bins binary, y binary, w binary"


def _packed(grp: str, bins: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> pa.RecordBatch:
    """One chunk; weights that are 0 or 1 (boosting) as bits."""
    w = b"" if w is None else w.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([grp]), *[pa.array([x], pa.binary()) for x in (bins.astype(np.int8).tobytes(), y.tobytes(), w)]],
                                      names=["grp", "bins", "y", "w"])


def _chunks(regressor: str, p: int, horizons: int, size: int):
    """Rows sorted by group to packed chunks of at most ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, of = [], 0, None

        def packed():
            bins, y, w = _unpacked(pa.Table.from_batches(held), p, horizons, regressor)
            if w is not None:
                w = np.packbits(w.astype(bool), axis=1) if regressor == GBT else w.astype(np.int8)
            return _packed(of, bins, y, w)

        for batch in batches:
            grp = batch.column("grp").to_pylist()
            a = 0
            while a < len(grp):
                z = a
                while z < len(grp) and grp[z] == grp[a]:
                    z += 1
                if held and (grp[a] != of or rows >= size):
                    yield packed()
                    held, rows = [], 0
                z = min(z, a + size - rows)
                of = grp[a]
                held.append(batch.slice(a, z - a))
                rows, a = rows + z - a, z
        if held:
            yield packed()

    return run


STATE = "grp string, horizon int, feature binary, at binary, value binary"
PARTIAL = "grp string, horizon int, n binary, s binary"


def _each_chunk(batches: Iterator[pa.RecordBatch], p: int):
    """(grp, bins, y, w, [(horizon, feature, at, value)]) of chunks joined with their group's trees; arrays are views."""
    for batch in batches:
        grp, bins, y, w, trees = batch.columns
        for i in range(batch.num_rows):
            b = np.frombuffer(bins[i].as_buffer(), np.int8).reshape(-1, p)
            known = [(t["horizon"], *[np.frombuffer(t[c], np.int64).reshape(-1, width) for c, width in (("feature", INNER), ("at", INNER), ("value", LEAVES))])
                     for t in trees[i].as_py()]
            yield grp[i].as_py(), b, np.frombuffer(y[i].as_buffer(), np.int64).reshape(len(b), -1), np.frombuffer(w[i].as_buffer(), np.uint8), known


def _partials(regressor: str, p: int, horizons: list[int], depth: int, tree: int):
    """Each task's histograms of a level, added up over its chunks; ``tree`` is the first one being grown."""
    width = 2**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}

        def told():
            for (g, h), (n, s) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([h], pa.int32()), pa.array([n.tobytes()], pa.binary()),
                                                  pa.array([s.tobytes()], pa.binary())], names=[f.split()[0] for f in PARTIAL.split(", ")])
            sums.clear()

        for grp, bins, y, w, known in _each_chunk(batches, p):
            bins = bins.astype(np.int64)
            if regressor == GBT:
                drawn = (w.reshape(len(bins), -1)[:, tree // 8] >> (7 - tree % 8)) & 1 == 1
            for horizon, feature, at, _ in known:
                label = y[:, horizons.index(horizon)]
                use = label != NO_LABEL
                if regressor == GBT:  # y is what is left of the labels after the trees before
                    use &= drawn
                    feature, at = feature[tree:tree + 1], at[tree:tree + 1]
                x, label = bins[use], label[use, None]
                if regressor == RANDOM_FOREST:
                    own = w.reshape(len(bins), -1)[use].astype(np.int64)
                else:
                    own = np.ones(label.shape, np.int64)
                if tree:
                    label = 2 * label
                n, s = histograms(x, leaf_of(x, feature, at, depth), own, own * label, width)
                if (grp, horizon) not in sums:
                    if len(sums) >= 64:
                        yield from told()
                    sums[grp, horizon] = [np.zeros_like(n), np.zeros_like(s)]
                sums[grp, horizon][0] += n
                sums[grp, horizon][1] += s
        yield from told()

    return run


def _left(regressor: str, p: int, horizons: list[int], tree: int):
    """The chunks with what the boosting's ``tree`` leaves of their labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, bins, y, w, known in _each_chunk(batches, p):
            x, y, now = bins.astype(np.int64), y.copy(), slice(tree, tree + 1)
            for horizon, feature, at, value in known:
                i = horizons.index(horizon)
                y[:, i] = np.where(y[:, i] == NO_LABEL, NO_LABEL, y[:, i] - predicted(x, feature[now], at[now], value[now]))
            yield _packed(grp, bins, y, w)

    return run


def split_sums(n: np.ndarray, s: np.ndarray, feature: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trees, 2 * width) rows and sums on the two sides of each node's split, from its histograms; unsplit nodes are all left."""
    out = []
    for x in (n, s):
        total = x[:, :, 0].sum(axis=2)
        one = np.take_along_axis(x, np.maximum(feature, 0)[:, :, None, None], axis=2)[:, :, 0]
        below = np.take_along_axis(np.cumsum(one, axis=2), at[:, :, None], axis=2)[:, :, 0]
        below = np.where(feature >= 0, below, total)
        out.append(np.stack([below, total - below], axis=2).reshape(len(x), -1))
    return out[0], out[1]


def _advanced(regressor: str, p: int, depth: int, tree: int, seed: int):
    """A group's trees with one more level, and after the last one their leaves' values, from the tasks' histograms and the trees so far.

    The histograms are added up as they come, ``BATCH_CHUNKS`` tasks' at once, however many tasks there are.
    """
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = 1 if regressor != RANDOM_FOREST else TREES
        n, s = (np.zeros((trees, 2**depth, p, BINS), np.int64) for _ in range(2))
        known: dict[str, bytes] = {}
        for batch in batches:
            for c, total in (("n", n), ("s", s)):
                for x in batch.column(c):
                    if x.is_valid:
                        total += np.frombuffer(x.as_buffer(), np.int64).reshape(total.shape)
            for c in ("feature", "at", "value"):
                known.update((c, x.as_py()) for x in batch.column(c) if x.is_valid)
        feature, at, value = (np.frombuffer(known[c], np.int64).reshape(-1, width).copy() for c, width in (("feature", INNER), ("at", INNER), ("value", LEAVES)))
        now, here = slice(tree, tree + trees), slice(2**depth - 1, 2 ** (depth + 1) - 1)
        allowed = allowed_features(p, seed)[:, here] if regressor == RANDOM_FOREST else None
        feature[now, here], at[now, here] = best_splits(n, s, allowed)
        if depth == TREE_DEPTH - 1:
            value[now] = leaf_values(*split_sums(n, s, feature[now, here], at[now, here]), STEP if regressor == GBT and tree else 1.0)
        yield pa.RecordBatch.from_pydict({"grp": [key[0].as_py()], "horizon": pa.array([key[1].as_py()], pa.int32()),
                                          **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("feature", feature), ("at", at), ("value", value))}})

    return run


def _finished(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, horizon, *arrays in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                feature, at, value = (np.frombuffer(x, np.int64).reshape(-1, width) for x, width in zip(arrays, (INNER, INNER, LEAVES), strict=True))
                out.append((grp, horizon, feature, at, value, p))
            if out:
                yield _model_batch(out)

    return run


@contextmanager
def _few_records(spark) -> Iterator[None]:
    """Queries that start inside hand Python ``BATCH_CHUNKS`` chunks at once; the session's setting comes back."""
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(BATCH_CHUNKS))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def _fit_large(rows: DataFrame, sizes: DataFrame, regressor: str, p: int, horizons: list[int], seed: int, local_rows: int) -> DataFrame:
    """Models of groups that no task holds: a pass over their chunks per level; boosting: per round one per level, and one that leaves the residuals."""
    spark = rows.sparkSession

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    # dealt out by rows, not by group; equal keys and draws are equal rows
    dealt = rows.join(sizes.select("grp"), "grp").repartitionByRange("grp", "draws", "bins", "y").sortWithinPartitions("grp")
    chunks, chunks_path = written(dealt.mapInArrow(_chunks(regressor, p, len(horizons), min(local_rows, CHUNK_ROWS)), CHUNK), "tree-chunks")
    trees = tree_count(regressor)
    empty = [np.full((trees, INNER), -1, np.int64), np.zeros((trees, INNER), np.int64), np.zeros((trees, LEAVES), np.int64)]
    state, state_path = written(sizes.select("grp", F.explode(F.array(*[F.lit(h).cast("int") for h in horizons])).alias("horizon"),
                                             *[F.lit(x.tobytes()).alias(c) for c, x in zip(("feature", "at", "value"), empty, strict=True)]), "tree-state")
    state_bytes = sizes.count() * len(horizons) * sum(x.nbytes for x in empty)

    def known() -> DataFrame:
        """Each chunk with its group's trees so far."""
        small = state.groupBy("grp").agg(F.collect_list(F.struct("horizon", "feature", "at", "value")).alias("trees"))
        small = F.broadcast(small) if state_bytes <= BROADCAST_BYTES else small
        return chunks.join(small, "grp").select("grp", "bins", "y", "w", "trees")

    with _few_records(spark):
        for tree in range(trees if regressor == GBT else 1):
            if tree:
                used = chunks_path
                chunks, chunks_path = written(known().mapInArrow(_left(regressor, p, horizons, tree - 1), CHUNK), "tree-chunks")
                remove_path(spark, used)
            for depth in range(TREE_DEPTH):
                partials, used = known().mapInArrow(_partials(regressor, p, horizons, depth, tree), PARTIAL), state_path
                both = partials.unionByName(state, allowMissingColumns=True)
                state, state_path = written(both.groupBy("grp", "horizon").applyInArrow(_advanced(regressor, p, depth, tree, seed), STATE), "tree-state")
                remove_path(spark, used)
    models, _ = written(state.mapInArrow(_finished(p), MODEL), "tree-models")
    remove_path(spark, chunks_path)
    remove_path(spark, state_path)
    return models


# --- fit and score -----------------------------------------------------------------
def fit_grouped_trees(df: DataFrame, features: Sequence[str], targets: dict, regressor: str, seed: int | None = None,
                      pooled: bool = False, local_rows: int | None = None) -> DataFrame:
    """One row per group: grp, centre, deviation, unit, and per horizon ``value_h`` and ``masks_h`` (with feature_h, at_h the trees).

    The fit runs here; the rows returned are a written table in the shared folder.
    """
    spark, seed, p, horizons = df.sparkSession, 0 if seed is None else seed, len(features), list(targets)
    local_rows = local_rows or LOCAL_ROWS
    rows, scales = training_rows(df, features, targets, regressor, seed, pooled)
    path = {name: fresh_path(spark, f"tree-{name}") for name in ("rows", "scales", "fitted")}
    scales.write.parquet(path["scales"])
    scales = spark.read.schema(scales.schema).parquet(path["scales"])
    rows.write.parquet(path["rows"])
    rows = spark.read.schema(rows.schema).parquet(path["rows"])
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > local_rows)
    fit = _fit_group(regressor, p, horizons, seed)
    if large.limit(1).count():
        small = rows.join(large, "grp", "left_anti").groupBy("grp").applyInArrow(fit, MODEL)
        models = small.unionByName(_fit_large(rows, large, regressor, p, horizons, seed, local_rows))
    else:
        models = rows.groupBy("grp").applyInArrow(fit, MODEL)
    wide = models.groupBy("grp").agg(*[F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h}")
                                       for h in horizons for c in ("feature", "at", "value", "masks")])
    scales.join(wide, "grp").write.parquet(path["fitted"])
    remove_path(spark, path["rows"])
    return spark.read.parquet(path["fitted"])


def tree_prediction(features: Sequence[str], h, regressor: str) -> Column:
    """The prediction of a row that has its group's model and its bins ``_bin_j`` (null without a model or features)."""
    def reached(t: int) -> Column:
        mask = None
        for j in range(len(features)):
            m = F.get(f"masks_{h}", F.lit((t * len(features) + j) * BINS) + F.col(f"_bin_{j}"))
            mask = m if mask is None else mask.bitwiseAND(m)
        # leaf l has bit l - 1; 0 is leaf 0, and 0 - 1 has all 64 bits
        leaf = F.pmod(F.bit_count((mask - 1).cast("bigint")) + 1, F.lit(65))
        return F.get(f"value_{h}", F.lit(t * LEAVES) + leaf)

    # one term per tree rather than an aggregate over them: only this is compiled
    total = reached(0)
    for t in range(1, tree_count(regressor)):
        total = total + reached(t)
    mean = total / F.lit(float(TREES)) if regressor == RANDOM_FOREST else total.cast("double")
    return F.when(_present(features) & F.col(f"masks_{h}").isNotNull(), mean * (F.col("unit") / F.lit(float(PARTS))))


def _present(features: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return out


def score_rows(x: DataFrame, columns: list[str], features: Sequence[str], predictions: dict, regressor: str) -> DataFrame:
    """``columns`` of rows joined with their group's model, and a prediction per horizon (``predictions``: h -> name)."""
    model = ["centre", "deviation", "unit", *[f"{c}_{h}" for h in predictions for c in ("value", "masks")]]
    binned = x.select(*columns, *model, *[bin_of(_standardised(f, j)).cast("int").alias(f"_bin_{j}") for j, f in enumerate(features)])
    return binned.select(*columns, *[tree_prediction(features, h, regressor).alias(name) for h, name in predictions.items()])


def score_piece(piece: DataFrame, blocked: bool, models: DataFrame, features: Sequence[str], predictions: dict, regressor: str, pooled: bool) -> DataFrame:
    """A piece's rows with their predictions, where they are; only the model table moves."""
    models = models.drop(*[c for c in models.columns if c.startswith(("feature_", "at_"))])
    if pooled:
        x = piece.withColumn("grp", F.lit("all")).join(F.broadcast(models), "grp", "left")  # one row
    elif blocked:
        per_block = piece.select(SERIES, ordered.BLOCK).distinct().join(models.withColumnRenamed("grp", SERIES), SERIES, "left")
        x = piece.join(per_block, [SERIES, ordered.BLOCK], "left")
    else:
        x = piece.join(models.withColumnRenamed("grp", SERIES), SERIES, "left")
    return score_rows(x, piece.columns, features, predictions, regressor)


def models_report(models: DataFrame, horizons) -> DataFrame:
    """(grp, horizon, feature, at, value): each group's trees as arrays."""
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{c}_{h}").alias(c) for c in ("feature", "at", "value")]) for h in horizons]))
    return models.select("grp", rows.alias("m")).where("m.feature is not null").select("grp", "m.*")


def fit_score_trees(pieces, features: Sequence[str], targets: dict, regressor: str, mode: str = "per_series",
                    seed: int | None = None):
    """Fit one model per series and target (or per target, ``mode="pooled"``) and score every row.

    ``pieces`` is ``[(features_df, blocked)]``; ``targets`` maps
    ``h -> (label_col, train_flag_col, prediction_col)``.  Pieces keep their
    rows and partitioning; only the tree table is joined to them.  Returns
    ``(scored_pieces, models)``.
    """
    if mode not in ("per_series", "pooled"):
        raise ValueError(f"unknown tree mode {mode!r}")
    every = pieces[0][0]
    for f, _ in pieces[1:]:
        every = every.unionByName(f)
    pooled = mode == "pooled"
    models = fit_grouped_trees(every, features, targets, regressor, seed, pooled)
    predictions = {h: t[2] for h, t in targets.items()}
    scored = [(score_piece(piece, blocked, models, features, predictions, regressor, pooled), blocked) for piece, blocked in pieces]
    return scored, models_report(models, list(targets))
