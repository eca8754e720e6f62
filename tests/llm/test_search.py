import math
import random

import numpy as np
import pytest

from panelcast.llm import ann
from panelcast.llm.ann import hilbert_bytes, hilbert_keys, nearest
from panelcast.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(n=700, dim=9, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)], 0) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1) for i in range(150)] + [(2000 + i, [-x for x in same], 1) for i in range(20)]
    rows += [(3000, None, 0), (3100, [1.0, None] + [0.0] * 7, 0), (3200, [float("nan")] * 9, 0), (3300, [float("inf")] + [0.0] * 8, 0),
             (None, same, 0), (3400, [0.0] * 9, 0), (3500, [1.0, 2.0], 0), (3600, [], 0), (500, rows[500][1], 0), (600, [-9.0] * 9, 0)]
    return rows


def _usable(rows, zero):
    by = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        by[i] = min(by.get(i, v), v)
    return by


def _padded(a, b):
    n = max(len(a), len(b))
    return a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b))


def test_top_k_equals_brute_force(spark):
    rows = _vectors()
    use = {i: [math.floor(1024 * x) for x in v] for i, v in _usable(rows, True).items()}
    want = set()
    for q in (i for i in use if i % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(*_padded(use[q], v))), i) for i, v in use.items() if i != q)
        want |= {(q, rank, i, -int(s)) for rank, (s, i) in enumerate(scored[:10], 1)}
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == want


def test_top_k_small_large_and_empty(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    one = top_k(spark.createDataFrame([(0, [1.0], 0), (7, [2.0], 0)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(0, 1, 7, 1024 * 2048)]
    big = top_k(spark.createDataFrame([(0, [3e38, -1.0], 0), (1, [3e38, 1.0], 0), (2, [-3e38, 1.0], 0), (3, [1e7, 5.0], 0)], SCHEMA)).collect()
    assert [r.vec_id for r in big] == [1, 3, 2] and big[0].score == 2**63 - 1 and big[2].score == -2**63


def test_copies_of_the_queries_are_not_sent_to_the_driver(spark):
    """Files of a few kilobytes hold the queries, but every group of shards gets a copy: they are shuffled, not broadcast."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    out = top_k(spark.createDataFrame(_vectors(), SCHEMA))
    plan = out._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert out.count() and len(out.collect())
    assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()  # nor once sizes are known


def test_hilbert_keys_visit_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def _exact(rows, k=10):
    use, out = _usable(rows, False), {}
    for q in (i for i in use if i % 100 == 0):
        d = sorted((math.dist(*_padded(use[q], v)), i) for i, v in use.items() if i != q)
        out[q] = d[:k]
    return out


def test_nearest_is_exact_inside_its_window_and_with_copies(spark):
    rows = _vectors()
    want = _exact(rows)
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], rel=1e-12, abs=1e-300)


def test_recall_beyond_the_window(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    y = np.array([r[1] for r in rows])
    got = nearest(spark.createDataFrame(rows, SCHEMA), min_window=256, window_share=0.03).collect()
    hits = 0
    for q in range(0, 9000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / 900 >= 0.9


def test_bytes_sort_like_places():
    rng = np.random.default_rng(5)
    for dims, bits in ((8, 4), (3, 7), (1, 32), (2, 31)):
        cells = rng.integers(0, 1 << bits, (500, dims))
        keys, sortable = hilbert_keys(cells, bits), [b.tobytes() for b in hilbert_bytes(cells, bits)]
        assert sorted(range(500), key=lambda i: (int(keys[i]), i)) == sorted(range(500), key=lambda i: (sortable[i], i))  # noqa: B023


@pytest.mark.parametrize("noise", [0.01, 0.001, 0.00001])
def test_recall_inside_one_noisy_cluster(spark, monkeypatch, noise):
    monkeypatch.setattr(ann, "BLOCK", 64)  # windows of less than the cluster
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(1000, 64)) * noise / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    rows = [rows[i] for i in rng.permutation(3000)]
    y = np.array([r[1] for r in sorted(rows)])
    got = nearest(spark.createDataFrame(rows, SCHEMA), modulus=50, min_window=32, window_share=0.03).collect()
    hits = asked = 0
    for q in range(0, 3000, 150):  # those of the cluster
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hits, asked = hits + len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q}), asked + 10
    assert hits / asked >= 0.9


def test_nearest_small_and_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [0.0], 0)], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0
    assert [tuple(r) for r in nearest(spark.createDataFrame([(0, [1.0], 0), (5, [1.0], 0)], SCHEMA)).collect()] == [(0, 1, 5, 0.0)]


def test_blocks_of_the_index_are_handed_out_by_few(spark, monkeypatch):
    """A row that is ranked holds a block of a megabyte: Python never gets thousands of them at once."""
    import numpy as np

    from panelcast.llm import ann
    from panelcast.llm.common import small_batches

    rerank, widest = ann._rerank, spark.sparkContext.accumulator(0)

    def counting(dim, k):
        run = rerank(dim, k)

        def counted(batches):
            def seen():
                for b in batches:
                    if b.num_rows > ann.BLOCK_BATCH:
                        widest.add(1)
                    yield b

            return run(seen())

        return counted

    monkeypatch.setattr(ann, "_rerank", counting)
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ann.nearest(df, curves=2, min_window=64).count() == 150
    assert widest.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with small_batches(spark, 5):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "5"
