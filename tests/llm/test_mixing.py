import random

import pytest

from panelcast.llm.mixing import mix, plan_mix
from tests.llm.helpers import docs, prose


def water_fill(sizes, weights, epochs):
    """Reshare round by round until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else rest * w[s] / open_w for s in names}
        above = {s for s in names if s not in capped and target[s] > epochs * sizes[s]}
        if not above:
            return target
        capped |= above


def _rows():
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(0, 60)), "en", rng.choice(["a", "b", "ß", "z", "Z", None, "tiny"][: 6]) if i % 40 else "tiny")
            for i in range(600)]
    return rows + [(1000, None, "en", "a"), (1001, "", "en", "empty"), (None, "one two", "en", "b"), (5, "again", "en", "a")]


@pytest.fixture(scope="module")
def planned(spark):
    return plan_mix(docs(spark, _rows())).collect()


def test_targets_equal_iterative_water_filling(planned):
    sizes = {}
    for _, text, _, source in _rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water_fill(sizes, (1, 2, 3), 3)
    assert {r.source for r in planned} == set(want)
    for r in planned:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)


def test_taken_words_come_near_the_targets(planned):
    by = {}
    for r in planned:
        assert 0 <= r.reps <= 3 and r.taken == r.size * r.reps
        t = by.setdefault(r.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest / 2 + 1e-6


def test_reruns_and_layout_do_not_matter(spark, planned):
    again = plan_mix(docs(spark, _rows()[::-1]).repartition(5)).collect()
    key = lambda r: (str(r.id), str(r.source), r.size, r.reps, r.target)
    assert sorted(map(key, again)) == sorted(map(key, planned))


def test_mix_repeats_rows_and_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    d = docs(spark, _rows()).select("*", F.lit(1).alias("size"), F.lit(2).alias("target"), F.lit("h").alias("h"), F.lit(0).alias("doc"))
    out = mix(d)
    assert out.columns == d.columns
    reps = sum(r.reps for r in plan_mix(d).collect())
    assert out.count() == reps
    assert out.select("size", "target", "h", "doc").distinct().count() == 1


def test_empty_table_and_only_empty_texts(spark):
    assert plan_mix(docs(spark, [])).count() == 0
    r = plan_mix(docs(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(x.size, x.target, x.taken) for x in r] == [(0, 0.0, 0)] * 2
