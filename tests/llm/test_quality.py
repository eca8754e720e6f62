import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

import pytest

from panelcast.llm import quality
from tests.llm.helpers import docs, prose

LABELS = "doc_id long, quality int, toxic int"


class Model:
    """Interpolated modified Kneser-Ney over bytes, from the definition."""

    def __init__(self, texts, order):
        self.order, self.c = order, {order: Counter()}
        for t in texts:
            data = b"\n" * (order - 1) + t + b"\n"
            self.c[order].update(data[i:i + order] for i in range(len(data) - order + 1))
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.off = {}, {}, {}
        for k in range(1, order + 1):
            n = Counter(self.c[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else .5
            d = [1 - 2 * y * n[2] / n[1] if n[1] else .5, 2 - 3 * y * n[3] / n[2] if n[2] else 1., 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            self.d[k] = [min(max(x, .05), i - .05) for i, x in enumerate(d, 1)]
            total, off = defaultdict(float), defaultdict(float)
            for g, c in self.c[k].items():
                total[g[:-1]] += c
                off[g[:-1]] += self.d[k][min(c, 3) - 1]
            self.total[k], self.off[k] = total, off

    def p(self, gram):
        k = len(gram)
        shorter = self.p(gram[1:]) if k > 1 else 1 / 256
        if gram[:-1] not in self.total[k]:
            return shorter
        c, total = self.c[k][gram], self.total[k][gram[:-1]]
        return (max(c - self.d[k][min(c, 3) - 1], 0) if c else 0) / total + self.off[k][gram[:-1]] / total * shorter

    def bits(self, text):
        data = b"\n" * (self.order - 1) + text + b"\n"
        return -sum(math.log2(self.p(data[i:i + self.order])) for i in range(len(data) - self.order + 1)) / (len(text) + 1)


def _rows():
    rng = random.Random(9)
    rows = [(i, prose(i, rng.randint(10, 80)), ["en", "de", None][i % 3]) for i in range(120)]
    junk = [(200 + i, "".join(rng.choice("!@#$%^&*()XYZ0123456789") for _ in range(200)), "en") for i in range(15)]
    return rows + junk + [(300, None, "en"), (301, "", "de"), (None, prose(1, 30), "en"), (5, "a second text of the same id ###", "de"), (302, prose(7, 4000), "en")]


def _labels():
    return [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(200, 215)] + [(1, 1, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, None)]


def _bits(spark, rows, labels):
    trusted = quality.trusted_ids(spark.createDataFrame(labels, LABELS))
    left_out = {r.id for r in trusted.where(quality._left_out()).collect()}
    return {r.id for r in trusted.collect()}, left_out


def test_perplexities_equal_the_definition(spark):
    rows, labels = _rows(), _labels()
    trusted, left_out = _bits(spark, rows, labels)
    assert trusted == set(range(0, 120, 2))
    model = Model([(t or "").encode() for i, t, _ in rows if i in trusted - left_out], quality.ORDER)
    got = quality.classify(docs(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS), min_calibration=3).collect()
    want = sorted((i is None, i or 0, round(model.bits((t or "").encode()), 4)) for i, t, _ in rows)
    have = sorted((r.id is None, r.id or 0, round(r.bits_per_byte, 4)) for r in got)
    assert [w[:2] for w in want] == [h[:2] for h in have]
    assert [h[2] for h in have] == pytest.approx([w[2] for w in want], abs=2e-4)
    assert all(not r.kept for r in got if r.n_bytes == 0)
    assert not any(r.kept for r in got if r.id is not None and 200 <= r.id < 215)
    assert all(r.kept == (r.n_bytes > 0 and r.perplexity <= r.threshold) for r in got)
    assert sum(r.kept for r in got if r.id is not None and r.id < 120) >= 100


@pytest.mark.parametrize("most", [quality.BROADCAST_IDS, 1000])
def test_every_trusted_document_is_trained_on(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_IDS", most)
    rows = [(i, str(i * 7919 % 100_003), "en") for i in range(28_000)]
    left_out = {r.id for r in spark.range(28_000).where(quality._left_out()).collect()}
    assert len(rows) - len(left_out) > 22_000
    model = Model([t.encode() for i, t, _ in rows if i not in left_out], quality.ORDER)
    got = quality.classify(docs(spark, rows), spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], LABELS)).collect()
    have = {r.id: r.bits_per_byte for r in got}
    assert len(got) == len(rows) and [have[i] for i, _, _ in rows] == pytest.approx([model.bits(t.encode()) for _, t, _ in rows], abs=1e-6)


def test_distribution_sums_to_one(spark):
    texts = spark.createDataFrame([(t.encode(),) for t in (prose(1, 50), prose(2, 50))], "text binary")
    model = quality.KneserNey(texts)
    context = int.from_bytes(prose(1, 50).encode()[10:14], "big")
    p = model.probabilities(spark.createDataFrame([((context << 8) | b,) for b in range(256)], "gram long"))
    assert sum(r.p for r in p.collect()) == pytest.approx(1, rel=1e-9)


def test_thresholds_are_quantiles_of_trusted_text(spark):
    rng = random.Random(1)
    rows = [("en", rng.random() * 5) for _ in range(1000)] + [("de", 1.0 + i / 100) for i in range(10)] + [(None, 9.0)]
    limits = quality.thresholds(spark.createDataFrame(rows, "lang string, bits double"), 0.9, 100)
    got = {r.lang: r.threshold for r in limits.collect()}
    by = {lang: [math.ceil(round(b * 1000, 9)) / 1000 for k, b in rows if k == lang] for lang in ("en", "de", None)}
    at = lambda x, p: sorted(x)[math.ceil(p * len(x)) - 1]
    median = {k: at(x, 0.5) for k, x in by.items()}
    apart = {k: (at(x, 0.9) - median[k]) / NormalDist().inv_cdf(0.9) for k, x in by.items()}
    common = sum(len(x) * apart[k] for k, x in by.items()) / len(rows)
    spread = {k: (len(x) * apart[k] + 20 * common) / (len(x) + 20) for k, x in by.items()}
    far = [math.ceil(round((b - median[k]) / spread[k] * 100, 9)) for k, x in by.items() for b in x]
    z = max(NormalDist().inv_cdf(0.9), at(far, 0.9) / 100)
    assert got["en"] == pytest.approx(at(by["en"], 0.9))
    for lang in ("de", None):
        n = len(by[lang])
        limit = median[lang] + z * spread[lang] * math.sqrt(1 + 1 / n)
        assert got[lang] == pytest.approx((n / 100) ** 2 * at(by[lang], 0.9) + (1 - (n / 100) ** 2) * limit, abs=0.01)


def test_clean_languages_with_few_or_no_trusted_documents_are_kept(spark):
    other = str.maketrans("abcdefghijklmnopqrst", "αβγδεζηθικλμνξοπρστυ")
    third = str.maketrans("abcdefghijklmnopqrst", "абвгдежзийклмнопрсту")
    rows = [(i, prose(i, 40), "en") for i in range(150)] + [(200 + i, "".join(random.Random(i).choice("!@#$%^&*()XYZ") for _ in range(200)), "en") for i in range(10)]
    rows += [(1000 + i, prose(i, 40).translate(other), "el") for i in range(60)]
    rows += [(2000 + i, prose(i, 40).translate(third), None) for i in range(60)]
    rows += [(3000 + i, prose(i, 40).upper(), "de") for i in range(60)]
    left_out = {r.id for r in spark.range(3000, 3060).where(quality._left_out()).collect()}
    labels = [(i, 1, 0) for i in range(150)] + [(min(left_out), 1, 0)]  # one of de, which the model never saw
    got = quality.classify(docs(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS), min_calibration=10).collect()
    kept = Counter(r.lang for r in got if r.kept)
    assert kept["el"] == kept[None] == kept["de"] == 60
    assert {r.threshold for r in got if r.lang in ("el", None)} == {None}
    assert not any(r.kept for r in got if 200 <= r.id < 210) and kept["en"] >= 140


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    d = docs(spark, [(1, "some text"), (2, None)])
    assert [r.doc_id for r in quality.keep_good(d, none).collect()] == [1]
    assert quality.classify(docs(spark, []), none).count() == 0


def test_keep_good_keeps_rows_as_they_are(spark):
    from pyspark.sql import functions as F

    d = docs(spark, [(1, "some text"), (None, "no id"), (1, "some text")]).select("*", F.lit("x").alias("kept"), F.lit(1).alias("key"))
    out = quality.keep_good(d, spark.createDataFrame([(9, 1, 0)], LABELS))
    assert out.columns == d.columns and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))
