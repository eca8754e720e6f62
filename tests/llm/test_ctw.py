import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import ctw
from tests.llm.helpers import docs, prose


class Tree:
    """Context-tree weighting node by node, from the definition."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            data = b"\n" * depth + t + b"\n"
            for i in range(depth, len(data)):
                for node, bit in self.bits(data[i]):
                    for d in range(depth + 1):
                        self.n[data[i - d:i], node][bit] += 1
        self.children = defaultdict(set)
        for context, node in self.n:
            if context:
                self.children[context[1:], node].add((context, node))
        self.memo = {}

    @staticmethod
    def bits(byte):
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield node, bit
            node = 2 * node + bit

    def own(self, key):
        a, b = self.n[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)

    def block(self, key):
        if key not in self.memo:
            if len(key[0]) == self.depth:
                self.memo[key] = self.own(key)
            else:
                self.memo[key] = float(np.logaddexp(self.own(key), sum(self.block(c) for c in self.children[key]))) - math.log(2)
        return self.memo[key]

    def one(self, context, node):
        p, left = 0.0, 1.0
        for d in range(self.depth + 1):
            key = (context[len(context) - d:], node)
            seen = key in self.n and sum(self.n[key])
            longer = (context[len(context) - d - 1:], node)
            if not seen:
                return .5 if d == 0 else p
            a, b = self.n[key]
            if d == self.depth or not (longer in self.n and sum(self.n[longer])):
                return p + left * (b + .5) / (a + b + 1)
            stop = 1 / (1 + math.exp(min(700, sum(self.block(c) for c in self.children[key]) - self.own(key))))
            p += left * stop * (b + .5) / (a + b + 1)
            left *= 1 - stop

    def log10(self, text):
        data, total = b"\n" * self.depth + text + b"\n", 0.0
        for i in range(self.depth, len(data)):
            for node, bit in self.bits(data[i]):
                p = self.one(data[i - self.depth:i], node)
                total += math.log10(p if bit else 1 - p)
        return total


ROWS = [(i, prose(i, 25, 30)) for i in range(14)] + [(20, None), (21, ""), (22, " Straße \n\t ÀB  the"), (None, "no id here"), (3, prose(3, 25, 30)), (23, "x" * 400)]
LEARN = {0, 1, 2, 3, 4, 5, 6, 7, 21, 23}


@pytest.fixture(scope="module")
def scored(spark):
    return ctw.score_texts(docs(spark, ROWS).repartition(3), F.col("doc_id").isin(*LEARN)).collect()


def _norm(text):
    return b" ".join((text or "").encode().lower().split())


def test_scores_equal_the_definition(scored):
    tree = Tree([_norm(t) for i, t in ROWS if i in LEARN], ctw.DEPTH)
    want = sorted((i is None, i or 0, tree.log10(_norm(t))) for i, t in ROWS)
    have = sorted((r.id is None, r.id or 0, r.score) for r in scored)
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert [h[2] for h in have] == pytest.approx([w[2] for w in want], rel=1e-7)


def test_base_model_and_counts(scored):
    c = Counter()
    for i, t in ROWS:
        if i in LEARN:
            c.update([*_norm(t).split(), "end"])
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, t in ROWS:
        words = [*_norm(t).split(), "end"]
        want.append((i is None, i or 0, len(words), sum(c[w] > 0 for w in words), total,
                     round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in words), 9)))
    got = [(r.id is None, r.id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in scored]
    assert sorted(got) == sorted(want)


def test_probabilities_of_a_next_byte_sum_to_one(spark):
    context = int.from_bytes(b" the ", "big")
    rows = [((context << 8) | b, 3 * (b in b"cat")) for b in range(256)] + [((int.from_bytes(b"n the", "big") << 8) | 32, 9)]
    p = ctw.code_lengths(spark.createDataFrame(rows, "gram long, n long")).collect()
    assert sum(math.exp(r.value) for r in p if r.gram >> 8 == context) == pytest.approx(1, rel=1e-12)


def test_log_gamma():
    z = np.array([.5, 1, 1.5, 2, 7.25, 100.5, 1e6, 1e12])
    assert ctw.log_gamma(z) == pytest.approx([math.lgamma(x) for x in z], rel=1e-12, abs=1e-11)


def test_nothing_to_learn_and_empty_table(spark):
    r = ctw.score_texts(docs(spark, [(1, "ab")]), F.lit(False)).collect()[0]
    assert r.score == pytest.approx(24 * math.log10(.5)) and (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert ctw.score_texts(docs(spark, []), F.lit(True)).count() == 0
