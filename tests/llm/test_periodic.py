"""Periodic runs: against trying every period; the grammar's rounds; edge cases; the query on the given table."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import periodic, queries

from conftest import SF_SMALL
from llm.helpers import docs


def brute(words, least):
    """(start, length, period) by trying every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def random_documents(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        kinds, n = rng.choice([1, 2, 3, 5, 30]), rng.choice([0, 5, 12, 30, 80, 150])
        words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 10)
            words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        out.append(words)
    return out


@pytest.mark.parametrize("least", [12, 2, 7])
def test_equals_trying_every_period(least):
    rng = random.Random(least)
    for _ in range(250):
        documents = random_documents(rng)
        for words, runs in zip(documents, periodic.runs_of(documents, least), strict=True):
            assert runs == brute(words, least)
            assert periodic.collapse(words, runs) == collapsed(words, runs)


def test_fibonacci_and_thue_morse_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    morse = [bytes([97 + bin(i).count("1") % 2]) for i in range(1024)]
    for words in (b, morse, [b"x"] * 1000):
        assert periodic.runs_of([words], 2) == [brute(words, 2)]


def test_grammar_derives_the_text():
    rng = random.Random(3)
    for _ in range(50):
        documents = random_documents(rng)
        ids, ends = periodic.word_ids(documents)
        g = periodic.Grammar(ids, ends)
        for symbol, place in zip(g.symbol.tolist(), g.place.tolist(), strict=True):
            first, n = g.first[symbol], g.total[symbol]
            assert np.array_equal(ids[place:place + n], ids[first:first + n]) and 0 < g.left[symbol] < n
            assert np.searchsorted(ends, place, side="right") == np.searchsorted(ends, place + n - 1, side="right")


def test_documents_put_aside_have_no_runs():
    rng = random.Random(8)
    for _ in range(200):
        documents = [d for d in random_documents(rng) if d]
        if documents:
            kept = periodic.may_have_runs(*periodic.word_ids(documents), 12)
            assert all(k or not brute(d, 12) for d, k in zip(documents, kept, strict=True))


def test_edge_rows(spark):
    loop = " ".join(["ein Wort", "und\tnoch"] * 40)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, loop), (4, loop), (None, loop), (5, "x " * 50_000), (6, "a b " * 12), (7, "short text")]
    table = docs(spark, rows).withColumns({"id": F.lit("clash"), "runs": F.lit(1), "collapsed": F.lit(2), "n_words": F.lit(3)})
    got = {(r.id, r.n_words): r for r in periodic.periodic_runs(table).collect()}
    assert len(got) == 8 and periodic.periodic_runs(table).count() == 9
    for i, text in rows:
        words = (text or "").encode().split()
        r = got[i, len(words)]
        runs = brute(words, 12) if len(words) < 1000 else [(0, 50_000, 1)]
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
        kept = collapsed(words, runs) if len(words) < 1000 else [b"x"]
        assert r.collapsed == b" ".join(kept).decode()
    assert periodic.periodic_runs(docs(spark, [])).collect() == []


def test_query_on_given_table(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    looped = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        r, runs = got[doc_id], brute(words, 12) if n < 3000 else None
        if runs is None:  # too long to try every period
            continue
        looped += bool(runs)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (None if top is None else 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    assert looped > 10
