import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelcast.llm.packing import Capacities, best_fit_decreasing, pack_documents
from tests.llm.helpers import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """How full the bins are under best fit decreasing, document by document (open bins with equal room are alike)."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        b = min(fits, key=lambda b: b[0]) if fits else None
        if b is None:
            b = [size, []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
    return sorted(sum(b[1]) for b in bins)


def test_segment_tree_finds_the_tightest_capacity():
    rng, t, have = random.Random(1), Capacities(100), set()
    for _ in range(3000):
        c = rng.randint(0, 100)
        t.set(c, c not in have)
        have ^= {c}
        need = rng.randint(0, 101)
        assert (t.tightest(need) if need <= 100 else None) == min((x for x in have if x >= need), default=None)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_best_fit_decreasing_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 257])
    lengths = [rng.randint(1, size) if rng.random() < 0.6 else rng.randint(1, max(1, size // 6)) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, seen = {}, {n: set() for n in counts}
    for length, first, end, at_bin, at, per_bin in best_fit_decreasing(counts, size):
        for r in range(first, end):
            assert r not in seen[length]
            seen[length].add(r)
            bins.setdefault(at_bin + (r - first) // per_bin, []).append((at + (r - first) % per_bin * length, length))
    assert all(seen[n] == set(range(c)) for n, c in counts.items())
    for b in bins.values():  # gapless from 0
        end = 0
        for at, length in sorted(b):
            assert at == end
            end += length
        assert end <= size
    assert sorted(sum(n for _, n in b) for b in bins.values()) == one_by_one(lengths, size)


ODD = ["", None, " \t\n ", "a", "Don't STOP it's 'quoted' 12,345 %%% <|endoftext|>x<|startoftext|>", "naïve Ünïcode ΣΑΣ İstanbul straße",
       "é combining  nbsp em\x85nel \x1c\x1f ctl\x00\x01", "日本語 текст עברית 👍🏽👩‍👩‍👧", "x" * 30_000, "| | || ...!!", "²³¹ ½ Ⅷ ٣"]


def test_pieces_equal_direct_encoding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i, 40 * i)) for i in range(60)] + [(None, "no id"), (100, prose(0, 7)), (7, ODD[7])]
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            p = ids[k:k + 2048]
            want.append((i, k // 2048, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    got = pack_documents(docs(spark, rows).repartition(4), PATH).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [at for at, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))]
        assert sum(n for _, n in b) <= 2048
    assert sorted(sum(n for _, n in b) for b in bins.values()) == one_by_one([w[3] for w in want], 2048)


def test_empty_table(spark):
    assert pack_documents(docs(spark, []), PATH).count() == 0


def test_words_are_looked_up_once_for_each_distinct_one(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelcast.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "  a b ", "\x0b\x0cfoo\r\nbar\t", "Ünïcode ☃ 漢字 x  y", " \n ", "<|endoftext|> hi\x1cthere", "x" * 5000, "\x85z\x00q", "ab ab ab " * 9000]
    column = pa.array([b"before", *[t.encode() for t in texts]], pa.binary()).slice(1)
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (10, 4_000_000):
        monkeypatch.setattr(packing, "TEXT_BYTES", size)
        got = list(packing.WordIds(path).encoded(column))
        assert [list(memoryview(b).cast("I")) for b in got] == want
    assert list(packing.WordIds(path).encoded(pa.array([], pa.binary()))) == []
    import tracemalloc

    words, long = packing.WordIds(path), pa.array([b"ab cd " * 500_000], pa.binary())
    list(words.encoded(long))
    tracemalloc.start()
    list(words.encoded(long))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6, most  # a million words, of which two are distinct, are not a million objects
