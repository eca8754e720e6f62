"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that is at least ``max(min_length, 2 * q)`` long and that no
neighbouring word extends.  Templates, loops of a generator and pasted lists
show as runs; ``collapsed`` is the text without what repeats inside them.

Texts are looked at some megabytes at a time, inside the scan and without a
shuffle; a document is always whole.  Documents in which no 6-gram (half of
``min_length``) occurs again as close as a run needs it are put aside first:
they have no run.  For the others together:

1. **Re-Pair**, in rounds: every round replaces, wherever they occur, pairs of
   neighbouring symbols that are more frequent than the pairs they overlap
   with, until no pair occurs twice.  One grammar serves all documents of a
   piece, so what they share is looked at once.
2. **Runs crossing a boundary**, once per nonterminal X = Y Z, inside X; and
   between the symbols of each document's start rule, inside the document.  A
   run of period q that crosses a boundary has a block of about q / 2 words next
   to it that occurs again q words away.  Blocks of 4, 8, 16, ... words are
   named by doubling, the occurrences of a name give the candidate periods, and
   each candidate is extended both ways by binary search on prefix hashes.
3. **Translation** to every place where X was made, and **merging**: a run is
   found whole at the lowest symbol that holds it, so intervals inside another
   one of their period go, and of equal intervals the smallest period stays.

Defined cases: a null or empty text, or one without words, has no runs and an
empty collapsed text; null ids and repeated rows are documents like others; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import chunks
from panelcast.llm.common import text_or_empty

PRIMES = (2_147_483_647, 2_147_483_629)  # of the prefix hashes
BASES = (1_103_515_245, 1_664_525_007)
Interval = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


class Blocks:
    """Names of blocks of words: equal names, equal blocks of one document; -1 where a block occurs once in it."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.n = len(ids)
        sizes = np.diff(np.concatenate([[0], ends]))
        self.doc = np.repeat(np.arange(len(ends)), sizes)
        self.end = np.repeat(ends, sizes)
        self.length = 1
        self._name(np.arange(self.n), self.doc * (int(ids.max(initial=0)) + 1) + ids)

    def _name(self, at: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1 if len(group) else new
        self.at, group = at[again], group[again]  # by name and place
        self.names = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])).astype(np.int64) if len(group) else group
        self.name = np.full(self.n, -1, np.int64)
        self.name[self.at] = self.names
        self.key = self.names * (self.n + 1) + self.at
        gap = np.diff(self.at)
        same = self.names[1:] == self.names[:-1]
        self.next, self.previous = np.full(self.n, self.n + 1, np.int64), np.full(self.n, self.n + 1, np.int64)
        self.next[self.at[:-1][same]] = gap[same]
        self.previous[self.at[1:][same]] = gap[same]

    def join(self, other_name: np.ndarray, shift: int, length: int) -> None:
        """Names of blocks of ``length`` words: this block, and the one named by ``other_name`` ``shift`` words on."""
        at = np.sort(self.at)
        at = at[at + length <= self.end[at]]
        at = at[other_name[at + shift] >= 0]
        key = self.name[at] * (self.n + 1) + other_name[at + shift]
        self.length = length
        self._name(at, key)

    def grow(self, length: int) -> None:
        while self.length < length:
            self.join(self.name, self.length, 2 * self.length)


def may_have_runs(ids: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """Which documents may have a run; those left out have none.

    A run of period q and length n holds n - q words that occur again q words
    on, at least ``gram`` of them, so n - q - gram + 1 places in a row whose
    gram occurs again, the first at a distance of q <= n - q at most.
    """
    gram = max(1, -(-min_length // 2))
    blocks = Blocks(ids, ends)
    power = 1 << (gram.bit_length() - 1)
    names = {1: blocks.name}
    while blocks.length < power:
        blocks.grow(2 * blocks.length)
        names[blocks.length] = blocks.name
    if power < gram:
        # overlapping blocks of the same length cover the gram
        blocks.join(names[power], gram - power, gram)
    again = blocks.next <= blocks.n
    place = np.arange(blocks.n)
    stop = np.where(again, blocks.n, place)  # first place from here on without one
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    found = again & (blocks.next <= stop - place + gram - 1)
    return np.bincount(blocks.doc[found], minlength=len(ends)) > 0


class Grammar:
    """Re-Pair in rounds over the documents' word ids.

    ``left`` and ``total`` are the lengths of each nonterminal's left part and
    of the whole, ``first`` a place where it occurs; (``symbol``, ``place``)
    are all places where one was made.  ``cuts`` are the places between the
    symbols of the documents' start rules.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        words = int(ids.max(initial=0)) + 1
        seq, place = ids.astype(np.int64), np.arange(len(ids))
        last = np.zeros(len(ids), bool)
        last[ends[np.diff(np.concatenate([[0], ends])) > 0] - 1] = True
        made, total, left, first, count = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while len(seq) > 1:
            pair = np.flatnonzero(~last[:-1])
            code = seq[pair] * (words + count) + seq[pair + 1]
            _, which, n = np.unique(code, return_inverse=True, return_counts=True)
            weight = np.zeros(len(seq), np.uint64)  # 0 where no pair starts or it occurs once
            spread = (which.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)  # no order along the text
            weight[pair] = np.where(n[which] > 1, (np.minimum(n[which], 2**31).astype(np.uint64) << np.uint64(32)) | spread, np.uint64(0))
            # a stretch of one symbol is one candidate, of which every other pair is taken
            edge = np.flatnonzero(np.concatenate([[True], weight[1:] != weight[:-1]]))
            w, size = weight[edge], np.diff(np.append(edge, len(seq)))
            before, after = np.concatenate([[0], w[:-1]]).astype(np.uint64), np.concatenate([w[1:], [0]]).astype(np.uint64)
            best = (w > before) & (w > after)
            if not best.any():
                break
            start = np.repeat(edge, size)
            take = np.repeat(best, size) & ((np.arange(len(seq)) - start) % 2 == 0)
            at = np.flatnonzero(take)
            kind = np.full(len(seq), -1, np.int64)
            kind[pair] = which
            names, one, new = np.unique(kind[at], return_index=True, return_inverse=True)
            until = np.append(place, len(ids))
            made.append((count + new, place[at]))
            first.append(place[at[one]])
            left.append(until[at[one] + 1] - place[at[one]])
            total.append(until[np.minimum(at[one] + 2, len(seq))] - place[at[one]])
            seq[at] = words + count + new
            last[at] = last[at + 1]
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            seq, place, last = seq[keep], place[keep], last[keep]
            count += len(names)
        self.left, self.total, self.first = (np.concatenate(x) for x in (left, total, first))
        self.symbol = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int64)
        self.place = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)
        self.cuts = place[1:][~last[:-1]] if len(place) else place


class Matches:
    """How far two places of the text agree, by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for p, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(1, np.int64)
            step = base % p
            while len(power) <= len(ids):
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            power = power[:len(ids) + 1]
            value = (ids.astype(np.int64) * 0x9E3779B1 + 0x7F4A7C15) % p
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:-1] % p)]) % p)
            self.powers.append(power)

    def equal(self, a: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from ``a`` equal those from ``a + apart``."""
        out = np.ones(len(a), bool)
        for p, s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            out &= (s[a + n] - s[a]) % p * power[apart] % p == (s[a + apart + n] - s[a + apart]) % p
        return out

    def forward(self, a: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, apart, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, a: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before ``a``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, apart, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _scales(longest: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """(block, shortest, longest period): every run of such a period has a block of so many words beside any boundary it crosses."""
    k, found = 0, {}
    while 2 << k <= 2 * longest:
        matched = max(1 << k, -(-min_length // 2))  # words that occur again one period on, at least
        block = 1 << (((matched + 2) // 2).bit_length() - 1)
        found.setdefault(block, [1 << k, 0])[1] = (2 << k) - 1
        k += 1
    for block in sorted(found):
        yield block, *found[block]


def _candidates(blocks: Blocks, b: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundary, place, period): a block beside the boundary occurs again, one period on, inside low..high."""
    size = blocks.length
    for later, anchor in {(True, b_at) for b_at in (-size, -1)} | {(False, b_at) for b_at in (0, 1 - size)}:
        x = b + anchor
        near = blocks.next if later else blocks.previous
        fits = np.flatnonzero((x >= low) & (x + size <= high))
        fits = fits[near[x[fits]] <= most]
        x = x[fits]
        base = blocks.name[x] * (blocks.n + 1)
        if later:
            a, z = x + least, np.minimum(x + most, high[fits] - size)
        else:
            a, z = np.maximum(x - most, low[fits]), x - least
        some = np.flatnonzero(z >= a)
        base, a, z, x, fits = base[some], a[some], z[some], x[some], fits[some]
        i, j = np.searchsorted(blocks.key, base + a), np.searchsorted(blocks.key, base + z, side="right")
        n = np.maximum(j - i, 0)
        which = np.repeat(np.arange(len(x)), n)
        y = blocks.at[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + i[which]]
        yield fits[which], np.minimum(x[which], y), np.abs(y - x[which])


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows, sorted by column."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    if not len(order):
        return columns
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return tuple(c[new] for c in columns)


def find_runs(ids: np.ndarray, ends: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, period) of all runs, by document, start and period; starts and ends count from the first document's start."""
    grammar, matches, blocks = Grammar(ids, ends), Matches(ids), Blocks(ids, ends)
    doc = blocks.doc
    # boundaries: inside nonterminals, then between the symbols of the start rules
    inner = np.flatnonzero(grammar.total >= min_length)
    starts = np.concatenate([[0], ends])
    b = np.concatenate([grammar.first[inner] + grammar.left[inner], grammar.cuts])
    low = np.concatenate([grammar.first[inner], starts[doc[grammar.cuts]]])
    high = np.concatenate([grammar.first[inner] + grammar.total[inner], ends[doc[grammar.cuts]]])
    longest = int((high - low).max(initial=0)) // 2
    found: list[tuple[np.ndarray, ...]] = []
    for block, least, most in _scales(longest, min_length):
        blocks.grow(block)
        if not len(blocks.at):
            break
        for which, x, q in _candidates(blocks, b, low, high, least, most):
            lo, hi = low[which], high[which]
            e = x + q + matches.forward(x, q, hi - x - q)
            s = x - matches.backward(x, q, x - lo)
            long = e - s >= np.maximum(min_length, 2 * q)
            found.append((which[long], s[long], e[long], q[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    which, s, e, q = _distinct(*[np.concatenate(c) for c in zip(*found, strict=True)])
    which, s, e, q = _shortest_period(which, s, e, q)
    # every place where a nonterminal was made has its runs
    of_symbol = which < len(inner)
    order = np.argsort(grammar.symbol, kind="stable")
    symbols, places = grammar.symbol[order], grammar.place[order]
    symbol = inner[which[of_symbol]]
    i, j = np.searchsorted(symbols, symbol), np.searchsorted(symbols, symbol, side="right")
    n = j - i
    run = np.repeat(np.flatnonzero(of_symbol), n)
    moved = places[np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(i, n)] - np.repeat(grammar.first[symbol], n)
    s, e, q = (np.concatenate([c[~of_symbol], c[run] + m]) for c, m in ((s, moved), (e, moved), (q, 0)))
    return _merged(doc[s], s, e, q)


def _shortest_period(which, s, e, q):
    """Of rows equal but for the period (sorted), the first."""
    first = np.concatenate([[True], (which[1:] != which[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])]) if len(s) else np.zeros(0, bool)
    return which[first], s[first], e[first], q[first]


def _merged(doc, s, e, q):
    """Intervals that no other of their document and period holds."""
    order = np.lexsort((-e, s, q, doc))
    doc, s, e, q = doc[order], s[order], e[order], q[order]
    if len(s):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])])
        group = np.cumsum(new)
        span = int(e.max()) + 1
        reach = np.maximum.accumulate(group * span + e)
        held = np.concatenate([[False], reach[:-1] >= (group * span + e)[1:]]) & ~new
        doc, s, e, q = doc[~held], s[~held], e[~held], q[~held]
    doc, s, e, q = _shortest_period(*_distinct(doc, s, e, q))
    order = np.lexsort((q, s, doc))
    return doc[order], s[order], e[order], q[order]


def word_ids(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, and where each document ends."""
    names: dict[bytes, int] = {}
    number = names.setdefault
    ids = np.fromiter((number(w, len(names)) for words in documents for w in words), np.int64)
    return ids, np.cumsum([len(words) for words in documents], dtype=np.int64)


def runs_of(documents: list[list[bytes]], min_length: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start and period."""
    ids, ends = word_ids(documents)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not len(ids):
        return out
    chosen = np.flatnonzero(may_have_runs(ids, ends, min_length))
    if not len(chosen):
        return out
    starts = np.concatenate([[0], ends[:-1]])
    some = np.concatenate([ids[starts[d]:ends[d]] for d in chosen])
    some_ends = np.cumsum(ends[chosen] - starts[chosen])
    some_starts = np.concatenate([[0], some_ends[:-1]])
    for d, s, e, q in zip(*(c.tolist() for c in find_runs(some, some_ends, min_length)), strict=True):
        out[chosen[d]].append((s - int(some_starts[d]), e - s, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


RUNS = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _described(min_length: int, words_of: Callable[[int | None, bytes], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for piece in chunks.chunks_of(iter([batch]), chunks.PIECE_BYTES):
                ids, texts = piece.column("id").to_pylist(), piece.column("text").to_pylist()
                documents = [t.split() if words_of is None else words_of(i, t) for i, t in zip(ids, texts, strict=True)]
                runs = runs_of(documents, min_length)
                told = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(documents, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(w) for w in documents], pa.int64()), pa.array(told, kind), pa.array(kept, pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, min_length: int = 12, words_of: Callable[[int | None, bytes], list[bytes]] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length, period; by start and period) and collapsed text of every document.

    ``words_of(id, text)`` gives the words of a text where they are not simply
    those between ASCII white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_described(min_length, words_of), RUNS)
