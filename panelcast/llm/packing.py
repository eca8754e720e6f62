"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Best fit decreasing looks at documents only by length, so it is run once for
all documents of a length: the input to the packer is the number of pieces of
each length (at most ``max_tokens`` numbers, whatever the corpus), its output
a list of runs "pieces number s to e of length L go to bins b, b+1, ... at
offset o".  The packing is therefore the one that best fit decreasing over the
whole corpus gives; the corpus itself stays distributed.  A segment tree over
the remaining capacities finds the tightest open bin in logarithmic time.

Pieces are numbered within their length without gathering a length in one
task: each task numbers its own pieces, the tasks' counts give the offsets.

Defined cases: a null or empty text is one piece holding only the end token;
a null id is packed like any other; repeated rows are separate documents; an
empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import text_or_empty, written

PIECES = "part int, nth long, id long, piece int, start long, length long, ids_crc32 long"
REMEMBERED_BYTES = 96_000_000  # of words, and half as many of pre-tokens, whose ids a worker remembers; results don't depend on it
ENTRY_BYTES = 280  # of a remembered word beside its own bytes and its ids
BETWEEN = b"\xff" * 4
TEXT_BYTES = 4_000_000  # bytes of text (or one text) looked up at once


class Capacities:
    """Segment tree over 0..size: which remaining capacities have an open bin."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` with an open bin."""
        i = self.leaves + need
        if i >= 2 * self.leaves:
            return None
        while not self.any[i]:
            while i & 1:  # a right child: everything in this subtree is passed
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, end, bin, offset, per_bin) that place ``counts[length]`` pieces of each length.

    Piece number r with first <= r < end goes to bin ``bin + (r - first) // per_bin``
    at ``offset + (r - first) % per_bin * length``.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree, runs, bins = Capacities(size), [], 0

    def put(capacity: int, first_bin: int, n: int) -> None:
        if n and capacity:
            open_bins.setdefault(capacity, []).append((first_bin, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first_bin, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first_bin, n = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.set(capacity, False)
            fit = capacity // length
            full = min(n, left // fit)
            if full:
                runs.append((length, at, at + full * fit, first_bin, size - capacity, fit))
                put(capacity - fit * length, first_bin, full)
                at, left = at + full * fit, left - full * fit
            rest = min(left, fit) if full < n and left < fit else 0
            if rest:
                runs.append((length, at, at + rest, first_bin + full, size - capacity, rest))
                put(capacity - rest * length, first_bin + full, 1)
                at, left, full = at + rest, left - rest, full + 1
            put(capacity, first_bin + full, n - full)
    return runs


class Remembered:
    """The latest used of some keys' values: about ``size`` bytes, and what is looked up at once.

    Two generations of half that size: what is asked for moves to the younger
    one, and when that is full the older one is dropped.
    """

    def __init__(self, size: int):
        self.half, self.bytes = size // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Of ``keys``, those without a value; the others are in ``young`` until the next call."""
        if self.bytes > self.half:
            self.old, self.young, self.bytes = self.young, {}, 0
        new = keys.difference(self.young)
        unknown = new.difference(self.old)
        again = list(new.difference(unknown))
        values = list(map(self.old.__getitem__, again))
        self.put(again, values, sum(map(len, again)) + sum(map(len, values)))
        return list(unknown)

    def put(self, keys: list, values: list, size: int) -> None:
        """``size``: the length of all keys and values."""
        self.bytes += size + ENTRY_BYTES * len(keys)
        self.young.update(zip(keys, values, strict=True))


class WordIds:
    """Token ids of single words; a Python worker remembers some megabytes of them.

    Plain words (no code point from U+0250 on, no special token) are cut into
    the tokenizer's pre-tokens for many words at once, and only pre-tokens not
    seen before go through the tokenizer's merges.  Any other word goes
    through the whole tokenizer by itself.
    """

    PRETOKEN = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the tokenizer file's pattern

    def __init__(self, path: str):
        import json

        import numpy as np
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # bytes stand for themselves as printable characters, as byte-level BPE has it
        printable = {b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
        spare = iter(range(256, 512))
        self.shown = np.array([b if b in printable else next(spare) for b in range(256)], "<u4")
        self.shown[32] = 32  # the separator below
        spec = json.loads(self.merges.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        known_form = (suffix and [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                      and self.PRETOKEN.removeprefix("\\n|") in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"))
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        for token, i in vocabulary.items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.plain = regex.compile(r"[\x21-\x7e\u00a1-\u024f]+") if known_form else regex.compile(r"(?!)")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(self.PRETOKEN).findall
        self.words = Remembered(REMEMBERED_BYTES)
        self.pretokens = Remembered(REMEMBERED_BYTES // 2)

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        import numpy as np
        import pyarrow.compute as pc

        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + TEXT_BYTES)) + 1
            # white space never is part of a token here, so a text's ids are its words' ids
            docs = pc.ascii_split_whitespace(texts.slice(at, end - at).view(pa.string()))
            words = docs.flatten().dictionary_encode()  # a distinct word is looked up once
            names = words.dictionary.view(pa.binary()).to_pylist()
            self._learn(self.words.missing(set(names) - {b""}))  # beside white space at a text's ends the split has empty words
            self.words.young[b""] = b""
            ids = pa.array(list(map(self.words.young.__getitem__, names)), pa.binary()).take(words.indices)
            raw, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[np.asarray(docs.offsets)].tolist()
            at = end
            for first, last in zip(ends[:-1], ends[1:], strict=True):
                yield raw[first:last].to_pybytes()

    def _learn(self, words: list[bytes]) -> None:
        import numpy as np

        joined = b"\n".join(words).decode()
        plain, other = words, []
        if not (joined.isascii() or self.plain.fullmatch(joined.replace("\n", ""))) or any(s in joined for s in self.special) or any(
                c in joined for c in "\x1c\x1d\x1e\x1f\x7f"):
            plain, other = [], []
            for w in words:
                t = w.decode()
                (plain if self.plain.fullmatch(t) and not any(s in t for s in self.special) else other).append(w)
            joined = b"\n".join(plain).decode()
        if plain and self.plain.pattern == "(?!)":
            plain, other = [], words
        found = self.whole.encode_batch([w.decode() for w in other], add_special_tokens=False)
        values = [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        self.words.put(other, values, sum(map(len, other)) + sum(map(len, values)))
        if not plain:
            return
        cut = self.find(joined.lower())
        new = [p for p in self.pretokens.missing(set(cut)) if p != "\n"]
        for a in range(0, len(new), 4096):
            some = new[a:a + 4096]
            shown = self.shown[np.frombuffer(" ".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(some):
                raise RuntimeError("the tokenizer does not mark the ends of words")
            raw, ends = ids.tobytes(), ends.tolist()
            self.pretokens.put(some, [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)], len(shown) + len(raw))
        # ids have a zero byte among any four, so the mark between words is found nowhere else
        self.pretokens.young["\n"] = BETWEEN
        known = self.pretokens.young
        encoded = b"".join(map(known.__getitem__, cut))
        self.words.put(plain, encoded.split(BETWEEN), len(joined) + len(encoded))


def word_ids(path: str) -> WordIds:
    """The worker's memory of words; it outlives a task, results don't depend on it."""
    import sys
    import types

    store = sys.modules.setdefault("_panelcast_words", types.ModuleType("_panelcast_words")).__dict__
    if path not in store:
        store[path] = WordIds(path)
    return store[path]


def _pieces(tokenizer_path: str, max_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib
        from collections import Counter

        import numpy as np
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, part, seen = word_ids(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.uint32(end_id).astype("<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids = batch.column(0).to_pylist()
            for i, encoded in enumerate(ids_of.encoded(batch.column(1))):
                encoded += end
                for k, a in enumerate(range(0, len(encoded), step)):
                    piece = encoded[a:a + step]
                    n = len(piece) // 4
                    for c, v in zip(out, (part, seen[n], ids[i], k, a // 4, n, zlib.crc32(piece)), strict=True):
                        c.append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["part", "nth", "id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document and their places in the sequences.

    Columns: id, piece, start, length (tokens ``start .. start+length`` of the
    document's ids followed by ``end_id``), ids_crc32 (of the little-endian
    unsigned 32-bit ids), sequence_id, offset.

    The tokenizer must drop white space and split at it (as word-level BPE
    does), since words are encoded one by one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    pieces = written(source.mapInArrow(_pieces(tokenizer_path, max_tokens, end_id), PIECES), "pack-pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # at most max_tokens rows, whatever the corpus
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit_decreasing(totals, max_tokens),
                                 "length long, first long, end long, bin long, at long, per_bin long")
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    r = F.col("rank") - F.col("first")
    return (
        pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
        .join(runs, ["length"]).where("rank >= first and rank < end")
        .select("id", "piece", "start", "length", "ids_crc32",
                (F.col("bin") + F.floor(r / F.col("per_bin"))).alias("sequence_id"),
                (F.col("at") + F.pmod(r, F.col("per_bin")) * F.col("length")).alias("offset"))
    )
