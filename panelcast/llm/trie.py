"""Prefix trie of conversations, built from vertical bitmaps.

A node at depth d is a distinct sequence of d turns (role, text); its members
are the conversations that start with it.  A turn is known by 128 bits of
hashes, a node by its depth and four sums (modulo 2**32) of hashes of its turns
with their positions, so that nothing needs the texts after the first scan.

Conversations are cut into bands of ``BAND`` positions.  Rows (conversation,
band) are sorted by the node they enter the band at, their first turn there
and conversation, and dealt out by ranges, so that those that share prefixes
are neighbours and a prefix shared by very many is split.  Neighbours form
shards of at most ``SHARD`` conversations.  A shard holds an index from
(position, turn) to the bitset of its conversations; depth-first, the
intersection of a node's bitset with the postings of the next position yields
its children, popcounts their members, and the bitset of the conversations
that end there their end lists.  Nodes of several shards are then added up.

Sums over subtrees follow chains: the nodes with one smallest member are a path
of that conversation, and the chains form a tree of low height.  Totals of
chains go up it by pointer doubling (as many rounds as its height has binary
digits), and along a chain by sums of blocks of ``BLOCK`` nodes.

Defined cases: rows without conv_id are left out (a member must have a name);
a null role or text is empty; a null turn number comes first, ties are ordered
by role, then text; repeated rows are turns of their own; a conversation
without turns is a member of the root; an empty table gives no rows, not even
the root; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import numbered, written

BAND = 256  # positions of a band
SHARD = 1024  # conversations of a shard
BLOCK = 1024  # nodes of a chain that one window adds up
CHUNK = 65_536  # members whose ids are joined to one text
LOW = 0xFFFFFFFF


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, nth (from 0), a, b (hashes of the turn), bytes (of the text) from conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                     role.alias("role"), text.alias("text"))
    # the start of a text does not contradict its order
    return numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")],
                    [F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64))], "trie-turns",
                    [F.col("conv_id"), F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
                     F.octet_length("text").cast("long").alias("bytes")])


def conversations_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as they are, and (conv_id, length) of their conversations."""
    return turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def regrafted(turns: DataFrame, *, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first one of their group.

    With h = crc32(decimal conv_id) % (most + 1), conversation c has the first
    h turns of conversation c - c % group (all if fewer, none without it), then
    its own after its first h.  Turns and conversations as ``conversations_of``.
    """
    turns, sizes = conversations_of(turns)
    sizes = written(sizes, "trie-sizes")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    wanted = sizes.select("conv_id", "length", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("giver"))
    given = sizes.select(F.col("conv_id").alias("giver"), F.col("length").alias("has"))
    plans = wanted.join(given, "giver", "left").select(
        "conv_id", "giver", "h", "length", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    plans = written(plans, "trie-plans")
    columns = ["conv_id", "nth", "a", "b", "bytes"]
    own = (turns.join(plans.select("conv_id", "h", "taken"), "conv_id").where("nth >= h")
           .withColumn("nth", F.col("nth") - F.col("h") + F.col("taken")).select(*columns))
    gifts = (turns.where(F.col("nth") < most).withColumnRenamed("conv_id", "giver")
             .join(plans.select("conv_id", "giver", "taken"), "giver").where("nth < taken").select(*columns))
    length = F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return own.unionByName(gifts), plans.select("conv_id", length.alias("length"))


def _lanes(x: str, y: str) -> list[Column]:
    return [lane for c in (x, y) for lane in (F.shiftrightunsigned(c, 32).bitwiseAND(F.lit(LOW)), F.col(c).bitwiseAND(F.lit(LOW)))]


def _packed(a: str, b: str) -> Column:
    return F.shiftleft(F.col(a).bitwiseAND(F.lit(LOW)), 32).bitwiseOR(F.col(b).bitwiseAND(F.lit(LOW)))


def _bands(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, band, hi, lo (the node at which it is entered), turns (x, y, bytes in order), length."""
    t = turns.select("conv_id", "nth", "bytes", F.floor(F.col("nth") / BAND).alias("band"),
                     F.xxhash64(F.lit(1), "a", "b", "nth").alias("x"), F.xxhash64(F.lit(2), "a", "b", "nth").alias("y"))
    names = [f"l{i}" for i in range(4)]
    bands = t.select("conv_id", "band", F.struct("nth", "x", "y", "bytes").alias("turn"),
                     *[lane.alias(n) for lane, n in zip(_lanes("x", "y"), names, strict=True)]
                     ).groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("turn")).alias("turns"), *[F.sum(n).alias(n) for n in names])
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    entered = bands.select("conv_id", "band", "turns", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    return entered.join(conversations, "conv_id").select("band", _packed("l0", "l1").alias("hi"), _packed("l2", "l3").alias("lo"), "conv_id",
                                                         F.col("turns.x").alias("x"), F.col("turns.y").alias("y"), F.col("turns.bytes").alias("bytes"), "length")


def _plus(key: int, x: int) -> int:
    """Sums of the two 32-bit halves."""
    return ((((key >> 32) + (x >> 32)) & LOW) << 32) | ((key + x) & LOW)


def shard_nodes(band: int, hi: int, lo: int, members: list[int], turns: list[list[tuple[int, int, int]]], lengths: list[int]) -> list[tuple]:
    """Nodes below (band, hi, lo) of conversations sorted by id: depth, hi, lo, parent's hi and lo, n, smallest member, bytes, ends.

    ``turns`` are (x, y, bytes) as unsigned numbers.
    """
    first = band * BAND
    postings: dict[tuple[int, int, int], int] = {}
    going, ending = {}, {}
    for i, (own, length) in enumerate(zip(turns, lengths, strict=True)):
        bit = 1 << i
        for j, (x, y, _) in enumerate(own):
            postings[j, x, y] = postings.get((j, x, y), 0) | bit
            going[j] = going.get(j, 0) | bit
        if length - first <= BAND:
            ending[length - first] = ending.get(length - first, 0) | bit
    out = []
    stack = [((1 << len(members)) - 1, 0, hi, lo)]
    while stack:
        node, j, hi, lo = stack.pop()
        left = node & going.get(j, 0)
        while left:
            i = (left & -left).bit_length() - 1
            x, y, size = turns[i][j]
            child = node & postings[j, x, y]
            left &= ~child
            key = _plus(hi, x), _plus(lo, y)
            done, ends = child & ending.get(j + 1, 0), []
            while done:
                k = (done & -done).bit_length() - 1
                ends.append(members[k])
                done &= done - 1
            out.append((first + j + 1, *key, hi, lo, child.bit_count(), members[i], size, ends))
            stack.append((child, j + 1, *key))
    return out


NODES = "depth long, hi long, lo long, p_hi long, p_lo long, n long, conv_id long, bytes long, ends array<long>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(rows):
        columns = list(zip(*rows, strict=True))
        signed = [np.array(c, np.uint64).view(np.int64) for c in columns[1:5]]
        arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c) for c in signed], *[pa.array(c, pa.int64()) for c in columns[5:8]],
                  pa.array(columns[8], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in NODES.split(", ")])

    def finished():
        members = [h[0] for h in held]
        return told(shard_nodes(key[0], key[1] & (2**64 - 1), key[2] & (2**64 - 1), members, [h[1] for h in held], [h[2] for h in held]))

    key, held = None, []
    for batch in batches:
        lists = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64).tolist(), c.offsets.to_pylist()) for c in (batch.column(4), batch.column(5), batch.column(6))]
        (xs, at), (ys, _), (sizes, _) = lists
        for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3, 7)], strict=True)):
            own = list(zip(xs[at[i]:at[i + 1]], ys[at[i]:at[i + 1]], sizes[at[i]:at[i + 1]], strict=True))
            of = (*row[:3], own[0][:2])
            if held and (of != key or len(held) >= SHARD):
                yield finished()
                held = []
            key = of
            held.append((row[3], own, row[4]))
    if held:
        yield finished()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, hi, lo, member) to texts of neighbouring members' ids."""
    names = ["depth", "hi", "lo", "first", "ids"]

    def packed():
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], names=names)

    key, held, out, size = None, [], [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[:3] != key or len(held) >= CHUNK):
                out.append((*key, held[0], ",".join(map(str, held))))
                size += len(held)
                held = []
                if size >= CHUNK:
                    yield packed()
                    out, size = [], 0
            key = row[:3]
            held.append(row[3])
    if held:
        out.append((*key, held[0], ",".join(map(str, held))))
    yield packed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a node's ends, in order, to their hash; a task holds one text at a time."""
    import hashlib

    def packed():
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True)],
                                          names=["depth", "hi", "lo", "ends_sha256"])

    key, state, out = None, None, []
    for batch in batches:
        for depth, hi, lo, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (depth, hi, lo):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, hi, lo), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 4096:
            yield packed()
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield packed()


def _end_hashes(ends: DataFrame) -> DataFrame:
    """depth, hi, lo, ends_sha256 from depth, hi, lo, member."""
    place = ["depth", "hi", "lo"]
    texts = written(ends.repartitionByRange(*place, "member").sortWithinPartitions(*place, "member").mapInArrow(
        _joined, "depth long, hi long, lo long, first long, ids string"), "trie-ends")
    return (texts.repartition(*place).sortWithinPartitions(*place, "first").select(*place, "ids")
            .mapInArrow(_hashed, "depth long, hi long, lo long, ends_sha256 string"))


def _up_the_chains(nodes: DataFrame) -> DataFrame:
    """conv_id, parent_conv_id, hang (depth of the node it hangs off), leaves, saved: totals of each chain with all that hang off it."""
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    chains = nodes.groupBy("conv_id").agg(
        F.max(F.when(top, F.col("parent_conv_id"))).alias("parent_conv_id"), F.max(F.when(top, F.col("depth") - 1)).alias("hang"),
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    state = written(chains.withColumn("pointer", F.col("parent_conv_id")), "trie-chains")
    while state.where("pointer is not null").limit(1).count():
        added = (state.where("pointer is not null").groupBy(F.col("pointer").alias("conv_id"))
                 .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        further = state.where("pointer is not null").select(F.col("conv_id").alias("pointer"), F.col("pointer").alias("further"))
        state = written(
            state.join(further, "pointer", "left").join(added, "conv_id", "left")
            .select("conv_id", "parent_conv_id", "hang", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                    (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("further").alias("pointer")), "trie-chains")
    return state


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations.

    ``turns`` has conv_id, nth, a, b, bytes; ``conversations`` every conv_id
    once, with its length.  Columns, long unless said otherwise: conv_id (the
    smallest member; with the depth it names the node), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of
    the last text), ends_sha256 (string, of the ids of members that end here,
    ascending, joined by commas), n_ends.
    """
    place = ["depth", "hi", "lo"]
    first = F.col("x")[0], F.col("y")[0]
    order = ["band", "hi", "lo", "fx", "fy", "conv_id"]
    bands = written(_bands(turns, conversations), "trie-bands").withColumns({"fx": first[0], "fy": first[1]})
    found = (bands.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("band", "hi", "lo", "conv_id", "x", "y", "bytes", "length").mapInArrow(_nodes, NODES))
    found = written(found, "trie-shards")
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
                             F.count(F.when(F.col("length") == 0, 1)).alias("n_ends")).where("n > 0").select(
        zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), F.lit(None).cast("long").alias("p_hi"), F.lit(None).cast("long").alias("p_lo"),
        "n", "conv_id", zero.alias("bytes"), "n_ends")
    turnless = conversations.where("length = 0").select(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), F.col("conv_id").alias("member"))
    ends = found.where(F.size("ends") > 0).select(*place, F.explode("ends").alias("member")).unionByName(turnless)
    merged = found.groupBy(*place).agg(F.max("p_hi").alias("p_hi"), F.max("p_lo").alias("p_lo"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
                                       F.max("bytes").alias("bytes"), F.sum(F.size("ends").cast("long")).alias("n_ends"))
    nodes = written(merged.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, place, "left").join(parents, ["depth", "p_hi", "p_lo"], "left").select(
        "conv_id", "depth", "parent_conv_id", "hi", "lo", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), "n_ends",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
        F.floor(F.col("depth") / BLOCK).alias("block"))
    nodes = written(nodes, "trie-parents")
    hung = _up_the_chains(nodes).where("parent_conv_id is not null").groupBy(
        F.col("parent_conv_id").alias("conv_id"), F.col("hang").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    own = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({
        "leaf": F.col("leaf") + F.coalesce("hung_leaves", zero), "saved": F.col("saved") + F.coalesce("hung_saved", zero)})
    own = written(own.drop("hung_leaves", "hung_saved"), "trie-own")
    deeper = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("leaf").over(deeper), zero).alias("below_leaf"),
                           F.coalesce(F.sum("saved").over(deeper), zero).alias("below_saved"))
    along = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = own.join(blocks, ["conv_id", "block"]).withColumns({
        "n_leaves": F.sum("leaf").over(along) + F.col("below_leaf"), "saved_tokens": F.sum("saved").over(along) + F.col("below_saved")})
    none = F.sha2(F.lit("").cast("binary"), 256)
    return summed.join(_end_hashes(ends), place, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"), "n_ends")
