"""Prefix trie: against a dictionary of prefixes; edge cases; shards and bands do not show."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelcast.llm import queries, trie

from conftest import SF_SMALL

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def regrafted(rows, group=5, most=8):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    return out


def brute(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(conversations):
        turns = tuple(conversations[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, who in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def made(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def random_rows(seed, conversations=60, kinds=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice("äbc"[:kinds]) * rng.randint(0, 2))
            for c in rng.sample(range(3 * conversations), conversations) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dictionary_of_prefixes(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 3)
    monkeypatch.setattr(trie, "SHARD", 7)
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = random_rows(seed)
    got = trie.prefix_trie(*trie.regrafted(trie.hashed_turns(made(spark, rows)), group=5, most=8))
    assert rows_of(got) == brute(regrafted(rows))


def test_edge_rows(spark):
    rows = [(1, None, "user", None), (1, 0, None, "a"), (1, 0, None, "a"), (2, 5, "user", ""), (2, 6, "", "a"), (2, 7, "", "a"),
            (3, 1, "b", "x"), (3, 1, "a", "y"), (None, 0, "user", "lost"), (7, 0, "user", "z" * 70 + "2"), (7, 0, "user", "z" * 70 + "1"), (-4, 0, "user", "n")]
    turns = made(spark, rows).withColumns({"nth": F.lit("clash"), "part": F.lit(1), "a": F.lit(2), "depth": F.lit(0)})
    got = trie.prefix_trie(*trie.conversations_of(trie.hashed_turns(turns)))
    assert rows_of(got) == brute(regrafted(rows, group=1, most=0))


def test_one_long_conversation_and_copies(spark):
    turns = [("user", f"turn {i}") for i in range(700)]
    rows = [(c, i, *t) for c in (10, 11, 12) for i, t in enumerate(turns[:700 if c != 11 else 300])]
    rows += [(c, 0, "user", "hello") for c in range(100, 400)]
    got = trie.prefix_trie(*trie.conversations_of(trie.hashed_turns(made(spark, rows))))
    assert rows_of(got) == brute(regrafted(rows, group=1, most=0))


def test_empty(spark):
    got = trie.prefix_trie(*trie.regrafted(trie.hashed_turns(made(spark, [])), group=5, most=8))
    assert got.collect() == []


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, SF_SMALL)) == brute(regrafted(rows))
