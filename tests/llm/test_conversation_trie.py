"""The trie against prefixes taken one by one."""

import collections
import hashlib
import random
import zlib

import pytest

from rimward.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth long"  # the last two clash with inner names
NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows, group=100, heads=6):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads if group else 0
        rebuilt[c] = (turns.get(c - c % group, [])[:h] if group else []) + own[h:]
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ended = {k: ",".join(str(c) for c in m if len(rebuilt[c]) == len(k)) for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ended[k].encode()).hexdigest()) for k, m in members.items())


def trie(spark, rows, **how):
    got = ct.conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **how).collect()
    return sorted((tuple(r[c] for c in NUMBERS) for r in got))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = ["hello", "", None, "é ß 日本", "a much longer answer", "x"]
    out = []
    for c in [*range(0, 12), *range(100, 109), *range(205, 212), 300, 301, 2**40, 2**40 + 4096]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", None]), texts[rng.randrange(3) if t < 3 else rng.randrange(6)]))
    out += [(400, t, "user", "deep") for t in range(70)] + [(c, t, "user", "deep") for c in (401, 402) for t in range(40)]  # depths beyond 64
    out += [(500, None, "user", "null turn"), (500, 1, "b", "tie"), (500, 1, "a", "tie"), (500, 1, "a", "tie"), (500, 1, "a", "sooner")]
    out += [(None, 1, "user", "no conversation"), (600, 0, "user", "y" * 200_000), (601, 0, "user", "y" * 200_000)]
    return out + [(c, t, "user", "copied") for c in range(700, 760) for t in range(7)]


@pytest.mark.parametrize("group", [100, None])
def test_trie_equals_prefixes_taken_one_by_one(spark, rows, monkeypatch, group):
    monkeypatch.setattr(ct, "ID_BITS", 3)  # members that end at one node in several ranges
    assert trie(spark, rows, group=group) == [tuple(x) for x in plain(rows, group)]


def test_long_conversation_over_many_parts_and_hot_node(spark, monkeypatch):
    monkeypatch.setattr(ct, "ID_BITS", 2)
    rows = [(1, t, "user", f"turn {t % 5}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in range(2, 40) for t in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = ct.ordered_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
        assert turns.where("conv_id = 1").select("part").distinct().count() > 2
        assert trie(spark, rows, group=None) == [tuple(x) for x in plain(rows, None)]
        assert trie(spark, rows, group=100) == [tuple(x) for x in plain(rows, 100)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    chain = [(i + 1, 0, i or None, 0 if i else None, i, 1) for i in range(100)]
    nodes = spark.createDataFrame(chain, "k1 long, k2 long, p1 long, p2 long, depth long, v long")
    made, meant = [], ct.materialize
    monkeypatch.setattr(ct, "materialize", lambda df, label, replaces=None: made.append(label) or meant(df, label, replaces))
    got = {r["k1"]: r["v"] for r in ct.subtree_sums(nodes, ["v"]).collect()}
    assert got == {i + 1: 100 - i for i in range(100)}
    assert made.count("pointers") == 1 + 7


def test_conversations_without_turns_of_their_own_and_empty_tables(spark):
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie(spark, [(alone, 0, "user", "dropped")], group=100) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert trie(spark, [(None, 0, "user", "x")], group=100) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert ct.conversation_trie(empty, 100).count() == 0
