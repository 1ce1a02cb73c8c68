"""The conversation trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import tries

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            own = (role or "", text or "")
            convs.setdefault(c, []).append(((turn is not None, turn or 0), own[0].encode(), hashlib.sha256(own[1].encode()).hexdigest(), own))
    convs = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        gain = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += gain
            leaves[k[:d]] += children[k] == 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_by_operator(df, **more):
    return sorted(map(tuple, tries.prefix_trie(df, **more).collect()), key=repr)


def made(seed, n=40, ids=range(60), most=30):
    rng = random.Random(seed)
    words = ["a", "b", "é", "", None]
    out = []
    for c in rng.sample(list(ids), n):
        for turn in range(rng.choice([1, 2, 3, 8, 9, 10, most])):
            out.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None, ""]) if turn else "user", rng.choice(words[: 1 + seed % 5])))
    return out


def test_trie_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert trie_by_operator(df) == trie_by_hand(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))


@pytest.mark.parametrize("seed", [0, 1, 4])
def test_trie_of_made_conversations_in_small_segments(spark, monkeypatch, seed):
    """Chains of every kind, cut into segments and packs of a few turns."""
    monkeypatch.setattr(tries, "PACK", 64)
    monkeypatch.setattr(tries, "PIECE", 16)
    rows = made(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_by_operator(df, segment=9) == trie_by_operator(df) == trie_by_hand(rows)


def test_trie_of_copies_and_a_long_conversation(spark):
    """A third of all turns in one conversation, another third in copies of one, and ids of many digits or below zero."""
    rows = [(7, k, "user", f"t{k % 3}") for k in range(500)]
    rows += [(100 + c, k, "user", "same") for c in range(100) for k in range(5)]
    rows += [(c, k, "user", "x" * k) for c in (-7, -5, 2**62, 2**62 - 1) for k in range(12)] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, TURNS)
    assert trie_by_operator(df, segment=16) == trie_by_hand(rows)


def test_trie_on_awkward_tables(spark):
    rows = [(5, None, None, None), (5, None, None, None), (6, 1, "user", "long " * 50_000), (6, 1, "user", "tie"), (6, 1, "a", "tie"), (None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    clashing = df.withColumns({c: F.lit("x") for c in "at base first n depth k1 ends place segment of block within equal rid digest pack last".split()})
    assert trie_by_operator(df) == trie_by_operator(clashing) == trie_by_hand(rows)
    assert trie_by_operator(df.limit(0)) == []
