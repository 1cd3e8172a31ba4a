"""The trie against SQL on a given table, and against dictionaries on conversations of many kinds."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from corvane.llm import conversation_trie

MIDDLE = "/root/testdata/sf0.01"


def test_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{MIDDLE}/conversations.parquet'")
    want = db.execute(entry.oracle_sql()["op12_conversation_trie"])
    got = entry.queries()["op12_conversation_trie"](spark, MIDDLE)
    assert got.columns == [c[0] for c in want.description]
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def turn_id(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_conversations(rows):
    """Each conversation's turns in order, after the first turns are lent."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, turn_id((role or "", text or "")), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in found.items()}
    out = {None: own[None]} if None in own else {}
    for c in own.keys() - {None}:
        lender = c - int(np.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(lender, [])[:h] + own[c][h:]
    return out


def plain_trie(conversations):
    last = lambda c: (c is None, c or 0)
    members = collections.defaultdict(list)
    for c, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children, leaves, tokens = (collections.Counter() for _ in range(3))
    for path, who in members.items():
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        own = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            tokens[path[:d]] += own
    least = {path: min((c for c, _ in who), key=last) for path, who in members.items()}
    rows = []
    for path, who in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c, n in who if n == len(path)), key=last))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        parent = least[path[:-1]] if path else None
        rows.append((least[path], len(path), parent, len(who), children[path], leaves[path], tokens[path], sha))
    return sorted(rows, key=str)


def made(seed):
    """A frequent conversation, long chains that are shared, long ones alone, nulls, ties, negative ids and turns lent by absent ones."""
    rng = random.Random(seed)
    rows = []
    hot = [("user", "héllo"), ("assistant", "wörld"), ("user", "")]
    chain = [(rng.choice(["user", "assistant"]), f"chain {i}") for i in range(45)]
    for c in range(-12, 90):
        if c % 7 == 3:
            continue
        kind = rng.random()
        turns = hot if kind < 0.4 else chain[: rng.randint(0, 45)] + [("user", str(rng.randint(0, 2)))] if kind < 0.7 else []
        turns = turns or [(rng.choice(["user", None]), rng.choice([None, "", "a", "b", "ab"])) for _ in range(rng.randint(1, 9))]
        order = list(range(len(turns)))
        if kind > 0.9:
            order = [rng.choice([None, 0, 1]) for _ in turns]
        rows += [(c, o, *t) for o, t in zip(order, turns, strict=True)]
    rows += [(None, 1, "user", "no id"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "shard"), [(1, 1 << 20), (2, 60), (3, 25)])
def test_plain(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard)
    rows = made(seed)
    turns = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(5)
    found = conversation_trie.with_lent_turns(conversation_trie.conversations(turns))
    got = conversation_trie.trie(found).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(plain_conversations(rows).items())


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversation_trie.trie(conversation_trie.with_lent_turns(conversation_trie.conversations(empty))).collect() == []
    # conversations without turns, and two rows of one id
    ids = [turn_id(("user", "x"))]
    frame = spark.createDataFrame([(4, [], []), (5, ids, [1]), (5, ids, [1])], "conv_id long, ids array<string>, bytes array<long>")
    got = sorted(map(tuple, conversation_trie.trie(frame).collect()), key=str)
    assert got == plain_trie([(4, []), (5, [("user", "x")]), (5, [("user", "x")])])
    alone = conversation_trie.trie(frame.filter("conv_id = 4")).collect()
    assert [tuple(r) for r in alone] == plain_trie([(4, [])])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=30), st.integers(1, 5))
def test_sorted_rows(turns, width):
    flat = np.array([t for row in turns for t in row], dtype=np.int64)
    sizes = np.array([len(t) for t in turns])
    conv = np.array([7 * i % 31 for i in range(len(turns))])
    rows = conversation_trie.Rows(conv, sizes, np.cumsum(sizes) - sizes, flat, flat)
    order, shared = conversation_trie.sorted_rows(rows, width)
    want = sorted(range(len(turns)), key=lambda i: (turns[i], conv[i]))
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], shared[1:].tolist(), strict=False):
        x, y = turns[a], turns[b]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
