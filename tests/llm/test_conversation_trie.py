"""The trie of conversations against dictionaries of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from monthloom.llm import conversation_trie as ct
from monthloom.llm.shipping import ship

SCHEMA = "conv_id long, turn int, role string, text string, size int, name string"


def key(r, t):
    r, t = r.encode(), t.encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()


def brute_openings(rows):
    own = defaultdict(list)
    for c, turn, r, t in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(r or "", t or ""), (r or "", t or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = turns.get(base, [])[:h] + v[h:]
    return made


def brute_trie(made):
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for prefix, own in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in below)]
        ends = sorted(c for c in own if len(made[c]) == len(prefix))
        rows.append((min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), len(children), len(leaves), saved,
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def table(spark, rows, parts=4):
    ship(spark)
    return spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA).repartition(parts)


def found(spark, rows, openings=True):
    turns = ct.numbered_turns(table(spark, rows))
    if openings:
        turns, convs = ct.shared_openings(turns)
    else:
        convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
        turns = turns.join(convs, "conv_id")
    nodes, ends = ct.trie(turns, convs)
    return sorted((tuple(r)[1:] for r in nodes.join(ct.end_digests(ends), "name", "left").fillna(
        {"ends_sha256": hashlib.sha256(b"").hexdigest()}).collect()), key=repr)


def some_rows(seed, n=60):
    draw = random.Random(seed)
    texts = ["", "a", "é", "ab" * 50, None, "\U0001f600"]
    rows = []
    for _ in range(n):
        c = draw.choice([draw.randrange(-12, 40), draw.randrange(10 ** 12)])
        rows += [(c, draw.choice([None, k, k, k]), draw.choice(["user", "", None]), draw.choice(texts)) for k in range(draw.randrange(1, 6))]
    return rows + [(None, 1, "user", "x")] + draw.choices(rows, k=15)


@pytest.mark.parametrize("seed", [1, 2])
def test_openings(spark, seed):
    """Nulls, equal turns, repeated rows, negative ids, absent and short openings."""
    rows = some_rows(seed)
    assert found(spark, rows) == brute_trie(brute_openings(rows))


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_turnless_conversation(spark):
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "x"), (c, 1, "user", "y")]
    assert found(spark, rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_conversations(spark, monkeypatch):
    """Names of prefixes over several levels of blocks, and one conversation over many ranges."""
    monkeypatch.setattr(ct, "BLOCK", 4)
    monkeypatch.setattr(ct, "CHUNK", 3)
    draw = random.Random(3)
    line = [draw.choice("ab") * 3 for _ in range(90)]
    rows = [(c, k, "user", t) for c, n in ((1, 90), (2, 90), (3, 41), (4, 16), (5, 1)) for k, t in enumerate(line[:n])]
    rows += [(6, k, "user", t if k != 50 else "other") for k, t in enumerate(line)]
    rows += [(c, 0, "user", line[0]) for c in range(100, 130)]
    made = defaultdict(list)
    for c, _, r, t in rows:
        made[c].append((r, t))
    assert found(spark, rows, openings=False) == brute_trie(made)


def test_equal_turns_of_one_conversation(spark):
    """A heap of equal rows is one long chain, numbered over several ranges."""
    rows = [(1, None, "user", "same")] * 400 + [(2, 5, "user", "same")] * 3
    turns = ct.numbered_turns(table(spark, rows, 6))
    assert sorted((r.conv_id, r["at"]) for r in turns.collect()) == [(1, k) for k in range(400)] + [(2, k) for k in range(3)]


def tree(kind, n, draw):
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "star":
        return [None] + [0] * (n - 1)
    if kind == "caterpillar":
        return [None] + [max(0, k - 1 - k % 2) if k % 2 == 0 else max(0, k - 2) for k in range(1, n)]
    return [None] + [draw.randrange(max(0, k - 4), k) for k in range(1, n)]


@pytest.mark.parametrize("kind, n", [("chain", 120), ("star", 200), ("caterpillar", 80), ("random", 150), ("chain", 1)])
def test_subtree_totals(spark, kind, n):
    draw = random.Random(n)
    parent = tree(kind, n, draw)
    weight, size = [draw.randrange(100) for _ in range(n)], [1] * n
    live = [parent.count(k) for k in range(n)]
    total, sizes = weight[:], size[:]
    for k in reversed(range(1, n)):
        total[parent[k]] += total[k]
        sizes[parent[k]] += sizes[k]
    name = [draw.randrange(10 ** 9) for _ in range(n)]
    rows = [(name[k], None if parent[k] is None else name[parent[k]], live[k], weight[k], 1) for k in range(n)]
    state = spark.createDataFrame(rows, "node long, parent long, live long, w long, s long").repartition(3)
    assert sorted(tuple(r) for r in ct.subtree_totals(state, ["w", "s"]).collect()) == sorted(zip(name, total, sizes))
