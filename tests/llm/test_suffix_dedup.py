"""Repeated passages against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest

from monthloom.llm import suffix_sort as ss
from monthloom.llm.shipping import ship
from monthloom.llm.suffix_dedup import without_repeats

SCHEMA = "doc_id long, text string, blob string, part int"  # clashing names of extra columns


def brute(rows):
    strings = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, t in coded:
        for p in range(len(t) - 49):
            s = t[p:p + 50]
            if s not in strings or rank(i) < strings[s]:
                strings[s] = rank(i)
    out = []
    for i, t in coded:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - 49):
            if strings[t[p:p + 50]] < rank(i):
                gone[p:p + 50] = True
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    ship(spark)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    result = without_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in result), key=repr)


def passages(seed, n=60):
    draw = random.Random(seed)
    words = ["alpha", "be", "gamma", "déjà", "x", "the", "of", "日本", "ing"]
    text = lambda k: " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(k))
    shared = [text(k) for k in (12, 14, 30, 60, 9)]
    rows = []
    for i in range(n):
        parts = [text(draw.randrange(0, 30))]
        for _ in range(draw.randrange(3)):
            s = draw.choice(shared)
            a = draw.randrange(len(s) // 2)
            parts += [s[a:a + draw.randrange(20, len(s))], text(draw.randrange(8))]
        rows.append((draw.randrange(1000), draw.choice([" ", ""]).join(parts)))
    return rows


ODD = [
    (1, None), (2, ""), (3, "short"), (4, "a" * 400), (5, "a" * 49), (6, "b" + "a" * 50), (7, "ab" * 300), (8, "ba" * 40),
    (9, "0123456789" * 5), (10, "0123456789" * 5), (11, "x" + "0123456789" * 5 + "y"), (None, "0123456789" * 6),
    (None, "0123456789" * 6), (12, "abc" * 100), (12, "abc" * 100), (12, "z" + "abc" * 50), (0, "q" * 51),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = passages(seed) + ODD
    assert found(spark, rows, part_bytes=1500) == brute(rows)


def test_one_part_and_hot_copies(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(i, base) for i in range(200, 0, -1)] + [(i, base[:200] + f" tail {i} " + base[100:]) for i in range(300, 380)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, part_bytes=3000) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_long_text(spark):
    draw = random.Random(5)
    long = "".join(draw.choice("abcd ") for _ in range(1_300_000))
    rows = [(2, long), (1, long[600_000:600_100] + "!" + long[1_048_560:1_048_640])]
    result = {r[0]: r for r in found(spark, rows)}
    assert result[2][2:4] == (180, 2) and result[1][2] == 0


def test_multikey_sort_orders_and_compares():
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 3, size=(500, 4)).astype(np.uint64)
    order, differs = ss.multikey_sort(list(rows.T))
    listed = [tuple(r) for r in rows[order]]
    assert listed == sorted(map(tuple, rows))
    for k in range(1, 500):
        first = next((j for j in range(4) if listed[k][j] != listed[k - 1][j]), 4)
        assert differs[k] == first


def test_every_string_holds_its_chosen_gram():
    data = np.frombuffer(("the cat " * 40 + "aaaa" * 30).encode() + bytes(ss.WIDEST + 8), dtype=np.uint8)
    n = len(data) - ss.WIDEST - 8
    low, high, gram, _ = ss.chosen_suffixes(data, np.array([0]), np.array([n]))
    assert sum(high - low + 1) == n - 49
    assert all(low[1:] == high[:-1] + 1)
    assert all((gram >= high) & (gram + ss.GRAM <= low + 50))
