"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from monthloom.llm import spelling
from monthloom.llm.shipping import ship


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(words, times=5):
    forms, rows = {}, {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= times * n else None
        forms[w] = best[1] if best else None
        rows[w] = [n, len(others), forms[w], -best[0] if best else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows[w].append(root)
    return sorted((w, *r) for w, r in rows.items())


def brute_counts(rows, least=6, count=5, every=199):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += len(w) >= least
    return {w: n for w, n in found.items() if n >= count}


def variants(spark, words):
    ship(spark)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return sorted(tuple(r) for r in spelling.spelling_variants(table).collect())


def some_words(seed, n=250):
    draw = random.Random(seed)
    bases = ["".join(draw.choice("abé") for _ in range(draw.randrange(5, 9))) for _ in range(12)]
    words = {}
    for _ in range(n):
        w = draw.choice(bases)
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(w) + 1)
            w = draw.choice([w[:k] + w[k + 1:], w[:k] + draw.choice("abé") + w[k:], w[:k] + draw.choice("abé") + w[k + 1:]])
        words[w] = draw.choice([5, 5, 25, 26, 130, 700, 4000])
    return {w: n for w, n in words.items() if len(w) >= 4}


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 16), (3, 3)])
def test_all_pairs(spark, monkeypatch, seed, block):
    """Also where a group is cut into many blocks and tiles."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = some_words(seed)
    assert variants(spark, words) == brute_variants(words)


def test_chains_and_ties(spark):
    """Forms are followed to the last; of equally frequent ones the smallest counts."""
    chain = {"aaaaaaa"[:7 - k] + "bbbbbbb"[:k]: 5 ** (k + 1) for k in range(8)}
    ties = {"zzzzzq": 5, "zzzzza": 25, "zzzzzb": 25, "zzzzzz": 24}
    words = {**chain, **ties}
    found = variants(spark, words)
    assert found == brute_variants(words)
    roots = {r[0]: r[-1] for r in found}
    assert roots["aaaaaaa"] == "bbbbbbb" and roots["zzzzzq"] == "zzzzza"


def test_one_hot_group(spark, monkeypatch):
    """Words that all share their first letters are spread over tiles."""
    monkeypatch.setattr(spelling, "BLOCK", 20)
    draw = random.Random(5)
    words = {"prefix" + "".join(draw.choice("xy") for _ in range(draw.randrange(5, 7))): draw.choice([5, 30, 200]) for _ in range(150)}
    assert variants(spark, words) == brute_variants(words)


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_POINTS", 40_000)
    long = "ab" * 20_000
    words = {long: 100, long[:-1]: 5, "x" + long: 6, long[:20_000] + "z" + long[20_001:]: 7, "short" * 3: 5}
    assert variants(spark, words) == brute_variants(words)


def test_empty(spark):
    assert variants(spark, {}) == []
    assert variants(spark, {"single": 5}) == [("single", 5, 0, None, None, "single")]


@pytest.mark.parametrize("every", [None, 3, 199])
def test_counts(spark, every):
    draw = random.Random(4)
    parts = ["Straße", "straße", "STRASSE", "naïveté", "ÀÉÎÕÜ", "àéîõü", "wordword", "×÷×÷×÷", "shor", "Ünderſtand", "x" * 30]
    rows = [(draw.choice([None, 1, 2, 3, 10 ** 12]), draw.choice([" ", "\n", "1", "ſ", "\U0001f600"]).join(draw.choices(parts, k=draw.randrange(40))))
            for _ in range(60)] + [(4, None), (5, ""), (None, None), (6, "abcdefgh" * 40_000)]
    rows += rows[:5]
    table = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, h int").repartition(4)
    found = {r.word: r.n for r in spelling.word_counts(table, 6, 5, every).collect()}
    assert found == brute_counts(rows, every=every)
    assert spelling.word_counts(table.limit(0), 6, 5, every).collect() == []
