"""Quality rules, mixing and top-k search against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.llm import mixing, quality, vector_search
from monthloom.llm.shipping import ship

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    covered = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def quality_texts():
    draw = random.Random(4)
    out = [None, "", " \n\t", "one", "a " * 7, "a " * 8, "a " * 9, "é# <b> |" * 9, "x\ny\nx\n \n\nx", "\x0bv\x0cw\r" * 30, "word " * 3000]
    for _ in range(150):
        vocabulary = [f"w{k}" for k in range(draw.choice([2, 5, 40, 400]))]
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(60))]
        if draw.random() < 0.4:
            words += words[:draw.randrange(30)]
        out.append("".join(w + draw.choice([" ", " ", "\n", "\t", "  "]) for w in words))
    return out


def test_quality_counts(spark):
    texts = quality_texts()
    docs = spark.createDataFrame([(k, t, f"s{k % 3}", 1) for k, t in enumerate(texts)],
                                 "doc_id long, text string, source string, n_words int")
    for r in quality.quality_table(docs).collect():
        assert tuple(r)[1:7] == brute_quality(texts[r.doc_id]), texts[r.doc_id]
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_table(docs.limit(0)).count() == 0


def test_hosts_with_bad_rates_are_rejected(spark, monkeypatch):
    good, bad = " ".join(f"w{k}" for k in range(30)), "short"
    rows = [(k, good, "fine", 0) for k in range(200)] + [(1000 + k, bad, "fine", 0) for k in range(5)]
    rows += [(2000 + k, good if k < 20 else bad, None, 0) for k in range(200)]
    rows += [(3000, bad, "tiny", 0), (3001, good, "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    rates = {r.source: r for r in quality.host_rates(quality.measured(docs)).collect()}
    n = {"fine": (205, 5), None: (200, 180), "tiny": (2, 1)}
    p = [f / m for m, f in n.values()]
    mean, variance = sum(p) / 3, sum(x * x for x in p) / 3 - (sum(p) / 3) ** 2
    variance -= mean * (1 - mean) * sum(1 / m for m, _ in n.values()) / 3  # what small hosts vary by chance
    strength = max(mean * (1 - mean) / variance - 1, 0)
    for host, (m, f) in n.items():
        assert rates[host].rate == pytest.approx((f + mean * strength) / (m + strength))
    for limit in (quality.BROADCAST_HOSTS, -1):  # as a broadcast list, and joined by key
        monkeypatch.setattr(quality, "BROADCAST_HOSTS", limit)
        kept = {r.doc_id for r in quality.keep_good(docs).collect()}
        assert {k for k in kept if k < 1000} == set(range(200)) and not any(2000 <= k < 3000 for k in kept)


def water_fill(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing_meets_the_targets(spark):
    draw = random.Random(6)
    rows = [(k, " ".join(["w"] * int(draw.paretovariate(0.8) * 5)), draw.choice(["hot"] * 8 + ["b", "a", "é", None, "zz"]))
            for k in range(3000)]
    rows += [(5000, None, "b"), (5001, "", "only empty"), (5002, "one two three", "tiny")] + [(6000, "same row here", "a")] * 300
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int").repartition(4)
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    result = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in result) == sorted((i, size_of(t)) for i, t, _ in rows)
    targets, by_target = water_fill(sizes), {}
    for r in result:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        entry = by_target.setdefault((r.source_size, round(r.target, 6)), [0, []])
        entry[0] += r.taken
        entry[1].append((r.size, r.copies))
    assert set(by_target) == {(sizes[s], round(t, 6)) for s, t in targets.items()}
    for (size, target), (taken, docs_of) in by_target.items():
        assert abs(taken - target) <= max(5, 0.01 * target)
        # rates are exponential in the size: shorter documents of a thinned source are taken at least as often
        if 0 < target < size and len(docs_of) > 200:
            short = [c for x, c in docs_of if 0 < x <= 10]
            long = [c for x, c in docs_of if x >= 100]
            assert not long or np.mean(short) >= np.mean(long)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in result)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, -1])
def test_mixed_rows_are_whole_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    rows = [(k, "a b c d " * (k % 5 + 1), "xyz"[k % 3], k) for k in range(90)] + [(None, "no id", "x", 1), (1, "again one", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    made = sorted(map(tuple, out.collect()), key=repr)
    assert set(made) <= set(rows)
    taken = {r.row: r.copies for r in mixing.mix(docs.withColumn("row", F.xxhash64("*")), "row").collect()}
    assert len(made) == sum(taken.values())


def vectors(seed):
    draw = np.random.default_rng(seed)
    rows = [(int(k), draw.normal(0, 0.2, 16).astype(np.float32).tolist(), 1) for k in draw.permutation(700)]
    rows += [(1000 + k, rows[k % 9][1], 1) for k in range(60)]                     # ties
    rows += [(2000, None, 1), (2050, [1.0, None] * 8, 1), (2100, [math.nan] * 16, 1), (2150, [math.inf] + [0.0] * 15, 1)]
    rows += [(3000, [0.5, -0.5], 1), (3050, [], 1), (None, [0.1] * 16, 1), (50, rows[3][1], 1)]  # short, empty, no id, an id twice
    return rows


def brute_top(rows, k=5):
    usable = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = np.zeros((len(usable), 16), dtype=np.int64)
    for n, (_, v) in enumerate(usable):
        whole[n, :len(v)] = [math.floor(256 * x) for x in v]
    ids = np.array([i for i, _ in usable])
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = whole @ whole[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:k]
        out += [(int(ids[q]), r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, read", [(4096, 16), (64, 2)])
def test_top_k_is_exact(spark, monkeypatch, block, read):
    ship(spark)
    rows = vectors(block)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(3)
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vector_search, "QUERY_BLOCKS_PER_UNIT", 2)
    assert sorted(map(tuple, vector_search.top_k(docs).collect())) == brute_top(rows)
    assert vector_search.top_k(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [4, 256])
def test_bounds_hold_and_save_reads(cells, monkeypatch):
    monkeypatch.setattr(vector_search, "CELLS", cells)
    draw = np.random.default_rng(1)
    exact = np.floor(256 * draw.normal(0, 0.2, (500, 16))).astype(np.int64)
    low = exact.min(axis=0)
    step = np.maximum(1, -(-(exact.max(axis=0) - low + 1) // cells))
    block = {"n": 500, "ids": np.arange(500).tobytes(), "exact": exact.tobytes(), "low": low.tobytes(), "width": step.tobytes(),
             "cells": ((exact - low) // step).astype(np.uint8).tobytes()}
    ids = np.arange(500)
    lower, upper = vector_search._bounds(exact[:20], ids[:20], block)
    scores = (exact[:20] @ exact.T).astype(float)
    others = ids[:20, None] != ids[None]
    assert ((lower <= scores) & (scores <= upper))[others].all() and np.isneginf(lower[~others]).all()
    floors = vector_search._best(lower, 5).min(axis=1)
    alive = upper >= floors[:, None]
    if cells == 256:
        assert alive.sum() < 20 * 12  # few more than the five that are wanted
    for q in range(20):
        at = np.flatnonzero(alive[q])
        at = at[np.argsort(-upper[q, at], kind="stable")]
        best = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert vector_search._read_exactly(exact, ids, exact[q], at, upper[q, at], 5) == [(-s, i) for s, i in best]


def test_exact_vectors_are_read_of_survivors_only(spark, monkeypatch):
    """The floor of a query holds in all blocks, so most blocks give nothing to read."""
    ship(spark)
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", 50)
    tables = {}
    keep = vector_search.written

    def kept(df, name, *args):
        tables[name] = keep(df, name, *args)
        return tables[name]

    monkeypatch.setattr(vector_search, "written", kept)
    docs = spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>, id int").repartition(3)
    found = vector_search.top_k(docs).collect()
    # every score of the empty vector is equal, so all of its rows are read
    read = {r[0]: r[1] for r in tables["survivors"].groupBy("query_id").agg(F.sum(F.size("at"))).collect()}
    assert read.pop(3050) > 700 and sum(read.values()) < 2 * len(found)


def test_running_sums_of_a_hot_source_in_two_levels(spark, monkeypatch):
    """Cells and chunks of a few documents give the copies that one running sum over the source gives."""
    draw = random.Random(8)
    cells = [("a" if k % 3 else "b", draw.randrange(1, 6), k, draw.randrange(1, 9), draw.randrange(3 * 10 ** 9)) for k in range(300)]
    rows = [(False, s, size, part, n, rate) for s, size, part, n, rate in cells]
    table = spark.createDataFrame(rows, "no_source boolean, source_key string, size long, part long, n long, rate long").repartition(4)
    expected, upto = {}, {}
    for _, s, size, part, n, rate in sorted(rows, key=lambda r: (r[1], -r[2], r[3])):
        before = upto.get(s, 0)
        upto[s] = before + n * rate
        expected[s, size, part] = (upto[s] + 500_000_000) // 10 ** 9 - (before + 500_000_000) // 10 ** 9
    for chunk in (4096, 7):
        monkeypatch.setattr(mixing, "CHUNK_CELLS", chunk)
        made = mixing._rounded(table, ["no_source", "source_key", "size"])
        assert {(r.source_key, r["size"], r.part): r._copies for r in made.collect()} == expected


def test_tilts_that_are_not_found_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    docs = spark.createDataFrame([(k, "w " * (k % 40 + 1), "xyz"[k % 3 % 2]) for k in range(200)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.mix(docs).count()
