"""Near-duplicates against a brute-force version."""

import random

import pytest

from monthloom.llm import components, near_dedup
from monthloom.llm.shipping import ship
from monthloom.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, bucket string, node int"


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < words else {tuple(w[k:k + words]) for k in range(len(w) - words + 1)})
    return out


def brute(rows, words, similarity=80):
    sets, parent = sets_of(rows, words), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


def found(spark, rows, words):
    ship(spark)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in near_dedup.near_duplicates(docs, words).collect()), key=repr)


def copies(seed, groups=6, each=25, least=0.02, most=0.3):
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(30, 120))]
        for _ in range(draw.randrange(2, each)):
            rate = draw.uniform(least, most)
            rows.append((draw.randrange(100_000), " ".join(f"e{draw.randrange(9999)}" if draw.random() < rate / 2 else w for w in base)))
    return rows + [(draw.randrange(100_000), t) for _, t in draw.choices(rows, k=20)]


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0bTwo"), (None, "one two"),
       (None, "lonely text without id here"), (8, "twice the same row"), (8, "twice the same row"), (9, "É é"), (10, "é é")]


@pytest.mark.parametrize("words", [2, 5])
def test_groups(spark, words):
    rows = copies(words) + ODD
    assert found(spark, rows, words) == brute(rows, words)


@pytest.mark.parametrize("seed", [11, 17, 21])
def test_one_large_group_in_small_parts(spark, monkeypatch, seed):
    """Links that no star shows are found by parts of buckets and components meeting."""
    monkeypatch.setattr(near_dedup, "PART", 16)
    monkeypatch.setattr(near_dedup, "QUERY_PART", 8)
    rows = copies(seed, groups=2, each=120, least=0.0, most=0.45)
    assert found(spark, rows, 2) == brute(rows, 2)


def test_lists_too_long_to_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", -1)
    monkeypatch.setattr(components, "BROADCAST_NODES", -1)
    rows = copies(5, groups=3) + ODD
    assert found(spark, rows, 2) == brute(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.one_of_each(docs, 2).collect()), key=repr)
    empty = [(i, t) for i, t in rows if not (t or "").split()]
    wanted = {i for i, n, _, stays in brute(rows, 2) if stays and n}  # ids are drawn apart, but for copies
    assert {i for i, t in kept if (t or "").split()} == wanted
    assert [k for k in kept if not (k[1] or "").split()] == sorted(empty, key=repr)
    assert len(kept) == len(empty) + len(wanted)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_chains_stars_and_cliques(spark, seed):
    draw = random.Random(seed)
    names = draw.sample(range(10_000), 300)
    edges = list(zip(names[:80], names[1:81]))                                  # a chain
    edges += [(names[100], n) for n in names[101:180]]                          # a star
    edges += [(a, b) for a in names[200:215] for b in names[200:215]]           # a clique, with loops
    edges += [(names[draw.randrange(220, 300)], names[draw.randrange(220, 300)]) for _ in range(60)]
    edges += edges[:20]
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {n: root(n) for n in names if root(n) != n}
    draw.shuffle(edges)
    made = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in made} == expected and len(made) == len(expected)


def test_empty_table(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(1, None), (2, None)], 5) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_one_of_each_keeps_columns_and_one_row(spark):
    ship(spark)
    docs = spark.createDataFrame(
        [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "z"), (2, "other words are in this text", "x"),
         (None, "one more text without any id", "x"), (4, None, "x")], "doc_id long, text string, _row string")
    docs = docs.withColumnRenamed("_row", "source")
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4]


def test_shingles_follow_the_word_rule():
    sets = shingle_sets(["A b\tC", "a  B c", "", None, "x", " x", "a b"], 2)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 1, 1]
    assert sets[4][0] != sets[5][0]
