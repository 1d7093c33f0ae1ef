"""Exchanges of the packing search, and groups that meet again."""

import random

import numpy as np

from monthloom.llm import packing
from monthloom.llm.queries import tokenizer_path
from monthloom.llm.shipping import ship


def test_two_for_one_from_a_bin_of_many_pieces():
    """Thirteen pieces of 2 leave room for one more bin only by pairs: 2 + 2 go for the 3 of a bin with a gap of 1."""
    sizes = np.array([2] * 13 + [70, 3, 26])
    search = packing._Search(sizes, [list(range(13)), [13, 14, 15]], 100)
    search.items = np.arange(len(sizes))
    assert search._improve(0)
    assert search.fill.tolist() == [25, 100]


def pairs_of_a_listing(search, source):
    """The first exchange of one or two for one that a listing of all of them finds."""
    own = sorted(search.bins[source], key=lambda i: -search.sizes[i])
    fill = search.fill[source]
    others = [i for i in search.items if search.where[i] != source and search.fill[search.where[i]] >= fill]
    for given in [[i] for i in own] + [[a, b] for k, a in enumerate(own) for b in own[k + 1:]]:
        for i in others:
            gain = search.sizes[given].sum() - search.sizes[i]
            if 0 < gain <= search.capacity - search.fill[search.where[i]]:
                return sorted(search.sizes[given].tolist())
    return None


def test_size_table_finds_what_a_listing_finds():
    draw = np.random.default_rng(5)
    for _ in range(200):
        sizes = draw.integers(1, 20, size=80)
        bins = packing._best_fit(sizes, 100)
        search = packing._Search(sizes, bins, 100)
        search.items = np.flatnonzero(np.isin(search.where, np.flatnonzero(search.fill < 100)))
        source = int(np.argmin(search.fill))
        own = sorted(search.bins[source], key=lambda i: -search.sizes[i])
        others = search.items[(search.where[search.items] != source) & (search.fill[search.where[search.items]] >= search.fill[source])]
        given = next(search._givable(own, search.sizes[others], 100 - search.fill[search.where[others]]), None)
        assert (sorted(sizes[given].tolist()) if given else None) == pairs_of_a_listing(search, source)


def test_underfull_sequences_of_the_groups_meet_again(spark):
    ship(spark)
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice(["the", "a", "of"]) for _ in range(draw.randrange(1, 12)))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=256, group_pieces=100).collect()
    assert sorted(r.doc_id for r in packed) == list(range(1500))
    fills: dict = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 256 and len(fills) <= -(-sum(fills.values()) // 256) + 1
