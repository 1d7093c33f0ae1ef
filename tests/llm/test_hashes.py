"""Texts on which sums of powers collide, and hashes made equal on purpose."""

import random

import numpy as np
import pytest

from monthloom.llm import near_dedup, shingles, tokens
from monthloom.llm.queries import tokenizer_path
from monthloom.llm.shipping import ship
from monthloom.llm.shingles import hashed_runs, shingle_sets

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def thue_morse(bits):
    word = "".join("ab"[k.bit_count() & 1] for k in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def library(path, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return [whole.encode(t, add_special_tokens=False).ids for t in texts]


def own(encoder, texts):
    ids, sizes = encoder.encode(texts)
    return [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("bits", [10, 11, 12, 13])
def test_shingles_of_alike_words(bits):
    word, other = thue_morse(bits)
    for seed in (0, 1):
        sets = shingle_sets([word, other, f"x {word}", f"x {other}", f"{word} x"], 2, seed)
        assert len({s.tobytes() for s in sets}) == 5


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("bits", [10, 13])
def test_tokens_of_alike_words(file, bits):
    word, other = thue_morse(bits)
    texts = [f"x {word} {other}", f"{other}\n{word}", word, other]
    assert own(tokens.Encoder(tokenizer_path(file)), texts) == library(tokenizer_path(file), texts)


def test_links_of_alike_words(spark):
    ship(spark)
    word, other = thue_morse(10)
    docs = spark.createDataFrame(list(enumerate([f"{word} x", f"{other} x", word, other])), "doc_id long, text string")
    assert sorted(r.component_id for r in near_dedup.near_duplicates(docs, words=2).collect()) == [0, 1, 2, 3]


def test_no_collisions_of_many_words():
    """Short words, long words that differ in one place, zero bytes, and shifted blocks."""
    draw = random.Random(1)
    words = {bytes([65 + a, 97 + b, 97 + c]) for a in range(26) for b in range(26) for c in range(26)}
    words |= {b"\x00" * n for n in range(1, 40)} | {b"a" * n + b"\x00" * m for n in range(1, 12) for m in range(12)}
    for n in (8, 9, 16, 24, 200):
        base = bytes(draw.randrange(97, 123) for _ in range(n))
        words |= {base[:k] + bytes([c]) + base[k + 1:] for k in range(n) for c in range(97, 123)}
        words |= {base[k:] + base[:k] for k in range(n)}
    words |= {bytes(draw.choices(b"ab", k=64)) for _ in range(50_000)}
    words = sorted(words)
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    space = data == 0x20
    first = hashed_runs(data, starts, space, False)
    assert len(np.unique(first.hashes)) == len(words) and first.sizes.tolist() == [len(w) for w in words]
    assert len(np.unique(hashed_runs(data, starts, space, False, 1).hashes)) == len(words)


@pytest.mark.parametrize("file", FILES)
def test_equal_hashes_are_seen(monkeypatch, file):
    """With a hash of three values, chunks of a batch and chunks of the table still aren't mixed up."""
    def poor(*args):
        found = hashed_runs(*args)
        return shingles.Runs(found.hashes % np.uint64(3), found.sizes, found.blocks, found.first, found.counts)

    monkeypatch.setattr(tokens, "hashed_runs", poor)
    encoder = tokens.Encoder(tokenizer_path(file))
    for texts in (["one"], ["two"], ["three"], ["four", "one two"], ["some more words", "", None], ["one"]):
        assert own(encoder, texts) == library(tokenizer_path(file), [t or "" for t in texts])


def test_pairs_equal_under_one_hash_only():
    a, b, c = (np.arange(k, k + 10, dtype=np.uint64).tobytes() for k in (0, 0, 500))
    assert near_dedup._proven(a, b, 80) and not near_dedup._proven(a, c, 80)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([3, 4]), pa.array([a, a]), pa.array([b, b]), pa.array([a, a]), pa.array([c, b])],
        names=["u", "v", "codes_u", "codes_v", "proof_u", "proof_v"])
    (made,) = near_dedup._confirm(80)([batch])
    assert made.to_pydict() == {"u": [2], "v": [4]}


def test_any_number_of_spaces_between_words():
    words = ["a", "bcdefghi", "jklmnopqrstuvwxyz", "é"]
    plain = shingle_sets([" ".join(words)], 2)[0]
    for n in (2, 3, 4, 5, 6, 50, 10_000):
        for gap in (" " * n, "\n" * n, "\t " * n):
            assert (shingle_sets([gap + gap.join(words) + gap], 2)[0] == plain).all()
