"""Token files, packing and token counts against the libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from monthloom.llm import packing, token_counts, token_files
from monthloom.llm.queries import tokenizer_path
from monthloom.llm.shipping import ship
from monthloom.llm.tokens import Encoder
from monthloom.session import scratch_dir

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = [None, "", " ", "  a", "a  b ", "a \n b", "x\n\ny", "It's don't I'LL", "<|endoftext|> a <|startoftext|>", "é café İ ΣΣ",
         "a\x85b \xa0 c", "tab\tx\x0by\x0cz\rq", "a, |, | b", "\nabc", "abc\n", "abc.\nDef, x", "12 34.5 1,000", "ﬁ ½ ²",
         "日本語 テキスト", "\U0001f600 x", "Ñandú. Übung, ªº µ ÿ × ÷ þ", "a.\n.b", "\x1c a \x1d", " a", "\n", "a \x00b", "word " * 5000]


def texts(seed, n):
    draw = random.Random(seed)
    parts = ["a", "B", "é", ".", ",", "\n", "\t", " ", " ", " ", "'", "|", "1", "ß", "<", "the", "ing", "'s"]
    return TEXTS + ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(n)]


def expected_ids(file, many):
    tokenizer = Tokenizer.from_file(tokenizer_path(file))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in many]


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("limit", [500, 100_000])
def test_encoder_gives_the_ids_of_the_library(file, limit):
    many, encoder = texts(1, 3000), Encoder(tokenizer_path(file), limit)
    expected = expected_ids(file, many)
    for at in range(0, len(many), 97):
        ids, sizes = encoder.encode(many[at:at + 97])
        assert ids.tolist() == [i for e in expected[at:at + 97] for i in e]
        assert sizes.tolist() == [len(e) for e in expected[at:at + 97]]


def documents(spark, many):
    rows = [(k * 7 % len(many), t, "x", 5) for k, t in enumerate(many)] + [(None, "no id", "x", 5), (3, "again", "x", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, part string, place int").repartition(3)


@pytest.mark.parametrize("limit", [token_files.BROADCAST_PARTS, -1])
def test_token_files_round_trip(spark, monkeypatch, limit):
    ship(spark)
    monkeypatch.setattr(token_files, "BROADCAST_PARTS", limit)
    rows, docs = documents(spark, texts(2, 300))
    path = scratch_dir(spark, "files")
    token_files.write_token_files(docs, path, tokenizer_path(FILES[1]), row_group_bytes=1 << 16, page_bytes=1 << 12)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for (i, *_), ids in zip(rows, expected_ids(FILES[1], [r[1] for r in rows])):
        expected.append((i, start, len(ids) + 1, [*ids, 0]))
        start += len(ids) + 1
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in found] == expected
    metadata = token_files.read_token_files(spark, path, tokens=False)
    assert metadata.columns == ["doc_id", "start", "n_tokens"]
    assert "ids" not in metadata._jdf.queryExecution().executedPlan().toString()


def test_files_have_the_stated_encodings(spark):
    import glob
    import pyarrow.parquet as pq

    ship(spark)
    _, docs = documents(spark, texts(2, 300))
    path = scratch_dir(spark, "files")
    token_files.write_token_files(docs, path, tokenizer_path(FILES[1]))
    group = pq.ParquetFile(sorted(glob.glob(path + "/part-*"))[0]).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings or "PLAIN_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if n != "ids.list.element")


def test_empty_tables(spark):
    ship(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_dir(spark, "files")
    token_files.write_token_files(docs, path, tokenizer_path(FILES[1]))
    assert token_files.read_token_files(spark, path).count() == 0
    assert packing.pack_documents(docs, tokenizer_path(FILES[0])).count() == 0
    assert token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_packing_places_every_piece_once(spark):
    ship(spark)
    rows, docs = documents(spark, texts(4, 400))
    packed = packing.pack_documents(docs, tokenizer_path(FILES[0]), capacity=64, group_pieces=100).collect()
    expected = []
    for (i, *_), ids in zip(rows, expected_ids(FILES[0], [r[1] for r in rows])):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at:at + 64], dtype="<u4")
            expected.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(expected, key=repr)
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(e[3] for e in expected) / 64 * 1.03 + 6


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 3, 3])  # best fit decreasing needs one bin more
    bins = packing.pack(sizes, 15)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 15 for b in bins)
    assert len(bins) == 4
    draw = np.random.default_rng(2)
    for _ in range(20):
        sizes = draw.integers(1, 101, size=60)
        before, after = packing._best_fit(sizes, 100), packing.pack(sizes, 100)
        assert len(after) <= len(before) and all(sizes[b].sum() <= 100 for b in after)


def brute_count(word, scores, byte_score):
    word = token_counts.WORD_MARK + word
    best = [(0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores]
        if word[e - 1] not in scores:
            n = len(word[e - 1].encode())
            options.append((best[e - 1][0] + n * byte_score, best[e - 1][1] - n))
        best[e] = max(options)
    return best[-1][0], -best[-1][1]


def test_token_counts_equal_the_full_search(spark):
    ship(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    scores, byte_score = token_counts.piece_scores(path)
    many = [t for t in texts(6, 200) if t is None or len(t) < 1000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(many)], "doc_id long, text string, score string")
    found = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(docs, path).collect()}
    for k, t in enumerate(many):
        results = [brute_count(w.decode(), scores, byte_score) for w in (t or "").encode().split()]
        assert found[k] == (len(results), sum(n for _, n in results), sum(s for s, _ in results))


def test_trie_survives_its_limit():
    scores, byte_score = {"a": -3, "b": -4, "ab": -5, "▁": -1, "▁a": -2}, -50
    trie = token_counts.Trie(scores, byte_score, node_limit=5)
    for word in ("ab", "abab", "ba", "é", "ab", "bbbbbb"):
        value = trie.insert("▁" + word)
        pieces = -value % token_counts._UNIT
        assert ((value + pieces) // token_counts._UNIT, pieces) == brute_count(word, scores, byte_score)
