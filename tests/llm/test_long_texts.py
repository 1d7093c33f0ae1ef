"""Scans whose time grows with the text, words without spaces, and clashing column names."""

import base64
import random
import time

import pytest

from monthloom.llm import pii, quality, secret_scan, token_counts
from monthloom.llm.queries import tokenizer_path
from monthloom.llm.shipping import ship
from tests.llm.test_tokens import brute_count

_NOISE = random.Random(1)


def lines(data: bytes, width: int = 76) -> str:
    text = base64.b64encode(data).decode()
    return "\n".join(text[k:k + width] for k in range(0, len(text), width))


@pytest.mark.parametrize("text", [
    ("A" * 76 + "\n") * 13_000, "eyJ" * 350_000, lines(_NOISE.randbytes(300_000) + bytes(400_000)), ("MIIB" + "A" * 72 + "\n") * 13_000,
    (lines(b"openssh-key-v1\x00" + bytes(42)) + "\n") * 13_000, "-----BEGIN PRIVATE KEY-----\n" * 30_000, ("30" + "0" * 62 + "\n") * 15_000,
], ids=["zero lines", "token starts", "zeros after noise", "key starts", "marks", "openings", "hex"])
def test_a_million_characters_take_a_second(text):
    began = time.process_time()
    secret_scan.find(text)
    assert time.process_time() - began < 2  # 0.1 to 0.4 alone; the machine may be shared


def der(n: int) -> bytes:
    """A private key of the PKCS 8 form with n random bytes."""
    def element(tag, body):
        size = len(body)
        head = bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")
        return bytes([tag]) + head + body

    return element(0x30, element(2, b"\0") + element(0x30, element(6, b"\x2a\x86\x48")) + element(4, _NOISE.randbytes(n)))


@pytest.mark.parametrize("width", [64, 66, 70, 77])
def test_wrapped_keys_between_other_lines(width):
    """The key begins at a line that is no multiple of four characters from the first."""
    key = lines(der(600), width)
    for before in (0, 1, 2, 3):
        noise = "".join("x" * width + "\n" for _ in range(before))
        text = f"{noise}{key}\nend of it"
        assert ("der", len(noise), len(noise) + len(key)) in secret_scan.find(text)
    hexed = der(300).hex()
    text = "\n".join(hexed[k:k + 64] for k in range(0, len(hexed), 64))
    assert ("der", 0, len(text)) in secret_scan.find(text)


def test_tokens_inside_runs():
    part = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    token = f'{part(chr(123) + chr(34) + "alg" + chr(34) + ":" + chr(34) + "HS256" + chr(34) + "}")}.{part("{}")}.sig'
    for before, after in (("", ""), ("abc.", ""), ("abc", ""), ("x.y.", ".z"), ("eyJ.", "")):
        text = f" {before}{token}{after} "
        assert any(k == "jwt" and text[a:b].startswith(token[:10]) for k, a, b in secret_scan.find(text)), text


@pytest.mark.parametrize("run", [pii.find_pii, secret_scan.find_secrets])
def test_clashing_columns(spark, run):
    ship(spark)
    names = "spans string, text string, `_finder_text` string, `row` int, `a.b` int, `Found` int"
    docs = spark.createDataFrame([("s", "mail a@b.org password: hunter2222", "f", 1, 2, 3), (None, None, None, None, None, None)], names)
    made = run(docs).orderBy("row")
    assert made.columns == ["text", "_finder_text", "row", "a.b", "Found", "spans"]
    rows = made.collect()
    assert rows[0].spans == [] and len(rows[1].spans) == 1 and (rows[1]["a.b"], rows[1]["_finder_text"]) == (2, "f")
    assert run(docs, "found").columns == ["spans", "text", "_finder_text", "row", "a.b", "found"]
    assert run(docs.limit(0)).count() == 0


def test_words_longer_than_the_trie():
    path = tokenizer_path("piece_bpe_32k.model")
    scores, byte = token_counts.piece_scores(path)
    draw = random.Random(3)
    counter = token_counts.Counter(path)
    for n in (62, 63, 64, 65, 70, 130, 900):
        word = "".join(draw.choice(["the", "ing", "e", "é", "\U0001f600", "tion", "x"]) for _ in range(n))[:n]
        score, pieces = brute_count(word, scores, byte)
        assert counter.count([word, f"{word} a"])[0] == (1, pieces, score)


def test_one_very_long_word_takes_no_memory():
    import tracemalloc

    counter = token_counts.Counter(tokenizer_path("piece_bpe_32k.model"))
    word = "abcdefgh" * 100_000
    tracemalloc.start()
    assert counter.count([word])[0][0] == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # the word itself in a few forms


def test_small_hosts_do_not_weaken_the_prior(spark):
    """Rates of hosts with one document are 0 or 1 by chance; that doesn't make hosts differ."""
    good, bad = " ".join(f"w{k}" for k in range(30)), "short"
    rows = [(k, bad if k % 4 == 0 else good, f"h{k}") for k in range(400)]
    rows += [(1000, bad, "three"), (1001, bad, "three"), (1002, good, "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_table(docs).collect()}
    assert kept[1002] and all(kept[k] == (k % 4 != 0) for k in range(400))
    rates = {r.source: r.rate for r in quality.host_rates(quality.measured(docs)).collect()}
    assert abs(rates["three"] - 0.25) < 0.05


def test_hosts_that_differ_still_do(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "short"
    rows = [(h * 100 + k, bad if k < (18 if h % 2 else 1) else good, f"h{h}") for h in range(12) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_table(docs).collect()}
    assert all(kept[h * 100 + 19] == (h % 2 == 0) for h in range(12))
