"""Personal data and secrets against leftmost scans with the base patterns."""

import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from monthloom.llm import pii, secret_scan
from monthloom.llm.shipping import ship
from monthloom.llm.spans import digest_columns

PIECES = ["a", "B", "1", "22", "256", "0", ".", "..", "@", "-", "+", " ", "(", ")", "é", "a.b", "@x.y", "1.2.3.4", "4111111111111111",
          "4111 1111-1111 1111", "+1 555", "555-1234", "password", "=", ":", "token: ", '"', "AKIA", "AKIAABCDEFGH1234",
          "0123456789abcdef" * 2, "apikey=", "API_KEY:", "_", "İ", "ſecret=", "9" * 20, "%", "\n"]


def random_texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randrange(25))) for _ in range(n)]


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(digits) <= 19 and luhn(digits) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def plain_secrets(t):
    name = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(name, t, re.ASCII) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.BASE_KINDS.index(s[0])))


def test_base_kinds_are_a_leftmost_scan():
    for t in random_texts(3, 8000):
        assert [s for s in pii.find(t) if s[0] in pii.BASE_KINDS] == plain_pii(t), t
        assert [s for s in secret_scan.find(t) if s[0] in secret_scan.BASE_KINDS] == plain_secrets(t), t


def test_expanded_boundaries():
    text = "IBAN DE89370400440532013000, 12 Main Street; account no: 12-3456-789 https://joe:pw@host.com/x Lindenstraße 12"
    found = [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE_KINDS]
    assert found == [("account", "DE89370400440532013000"), ("account", "12-3456-789"), ("login", "joe:pw"),
                     ("street", "12 Main Street"), ("street", "Lindenstraße 12")]
    wrong = text.replace("DE89", "DE88").replace("12 Main Street", "Main Street")
    assert [k for k, *_ in pii.find(wrong)] == ["email", "account", "login", "street"]


def tlv(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


def keys():
    draw = random.Random(1)
    rsa = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\1" + draw.randbytes(100)) for _ in range(8)))
    wrapped = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + tlv(5, b"")) + tlv(4, rsa))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"x" * 40) + field(b"y" * 80)
    return rsa, wrapped, ssh


def test_structure_confirms_encoded_keys():
    rsa, wrapped, ssh = keys()
    for key, kind in ((rsa, "der"), (wrapped, "der"), (ssh, "ssh")):
        coded = base64.b64encode(key).decode()
        assert (kind, 2, 2 + len(coded)) in secret_scan.find(f"a {coded} b")
        assert kind in [k for k, *_ in secret_scan.find(key.hex())]
        broken = base64.b64encode(key[:-3] + b"\0\0").decode()
        assert kind not in [k for k, *_ in secret_scan.find(broken)]
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(rsa).decode() + "-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(block)) in secret_scan.find(block)
    assert secret_scan.find(base64.b64encode(random.Random(2).randbytes(300)).decode()) == []


def test_signed_tokens():
    coded = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).rstrip(b"=").decode()
    token = f"{coded({'alg': 'HS256'})}.{coded({'sub': '1'})}.abc"
    assert secret_scan.find(f"x {token} y") == [("jwt", 2, 2 + len(token))]
    assert secret_scan.find(f"x {coded({'typ': 'none'})}.{coded({'sub': '1'})}.abc") == []


@pytest.mark.parametrize("module, run, plain", [
    (pii, pii.find_pii, plain_pii), (secret_scan, secret_scan.find_secrets, plain_secrets)])
def test_tables(spark, module, run, plain):
    ship(spark)
    texts = [None, "", *random_texts(9, 200), "x" * 100_000 + " a@b.cd token=12345678"]
    docs = spark.createDataFrame([(k // 2, t, "s", 7) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip int")
    found = run(docs, "found", ["doc_id"]).select("doc_id", *digest_columns(F.col("found"), module.BASE_KINDS))
    rows = sorted((r.doc_id, r.spans) for r in found.collect())
    expected = sorted((k // 2, ",".join(f"{a}:{b}:{c}" for a, b, c in module.find(t or ""))) for k, t in enumerate(texts))
    assert rows == expected
    assert run(docs.limit(0), "found").count() == 0
    assert run(docs, "found").columns == [*docs.columns, "found"]


def test_masking_keeps_clean_documents(spark):
    ship(spark)
    rows = [(1, "clean text", 99), (2, 'a token = "abcdefgh12345678" b', 30), (3, None, None), (4, "", 0), (5, "AKIAABCDEFGH123456", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.mask_secrets(docs).collect()}
    assert out == {1: ("clean text", 99), 2: ('a [SECRET]" b', 13), 3: (None, None), 4: ("", 0), 5: ("[SECRET]", 8)}
