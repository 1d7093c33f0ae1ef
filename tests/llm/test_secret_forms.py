"""Secrets in the forms that real files give them."""

import base64
import json
import random

from monthloom.llm import secret_scan
from tests.llm.test_scans import keys, tlv

OID = tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d")


def test_encrypted_keys():
    draw = random.Random(4)
    locked = tlv(0x30, tlv(0x30, OID + tlv(0x30, tlv(4, draw.randbytes(8)))) + tlv(4, draw.randbytes(320)))
    block = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{base64.encodebytes(locked).decode()}-----END ENCRYPTED PRIVATE KEY-----"
    assert secret_scan.find(block) == [("pem", 0, len(block))]
    assert secret_scan.masked(f"a {block} b") == "a [SECRET] b"
    plain = tlv(0x30, tlv(0x30, tlv(4, b"no name of a cipher")) + tlv(4, draw.randbytes(320)))
    assert secret_scan.find(block.replace(base64.encodebytes(locked).decode(), base64.encodebytes(plain).decode())) == []


def test_header_lines_in_blocks():
    body = base64.encodebytes(random.Random(5).randbytes(320)).decode()
    block = ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233AABBCCDD\n\n"
             f"{body}-----END RSA PRIVATE KEY-----")
    assert ("pem", 0, len(block)) in secret_scan.find(block)
    assert "pem" not in [k for k, *_ in secret_scan.find(block.replace("DEK-Info", "Other"))]


def test_keys_over_several_lines_without_marks():
    rsa, wrapped, ssh = keys()
    for key, kind in ((rsa, "der"), (wrapped, "der"), (ssh, "ssh")):
        for coded in (base64.b64encode(key).decode(), key.hex()):
            for width in (64, 76):
                lines = "\n".join(coded[k:k + width] for k in range(0, len(coded), width))
                for before, after in (("key:\n", "\nend"), ("", ""), ("x" * width + "\n", " end"), ("a ", "\r\n\r\nend")):
                    found = secret_scan.find(before + lines + after)
                    assert (kind, len(before), len(before) + len(lines)) in found, (kind, width, before, after)
    lines = base64.encodebytes(random.Random(6).randbytes(600)).decode()
    assert secret_scan.find(lines) == []


def test_tokens_with_spaced_headers():
    coded = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    payload = coded(json.dumps({"sub": "1"}).encode())
    for header in (b'{ "alg": "HS256" }', b'{\n"alg":"HS256"}', b' {"alg":"HS256"}', b'{"alg":"HS256"}'):
        token = f"{coded(header)}.{payload}.abc"
        assert secret_scan.find(f"x www-example.{token} y")[-1] == ("jwt", 14, 14 + len(token))
        assert secret_scan.find(f"see {token}") == [("jwt", 4, 4 + len(token))]
    assert secret_scan.find("documents.example.org and some-long-name.with.parts") == []
