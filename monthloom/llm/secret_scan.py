"""Secrets in texts, with structural confirmation of encoded candidates.

The base kinds are what a leftmost scan with their patterns gives: ``assign``
(a value of 8 or more characters given to a telling name), ``access`` (key ids
of 16 or more characters) and ``hex`` (32 or more hex digits).  Long base64
and hex runs are decoded besides, and reported only if their content proves to
be a key or token:

* ``der``: one ASN.1 sequence whose nested lengths add up at every level and
  that starts like a key: a version number and integers, an algorithm, or a
  key octet string; an encrypted key is an algorithm and an octet string;
* ``ssh``: length-prefixed fields that fill the buffer, an OpenSSH private
  key or a public key blob;
* ``jwt``: a signed token, whose header and payload are JSON objects, however
  spaced, and whose header names an algorithm;
* ``pem``: a private-key block whose base64 lines decode to one of these, or to
  whole cipher blocks if its header lines name a cipher.

A key may be wrapped: neighbouring base64 or hex lines of equal length, with
the shorter last one, are one candidate where no line is a key by itself.  Lines
are decoded once, and a candidate is looked at only if its first bytes state the
size that it has, so the time grows with the length of the text.

Defined results: a null or empty text has no spans; any length is scanned
whole; rows are independent, so repeated rows have equal spans and an empty
table gives none; other columns are carried, whatever their names, and one named
like the result gives way to it.  Elements nested deeper than 16 levels, which no
key format has, are not confirmed.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from monthloom.llm.spans import Span, add_spans, replace_texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "ssh", "jwt", "pem")
MASK = "[SECRET]"

_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{48,}")
# three parts, looked for at the beginning of runs only
_THREE_PARTS = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
                  r"(?:[ \t]*\r?\n((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+[^\s][^\n]*\n)*)+))?([A-Za-z0-9+/=\s]*)-----END \1-----")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_HEX_LINE = re.compile(r"[0-9A-Fa-f]+")
_FIELD_NAMES = (b"ssh-", b"ecdsa-", b"sk-")
_LONGEST_NAME = 64
_FIRST = "MAb036"  # how keys start in base64 or hex
_LEAST_BYTES = 16
_DEEPEST = 16


def _decoded(run: str) -> bytes | None:
    text = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _elements(data: memoryview) -> list[tuple[int, memoryview]] | None:
    """Tags and contents that fill ``data`` exactly; nothing if the lengths don't add up."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or not data[at]:
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        found.append((tag, data[at:at + size]))
        at += size
    return found


def _nested(data: memoryview, depth: int = 0) -> bool:
    """Whether the lengths of constructed elements add up at every level."""
    found = _elements(data)
    if found is None or depth > _DEEPEST:
        return False
    return all(len(content) > 0 and _nested(content, depth + 1) for tag, content in found if tag in (0x30, 0x31))


def is_der_key(data: bytes | memoryview) -> bool:
    data = memoryview(data)
    if len(data) < _LEAST_BYTES or data[0] != 0x30:
        return False
    outer = _elements(data)
    if not outer or len(outer) != 1 or not _nested(data):
        return False
    parts = _elements(outer[0][1]) or []
    tags = [tag for tag, _ in parts]
    if len(tags) < 2:
        return False
    version = tags[0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 1
    integers = all(t == 0x02 for t in tags) and len(tags) >= 6 and version  # integers of a private key
    wrapped = version and (tags[1] == 0x04 or tags[1:3] == [0x30, 0x04])    # a curve key, or an algorithm and its key
    named = tags in ([0x30, 0x03], [0x30, 0x04]) and bool(_elements(parts[0][1])) and _elements(parts[0][1])[0][0] == 0x06
    return integers or wrapped or named  # named: the algorithm of a public key's bits or of an encrypted key's bytes


def _fields(data: memoryview, at: int) -> list[memoryview] | None:
    found = []
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return found


def is_ssh_key(data: bytes | memoryview) -> bool:
    data, magic = memoryview(data), b"openssh-key-v1\x00"
    if data[:len(magic)] == magic:
        at = len(magic)
        for _ in range(3):  # cipher, derivation, its options
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        return at + 4 < len(data) and bool(_fields(data, at + 4))
    fields = _fields(data, 0) if len(data) >= _LEAST_BYTES and _starts_with_name(data) else None
    return bool(fields) and len(fields) >= 2


def _starts_with_name(data: bytes | memoryview) -> bool:
    """Whether the first field is the name of a public key."""
    return 4 <= int.from_bytes(data[:4], "big") <= _LONGEST_NAME and bytes(data[4:10]).startswith(_FIELD_NAMES)


def _json_object(run: str) -> dict | None:
    try:
        value = json.loads(_decoded(run) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_token(header: str, payload: str) -> bool:
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def _kind_of(data: bytes | memoryview | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _may_be_key(start: bytes | None) -> bool:
    """Cheap test of the first bytes, before a long run is decoded."""
    return bool(start) and (start[0] == 0x30 or start[:3] == b"\0\0\0" or start.startswith(b"openssh-k"[:len(start)]))


def _is_encrypted(headers: str | None, body: str) -> bool:
    """Header lines that name a cipher, and whole blocks of it."""
    data = _decoded(body) if headers and "ENCRYPTED" in headers and "DEK-Info:" in headers else None
    return bool(data) and len(data) >= _LEAST_BYTES and len(data) % 8 == 0


def _may_fill(start: bytes, size: int) -> bool:
    """Whether a key that starts so can have ``size`` bytes, from its first dozen."""
    if len(start) < 6:
        return False
    if start[0] != 0x30:
        return _starts_with_name(start) if start[:2] == b"\0\0" else start.startswith(b"openssh-k"[:len(start)])
    width = start[1] & 0x7F if start[1] & 0x80 else 0
    return width <= 4 and size == 2 + width + (int.from_bytes(start[2:2 + width], "big") if width else start[1])


def _unhexed(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run)
    except ValueError:
        return None


class _Joined:
    """Lines put together and decoded at most once for each way their digits can fall into groups."""

    def __init__(self, lines: list[str]):
        self._text, self._done = "".join(lines), {}
        self.size = len(self._text.rstrip("="))
        digits, self._hex_from = len(self._text), len(self._text)
        for line in reversed(lines):
            if not _HEX_LINE.fullmatch(line):
                break
            digits -= len(line)
            self._hex_from = digits

    def key_at(self, at: int) -> str | None:
        """The kind of key that everything from a place on holds, in hex digits or base64."""
        start = _unhexed(self._text[at:at + 24]) if at >= self._hex_from else None
        if start and _may_fill(start, (self.size - at) // 2):
            kind = _kind_of(self._from(at, 2, 1, _unhexed))
            if kind:
                return kind
        start = _decoded(self._text[at:at + 16])
        return _kind_of(self._from(at, 4, 3, _decoded)) if start and _may_fill(start, (self.size - at) * 3 // 4) else None

    def _from(self, at: int, digits: int, size: int, decode) -> memoryview | None:
        begin = self._hex_from if decode is _unhexed else 0
        begin += (at - begin) % digits
        if (digits, begin) not in self._done:
            self._done[digits, begin] = decode(self._text[begin:])
        data = self._done[digits, begin]
        return memoryview(data)[(at - begin) // digits * size:] if data else None


def _wrapped(text: str) -> list[Span]:
    """Keys over several lines of equal length and a last one at most as long."""
    spans = []
    for m in _LINES.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        at = 0
        while at < len(lines):
            width, same = lines[at][1] - lines[at][0], at + 1
            while same < len(lines) and lines[same][1] - lines[same][0] == width:
                same += 1
            stops = [same + 1, same] if same < len(lines) and lines[same][1] - lines[same][0] < width else [same]
            starts = [k for k in range(at, same) if text[lines[k][0]] in _FIRST]
            joined = {stop: _Joined([text[a:b] for a, b in lines[at:stop]]) for stop in stops} if starts else {}
            for first, stop in ((first, stop) for first in starts for stop in stops if stop - first > 1):
                kind = joined[stop].key_at((first - at) * width)
                if kind:
                    spans.append((kind, lines[first][0], lines[stop - 1][1]))
                    break
            at = same
    return spans


def _tokens(text: str) -> list[Span]:
    """Signed tokens among three parts with dots; a header may begin inside the first part, where JSON often does."""
    spans = []
    for m in _THREE_PARTS.finditer(text):
        inside = m[1].find("eyJ")
        for at in {0, inside} if inside >= 0 else {0}:
            if len(m[1]) - at >= 4 and is_token(m[1][at:], m[2]):
                spans.append(("jwt", m.start(1) + at, m.end(3)))
    return spans


def find(text: str) -> list[Span]:
    """Spans by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        kind = _kind_of(_decoded(m[0])) if _may_be_key(_decoded(m[0][:12])) else None
        spans += [(kind, *m.span())] if kind else []
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and _may_be_key(bytes.fromhex(m[0][:18])):
            kind = _kind_of(bytes.fromhex(m[0]))
            spans += [(kind, *m.span())] if kind else []
    spans += _tokens(text)
    blocks = _PEM.finditer(text) if "-----BEGIN " in text else []
    blocks = [m.span() for m in blocks if _kind_of(_decoded("".join(m[3].split()))) or _is_encrypted(m[2], "".join(m[3].split()))]
    spans += [("pem", *b) for b in blocks]
    begins = [a for a, _ in blocks]
    for span in _wrapped(text):
        at = bisect_right(begins, span[1]) - 1
        if at < 0 or span[2] > blocks[at][1]:
            spans.append(span)
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, column: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """The documents with the spans of their secrets."""
    return add_spans(docs, column, find, carry)


def masked(text: str, mask: str = MASK) -> str:
    """The text with every secret replaced; overlapping spans are one."""
    parts, at = [], 0
    for _, begin, end in find(text):
        if begin >= at:
            parts += [text[at:begin], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced; documents without any stay as they are.

    ``n_chars`` is set anew where there is such a column.
    """
    return replace_texts(docs, masked)
