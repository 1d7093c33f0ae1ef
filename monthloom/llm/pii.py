"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, digits, plus signs, URL schemes
and cue words.  A local parser expands each anchor to the boundaries of a
candidate and validates it.  Every kind keeps its own resume position, so
matches of a kind don't overlap, and the four base kinds give exactly what a
leftmost scan of the whole text with their patterns gives:

* ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits, Luhn),
  ``phone`` (8 to 15 digits); a match that fails its check is passed over whole;
* added: ``account`` (identifier after a cue word, 6 to 34 characters, which is
  the longest IBAN, with 4 digits or more; an IBAN by its check digits),
  ``login`` (user part of a URL), ``street`` (house number before or after a
  street name of up to four words with one of the eight street words below; post
  boxes, postal codes and other street words are outside the scope).

Defined results: a null or empty text has no spans; any length is scanned
whole; rows are independent, so repeated rows give repeated results and an empty
table gives none; other columns are carried, whatever their names, and one named
like the result gives way to it.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame

from monthloom.llm.spans import Span, add_spans

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login", "street")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "kontonummer", "compte", "cuenta")
STREET_CUES = (" street", " avenue", " road", " boulevard", " lane", " drive", "straße", "strasse")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|no|nr|id)\b\.?)?[ ]?[:#=]?[ ]?([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.ASCII)
_USER = re.compile(r"([A-Za-z0-9._~%+-]+(?::[^\s/@]*)?)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_NAME_WORD = re.compile(r"[A-Z][\w.'-]*")
_NAME_MARKS = frozenset("_.'-")
_NUMBER_TAIL = re.compile(r"(?<![0-9])[0-9]+[A-Za-z]?\Z")
_STREET_AFTER = re.compile(r" [0-9]+[a-z]?\b")
_MOST_WORDS = 4  # of a street name


@cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, cues in {"@": "@", "+": "+", "digit": "0123456789", "scheme": ["://"],
                       "account": ACCOUNT_CUES, "street": STREET_CUES}.items():
        for cue in cues:
            automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def _lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(identifier: str) -> bool:
    return int("".join(str(int(c, 36)) for c in identifier[4:] + identifier[:4])) % 97 == 1


class _Scan:
    """One text; ``resume`` holds where each kind goes on."""

    def __init__(self, text: str):
        self.text, self.resume, self.spans = text, dict.fromkeys(KINDS, 0), []

    def add(self, kind: str, begin: int, end: int) -> None:
        self.spans.append((kind, begin, end))

    def email(self, at: int) -> None:
        begin, least = at, self.resume["email"]
        while begin > least and self.text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(self.text, at + 1) if begin < at else None
        if domain:
            self.add("email", begin, domain.end())
            self.resume["email"] = domain.end()

    def digit(self, at: int) -> None:
        if at >= self.resume["ip"]:
            match = _IP.match(self.text, at)
            if match:
                self.resume["ip"] = match.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.groups()):
                    self.add("ip", *match.span())
            else:  # no match starts later in this run of digits either
                end = at + 1
                while end < len(self.text) and self.text[end] in "0123456789":
                    end += 1
                self.resume["ip"] = end
        if at >= self.resume["card"]:
            match = _CARD.match(self.text, at)
            if match:
                self.resume["card"] = match.end()
                digits = match[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    self.add("card", *match.span())

    def phone(self, at: int) -> None:
        match = _PHONE.match(self.text, at) if at >= self.resume["phone"] else None
        if match:
            self.resume["phone"] = match.end()
            if 8 <= sum(c.isdigit() for c in match[0]) <= 15:
                self.add("phone", *match.span())

    def account(self, begin: int, end: int) -> None:
        if begin < self.resume["account"] or (begin and self.text[begin - 1].isalnum()):
            return
        match = _ACCOUNT.match(self.text, end)
        if not match:
            return
        identifier = match[1].replace(" ", "").replace("-", "")
        valid = _iban(identifier) if re.match("[A-Z]{2}[0-9]{2}", identifier) else True
        if valid and sum(c.isdigit() for c in identifier) >= 4:
            self.add("account", *match.span(1))
            self.resume["account"] = match.end()

    def login(self, end: int) -> None:
        match = _USER.match(self.text, end) if end >= self.resume["login"] else None
        if match:
            self.add("login", *match.span(1))
            self.resume["login"] = match.end(1)

    def house_number(self, end: int) -> int | None:
        """Where the house number before one to four whole name words begins; the furthest, back word by word."""
        least, found = self.resume["street"], None
        for words in range(_MOST_WORDS + 1):
            begin = end
            while begin > least and (self.text[begin - 1].isalnum() or self.text[begin - 1] in _NAME_MARKS):
                begin -= 1
            number = _NUMBER_TAIL.search(self.text, begin, end) if words else None
            found = number.start() if number else found
            if not _NAME_WORD.fullmatch(self.text, begin, end) or begin <= least or self.text[begin - 1] != " ":
                break
            end = begin - 1
        return found

    def street(self, begin: int, end: int) -> None:
        if begin < self.resume["street"] or self.text[end:end + 1].isalnum():
            return
        found = None
        if self.text[begin] == " ":  # house number, name, street word
            start = self.house_number(begin)
            found = (start, end) if start is not None else None
        else:  # name with street word, house number
            start, after = begin, _STREET_AFTER.match(self.text, end)
            while after and start > self.resume["street"] and self.text[start - 1].isalnum() and not self.text[start - 1].isdecimal():
                start -= 1
            found = (start, after.end()) if after and start < begin else None
        if found:
            self.add("street", *found)
            self.resume["street"] = found[1]


def find(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    scan = _Scan(text)
    for last, (kind, length) in _anchors().iter(_lowered(text)):
        begin, end = last - length + 1, last + 1
        if kind == "digit":
            scan.digit(begin)
        elif kind == "@":
            scan.email(begin)
        elif kind == "+":
            scan.phone(begin)
        elif kind == "scheme":
            scan.login(end)
        elif kind == "account":
            scan.account(begin, end)
        else:
            scan.street(begin, end)
    return sorted(scan.spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, column: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """The documents with the spans of their personal data."""
    return add_spans(docs, column, find, carry)
