"""Street addresses of any length."""

import random
import re

import pytest

from monthloom.llm import pii

SHORT = re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w.'-]* ){0,3}[A-Z][\w.'-]*\Z")


def streets(text):
    return [text[a:b] for k, a, b in pii.find(text) if k == "street"]


@pytest.mark.parametrize("address", [
    "12 " + " ".join(c * 40 for c in ("Ab", "Cd", "Ef", "Gh")) + " Street",
    "1234567 Main Street", "98765 " + "M" + "x" * 70 + " Avenue", "123456b St. Mary's Road", "X" + "y" * 120 + "straße 7", "Hauptstraße 123456b",
    "12 Highway7 Main Street", "12 Main Street"])
def test_whole_addresses(address):
    assert streets(f"to {address}, or no. {address}") == [address] * 2


@pytest.mark.parametrize("text", ["Main Street", "12 Street", "12 A B C D E Street", "12 main Street", "12  Main Street"])
def test_no_addresses(text):
    assert streets(text) == []


def short_streets(text):
    """Before each street word, the leftmost address that ends there, in a text shorter than any window."""
    out, resume = [], 0
    for cue in re.finditer(r"(?i: street)(?!\w)", text):
        found = SHORT.search(text[resume:cue.start()]) if cue.start() >= resume else None
        if found:
            out.append(text[resume + found.start():cue.end()])
            resume = cue.end()
    return out


def test_short_addresses_as_before():
    draw, parts = random.Random(7), ["12", "7b", "Main", "St.", "O'Neil", "x", "street", "Street", "No.5", "Route66", "(3", ","]
    for _ in range(5000):
        text = " ".join(draw.choice(parts) for _ in range(8))
        assert streets(text) == short_streets(text), text


@pytest.mark.parametrize("identifier", ["X1" * 10, "X1" * 11, "1234-" * 6 + "X", "X1" * 17])
def test_accounts_of_all_lengths(identifier):
    text = f"your account: {identifier}."
    assert [text[a:b] for k, a, b in pii.find(text) if k == "account"] == [identifier]
