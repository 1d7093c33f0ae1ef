"""Word shingles of texts as sets of 64-bit hashes, computed for many texts at once.

A word is hashed by eight bytes at a time: each block is mixed, by functions
that are not linear, with its place in the word before the blocks are summed.
Seeds give independent functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# A to Z count as a to z
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A"):ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)  # the first k of eight bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Runs:
    """Runs of bytes: their hashes, and the blocks of eight bytes that tell them apart for certain."""

    hashes: np.ndarray
    sizes: np.ndarray   # bytes of each run
    blocks: np.ndarray  # of all runs, one after the other
    first: np.ndarray   # of each run
    counts: np.ndarray  # of each run
    whole: bool = False  # the blocks are those of these runs, in their order

    def take(self, rows: np.ndarray) -> "Runs":
        """Some of the runs; their blocks stay where they are."""
        return Runs(self.hashes[rows], self.sizes[rows], self.blocks, self.first[rows], self.counts[rows])

    def packed(self) -> np.ndarray:
        """The blocks of the runs in order."""
        if self.whole:
            return self.blocks
        ends = np.cumsum(self.counts)
        return self.blocks[np.repeat(self.first - (ends - self.counts), self.counts) + np.arange(ends[-1] if len(ends) else 0)]

    def same(self, other: "Runs") -> bool:
        """Whether every run has the bytes of the other's at its place."""
        return bool((self.sizes == other.sizes).all()) and bool((self.packed() == other.packed()).all())

    def same_as(self, rows: np.ndarray) -> bool:
        """Whether every run has the bytes of the run that is named for it; most are one block."""
        if not (self.sizes == self.sizes[rows]).all():
            return False
        begin = self.blocks[np.minimum(self.first, max(len(self.blocks) - 1, 0))] if len(self.blocks) else self.first
        if not (begin == begin[rows]).all():
            return False
        longer = np.flatnonzero(self.counts > 1)
        return self.take(longer).same(self.take(rows[longer]))


def _skipped_at_ends(starts: np.ndarray, ends: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """How many bytes are skipped at the end of each run: one by one, and by a running count where there are many."""
    found, open_ = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts))
    for back in range(1, 5):
        at = ends[open_] - back
        open_ = open_[(at >= starts[open_]) & skipped[np.maximum(at, 0)]]
        if not len(open_):
            return found
        found[open_] = back
    upto = np.concatenate([[0], np.cumsum(skipped, dtype=np.int64)])
    found[open_] = upto[ends[open_]] - upto[starts[open_]]
    return found


def hashed_runs(data: np.ndarray, starts: np.ndarray, skipped: np.ndarray, folded: bool, seed: int = 0) -> Runs:
    """The bytes from each start to the next, without the skipped ones at their ends."""
    ends = np.append(starts[1:], len(data))
    sizes = ends - starts - _skipped_at_ends(starts, ends, skipped)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = _FOLDED[data] if folded else data
    # the eight bytes from every place on, as one number each
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    counts = -(-sizes // 8)
    first = np.cumsum(counts) - counts
    number = np.arange(int(counts.sum())) - np.repeat(first, counts)
    rest = np.minimum(np.repeat(sizes, counts) - 8 * number, 8)
    blocks = eight[np.repeat(starts, counts) + 8 * number] & _MASKS[rest]
    salts = mixed(np.arange(int(counts.max(initial=0)), dtype=np.uint64) * _STEP + np.uint64(seed))
    spread = np.append(mixed(salts[number] ^ blocks), np.uint64(0))
    sums = np.where(counts > 0, np.add.reduceat(spread, first), np.uint64(0))
    return Runs(mixed(sums + mixed(sizes.astype(np.uint64) + _WORD_STEP + np.uint64(seed))), sizes, blocks, first, counts, True)


def _word_hashes(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes."""
    space = SPACES[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = True, space
    starts = np.flatnonzero(before[:-1] & ~space)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    return starts, hashed_runs(data, starts, space, True, seed).hashes


def _folded_sum(hashes: np.ndarray, words: int, n: int, seed: int) -> np.ndarray:
    """One number for each run of so many words, by mixing in one after the other."""
    runs = np.full(n, words + (seed << 32), dtype=np.uint64)
    for k in range(words):
        runs = mixed(runs ^ hashes[k:k + n]) + _STEP
    return runs


def shingle_sets(texts: list[str | None], words: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; a shorter text is one shingle, one without words none.

    A to Z count as a to z.  Words are separated by the space and U+0009 to U+000D.
    """
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    starts, hashes = _word_hashes(data, seed)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    runs = _folded_sum(hashes, words, max(len(hashes) - words + 1, 0), seed)
    found = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            found.append(np.unique(runs[a:b - words + 1]))
        elif b > a:
            found.append(_folded_sum(hashes[a:b], b - a, 1, seed))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found
