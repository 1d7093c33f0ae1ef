"""Token ids of whole texts by the tokenizers library, with a bounded table of chunks.

Both tokenizers used here cut a text between words, marks and white space
before any merge, so the ids of a text are the ids of its chunks put together.
A chunk is a word, with the space before it where the tokenizer keeps spaces,
or what stands between words; cuts are made only where both sides are known
letters, common marks or single line ends.  The chunks of many texts are hashed
at once, each distinct one is looked up or encoded, and the ids are gathered by
array operations.  The table of a worker is emptied when it is full.  Texts with
special tokens or unusual white space are encoded in one piece.  Chunks are found
by 64-bit hashes and compared byte by byte, with each other and with the table;
texts with chunks of equal hash but other bytes are encoded in one piece too.
"""

from __future__ import annotations

import os
import re

import numpy as np

from monthloom.llm.shingles import SPACES, Runs, hashed_runs

TABLE_LIMIT = 1_200_000  # chunks, near 60 bytes each
TABLE_BLOCKS = 8_000_000  # of eight bytes
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?|"
_ONE_PIECE = re.compile(rf" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n")
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in _MARKS])
_IS_LETTER = np.isin(np.arange(256), [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
# white space on which the libraries' notions differ, and other invisible characters
_ODD = re.compile("[" + "".join(map(chr, (
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060,
    0x3000, 0xFEFF))) + "]")
_SPACE_RUN = re.compile(r" (?!\S)")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class EqualHashes(Exception):
    """Two chunks have one hash."""


class _Grown:
    """An array that numbers are added to."""

    def __init__(self, dtype):
        self.size, self.values = 0, np.zeros(1 << 14, dtype=dtype)

    def add(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.size:self.size + len(more)] = more
        self.size += len(more)


class _Table:
    """Ids of known chunks, one after the other in an array; hashes in sorted order name their numbers."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self._hashes, self._numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self._ids, self._ends = _Grown("<u4"), _Grown(np.int64)  # the end of chunk k is at k + 1
        self._ends.add(np.zeros(1, dtype=np.int64))
        self._blocks, self._first, self._sizes = _Grown(np.uint64), _Grown(np.int64), _Grown(np.int64)

    @property
    def ids(self) -> np.ndarray:
        return self._ids.values

    @property
    def ends(self) -> np.ndarray:
        return self._ends.values

    def has_room(self, chunks: Runs) -> bool:
        return (self.size + len(chunks.hashes) <= self.limit
                and self._blocks.size + int(chunks.counts.sum()) <= TABLE_BLOCKS)

    def find(self, chunks: Runs) -> np.ndarray:
        """Numbers of chunks in the order of their hashes, -1 for those that are missing."""
        if not self.size:
            return np.full(len(chunks.hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self._hashes, chunks.hashes), self.size - 1)
        known = self._hashes[at] == chunks.hashes
        numbers = np.where(known, self._numbers[at], -1).astype(np.int64)
        rows = numbers[known]
        sizes = self._sizes.values[rows]
        stored = Runs(self._hashes[at[known]], sizes, self._blocks.values, self._first.values[rows], -(-sizes // 8))
        if not stored.same(chunks.take(known)):
            raise EqualHashes
        return numbers

    def add(self, chunks: Runs, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new chunks, whose ids follow each other."""
        begin, end = self.size, int(self.ends[self.size])
        self.size += len(chunks.hashes)
        self._ids.add(ids)
        self._ends.add(end + np.cumsum(counts))
        self._first.add(self._blocks.size + np.cumsum(chunks.counts) - chunks.counts)
        self._blocks.add(chunks.packed())
        self._sizes.add(chunks.sizes)
        numbers = np.arange(begin, self.size)
        every = np.concatenate([self._hashes, chunks.hashes])
        order = np.argsort(every, kind="stable")
        self._hashes = every[order]
        self._numbers = np.concatenate([self._numbers, numbers.astype(np.int32)])[order]
        return numbers


class Encoder:
    """``encode(texts)`` gives (ids of all texts, number of ids of each); null is the empty text."""

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._spaced = self._whole.normalizer is None  # spaces belong to the words that follow
        self._table = _Table(limit)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain = [t or "" for t in texts]
        alone = {k: self._direct(t) for k, t in enumerate(plain) if self._irregular(t)}
        try:
            ids, sizes = self._by_chunks([("" if k in alone else t).encode() for k, t in enumerate(plain)])
        except EqualHashes:
            pieces = [alone.get(k, self._direct(t)) for k, t in enumerate(plain)]
            return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
        if not alone:
            return ids, sizes
        pieces = np.split(ids, np.cumsum(sizes)[:-1])
        pieces = [alone.get(k, p) for k, p in enumerate(pieces)]
        return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)

    def _irregular(self, text: str) -> bool:
        return bool(_ODD.search(text) or (self._spaced and _SPACE_RUN.search(text))
                    or any(s in text for s in self._special))

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _by_chunks(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(c) + 1 for c in coded]) - 1  # the joining spaces
        white = SPACES[data]
        heads, skipped = _cuts(data), white
        if self._spaced:  # chunks begin at texts, at spaces in them, and around single line ends
            lines = np.flatnonzero((data[1:-1] == 0x0A) & ~white[:-2] & ~white[2:]) + 1
            heads[lines], heads[lines + 1] = True, True
            heads |= data == 0x20
            heads[ends] = False
            heads[(ends - [len(c) for c in coded])[[len(c) > 0 for c in coded]]] = True
            skipped = np.zeros(len(data), dtype=bool)
            skipped[ends] = True
        else:
            heads[1:] |= white[:-1]
            heads[0] = True
            heads &= ~white
        starts = np.flatnonzero(heads)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(coded), dtype=np.int64)
        chunks = hashed_runs(data, starts, skipped, not self._spaced)
        _, first, inverse = np.unique(chunks.hashes, return_index=True, return_inverse=True)
        if not chunks.same_as(first[inverse]):
            raise EqualHashes
        numbers = self._numbers(chunks.take(first), first, data, starts, ends)
        begin, end = self._table.ends[numbers], self._table.ends[numbers + 1]
        begin, counts = begin[inverse], (end - begin)[inverse]
        filled = np.cumsum(counts)
        ids = self._table.ids[np.repeat(begin - (filled - counts), counts) + np.arange(filled[-1])]
        through = np.concatenate([[0], filled])[np.searchsorted(starts, ends)]
        return ids, np.diff(through, prepend=0)

    def _numbers(self, chunks: Runs, first, data, starts, ends) -> np.ndarray:
        """Numbers of distinct chunks in the table; the missing ones are encoded."""
        numbers = self._table.find(chunks)
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers
        if not self._table.has_room(chunks.take(missing)):
            self._table.clear()
            missing = np.arange(len(first))
        begins = starts[first[missing]]
        stops = np.append(starts, len(data))[first[missing] + 1]
        if self._spaced:
            stops = np.minimum(stops, ends[np.searchsorted(ends, begins)])  # without spaces that join texts
        raw = data.tobytes()
        found = [self._chunk((raw[a:b] if self._spaced else raw[a:b].split()[0]).decode())
                 for a, b in zip(begins.tolist(), stops.tolist())]
        counts = np.array([len(f) for f in found])
        numbers[missing] = self._table.add(chunks.take(missing), np.array([i for f in found for i in f], dtype="<u4"), counts)
        return numbers

    def _chunk(self, chunk: str) -> list[int]:
        """A single piece goes straight to the model, anything else through the whole chain."""
        if not _ONE_PIECE.fullmatch(chunk):
            return self._whole.encode(chunk, add_special_tokens=False).ids
        piece = chunk if self._spaced else chunk.lower()
        if not (piece.isascii() and piece.isalpha()):
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self._model.tokenize(piece)]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a letter follows a mark, or a mark a letter; letters are those of Latin-1 in UTF-8."""
    letter, mark = _IS_LETTER[data], _IS_MARK[data]
    pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # but not the signs of times and division
    letter[:-1] |= pair
    letter[1:] |= pair
    cuts = np.zeros(len(data), dtype=bool)
    cuts[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return cuts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
