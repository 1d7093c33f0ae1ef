"""Token counts by a unigram segmentation, computed once per shared prefix.

A pre-token is a word with the word mark before it.  Its segmentation is the
one with the highest sum of piece scores; among equals, the one with the
fewest pieces.  The forward score of a prefix does not depend on what follows,
so the distinct pre-tokens of a slice are inserted in a trie whose nodes hold
the best (score, pieces) of their prefix.  A node is computed once for all
words that share it, and the node where a word ends holds its result.

Pieces come from a sentencepiece file; its scores are merge ranks, so a piece
of rank r scores -1000 ln(r + 2), rounded: the usual Zipf form of piece
probabilities, in whole numbers so that sums are exact.  A character without a
piece costs one byte piece per UTF-8 byte.

The trie and the table of words are kept between slices by each worker and
emptied at a set size.  Prefixes of more than ``NODE_DEPTH`` characters, which
words hardly share, get no node: of them only the last values are kept that a
piece can still reach, so a word of any length takes no memory of its own.  Rows
are independent and nothing is shuffled.

Defined results: a null or empty text has no pre-tokens; texts of any length
are counted whole; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.arrow import slices

WORD_MARK = "▁"
_UNIT = 1 << 40  # above any number of pieces
NODE_LIMIT = 600_000
NODE_DEPTH = 64
WORD_LIMIT = 400_000
LONGEST_KEPT = 256  # bytes of a word in the table
SLICE_BYTES = 4 << 20


def piece_scores(path: str) -> tuple[dict[str, int], int]:
    """Scores of the ordinary pieces, and the score of a byte piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            scores[model.id_to_piece(k)] = -round(1000 * math.log(len(scores) + 2))
    return scores, 2 * min(scores.values(), default=-1000)


class Trie:
    """Prefixes of pre-tokens with the best value of each.

    A value is score * _UNIT - pieces: the larger score wins, then the fewer
    pieces, and values of consecutive pieces add up.  Pieces that end at a
    place are found from there backwards, as long as what has been read is the
    end of some piece.
    """

    def __init__(self, scores: dict[str, int], byte_score: int, node_limit: int = NODE_LIMIT):
        self._byte, self._limit = byte_score * _UNIT - 1, node_limit
        self._endings: dict[str, int | None] = {p[k:]: None for p in scores for k in range(1, len(p))}
        self._endings.update((p, s * _UNIT - 1) for p, s in scores.items())
        self._reach = max(map(len, scores), default=1)  # characters of the longest piece
        self._clear()

    def _clear(self) -> None:
        self._children: dict[tuple[int, str], int] = {}
        self._best: list[int] = [0]
        self._last, self._path, self._values = "", [0], [0]  # nodes of the last token and their values

    def insert(self, token: str) -> int:
        """Value of a pre-token; adds the prefixes that are new.

        The path of the last token is kept, so in sorted order only what
        follows the common prefix is walked.
        """
        if len(token) > NODE_DEPTH:
            return self._beyond(token)
        if len(self._best) > self._limit:
            self._clear()
        same = 0
        for a, b in zip(token, self._last):
            if a != b:
                break
            same += 1
        children, best, path, values = self._children, self._best, self._path, self._values
        del path[same + 1:], values[same + 1:]
        node = path[-1]
        for end in range(same + 1, len(token) + 1):
            key = node, token[end - 1]
            following = children.get(key)
            if following is None:
                following = children[key] = len(best)
                best.append(self._forward(token, end, values))
            node = following
            path.append(node)
            values.append(best[node])
        self._last = token
        return best[node]

    def _beyond(self, token: str) -> int:
        """Value of a long pre-token, from the nodes of its beginning."""
        self.insert(token[:NODE_DEPTH])
        recent = self._values[:]
        for end in range(NODE_DEPTH + 1, len(token) + 1):
            recent.append(self._forward(token, end, recent))
            if len(recent) > 4 * self._reach:
                del recent[:-self._reach]
        return recent[-1]

    def _forward(self, token: str, end: int, recent: list[int]) -> int:
        """Best value of the first ``end`` characters from those of the prefixes just before."""
        endings, begin, back = self._endings, end - 1, -1
        value = endings.get(token[begin], None)
        if value is None:  # no piece of its own
            n = len(token[begin].encode("utf-8", "surrogatepass"))
            value = n * self._byte
        found = recent[back] + value
        while begin:
            begin, back = begin - 1, back - 1
            value = endings.get(token[begin:end], 0)
            if value == 0:
                break
            if value is not None:
                value += recent[back]
                if value > found:
                    found = value
        return found


class Counter:
    """Pre-tokens, pieces and score of texts."""

    def __init__(self, path: str, word_limit: int = WORD_LIMIT):
        self._trie, self._words, self._limit = Trie(*piece_scores(path)), {}, word_limit

    def count(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        cut = [t.encode().split() if t else [] for t in texts]  # bytes split at just these spaces
        distinct = {w for words in cut for w in words}
        new = distinct.difference(self._words)
        if len(self._words) + len(new) > self._limit:
            self._words, new = {}, distinct
        long = {}  # not kept for other texts
        for word in sorted(new):  # neighbours share their prefixes
            (self._words if len(word) <= LONGEST_KEPT else long)[word] = self._trie.insert(WORD_MARK + word.decode())
        kept = self._words
        found = []
        for words in cut:
            total = sum(long[w] if len(w) > LONGEST_KEPT else kept[w] for w in words)
            pieces = -total % _UNIT
            found.append((len(words), pieces, (total + pieces) // _UNIT))
        return found


_COUNTERS: dict[str, Counter] = {}


def _count_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                counts = _COUNTERS[path].count(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), *[pa.array(c, type=pa.int64()) for c in zip(*counts)]],
                    names=["doc_id", "n_pretokens", "n_tokens", "score"])
    return run


def count_tokens(docs: DataFrame, pieces: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) per document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _count_rows(pieces), "doc_id long, n_pretokens long, n_tokens long, score long")
