"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are encoded and cut; the pieces (numbers only, no ids) are written
once and dealt at random to groups of bounded size, so a hot document or source
changes nothing.  In a group, best fit decreasing gives a first packing.  The
local search then takes the emptiest bins in turn and moves one of their
pieces, or exchanges one or two of them for a smaller one of a fuller bin.
Every step raises the sum of squared fills, so bins run empty and the search
ends by itself.  The pieces of underfull sequences are dealt to groups again and
packed anew, until a single group is left, no packing of them can take less, or
nothing is gained.

Defined results: a null text is the empty text, a single end id; repeated rows
are packed as often as they occur; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.arrow import slices
from monthloom.llm.tokens import encoder
from monthloom.session import written

CAPACITY = 2048
GROUP_PIECES = 8192
SLICE_BYTES = 2 << 20
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
_PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "slot")


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        slot = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                flat, sizes = own.encode(some.column("text").to_pylist())
                flat, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
                rows, begin = [], 0
                for doc, stop in zip(some.column("doc_id").to_pylist(), ends):
                    ids, begin = flat[begin:stop] + end, stop
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), slot))
                        slot += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(column, type=kind) for column, kind in zip(
                        zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "slot"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``slot`` numbers them."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer, end_id, capacity), _PIECE)


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set if a bin has a gap of g
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = gaps >> size
        if fitting:
            gap = size + ((fitting & -fitting).bit_length() - 1)
            bin_no = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[bin_no].append(item)
            gap -= size
        else:
            bin_no, gap = len(bins), capacity - size
            bins.append([item])
        if gap:
            by_gap[gap].append(bin_no)
            gaps |= 1 << gap
    return bins


class _Search:
    """Local search over the underfull bins of a packing."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, [set(b) for b in bins], capacity
        self.where = np.zeros(len(sizes), dtype=np.int64)
        self.fill = np.zeros(len(bins), dtype=np.int64)
        for k, b in enumerate(bins):
            self.where[b] = k
            self.fill[k] = sizes[b].sum()

    def run(self) -> list[list[int]]:
        least = -(-int(self.fill.sum()) // self.capacity)
        open_bins = np.flatnonzero(self.fill < self.capacity)
        # items of full bins can't take part in any exchange that raises a fill
        self.items = np.flatnonzero(np.isin(self.where, open_bins))
        used, progress = len(self.bins), True
        while progress and used > least:
            progress = False
            for source in sorted(open_bins.tolist(), key=lambda k: self.fill[k]):
                while self.fill[source] and self._improve(source):
                    progress = True
                if not self.fill[source]:
                    used -= 1
                    open_bins = open_bins[open_bins != source]
                    if used <= least:
                        break
        return [sorted(b) for b in self.bins if b]

    def _improve(self, source: int) -> bool:
        """One step out of ``source`` that raises the sum of squared fills."""
        own = sorted(self.bins[source], key=lambda i: -self.sizes[i])
        fill = int(self.fill[source])
        targets = np.flatnonzero((self.fill >= fill) & (self.fill < self.capacity))
        targets = targets[targets != source]
        if not len(targets):
            return False
        gaps = self.capacity - self.fill[targets]
        for item in own:  # move one
            fits = np.flatnonzero(gaps >= self.sizes[item])
            if len(fits):
                self._shift([item], [], source, int(targets[fits[np.argmin(gaps[fits])]]))
                return True
        others = self.items[(self.where[self.items] != source)]
        theirs, their_fill = self.sizes[others], self.fill[self.where[others]]
        others, theirs = others[their_fill >= fill], theirs[their_fill >= fill]
        gaps = self.capacity - self.fill[self.where[others]]
        for given in self._givable(own, theirs, gaps):  # exchange one or two for one
            gain = int(self.sizes[given].sum()) - theirs
            gain[(gain <= 0) | (gain > gaps)] = 0
            taken = int(others[np.argmax(gain)])
            self._shift(given, [taken], source, int(self.where[taken]))
            return True
        return False

    def _givable(self, own: list[int], theirs: np.ndarray, gaps: np.ndarray) -> Iterator[list[int]]:
        """Single items, then pairs, that can go for one of ``theirs``, the largest first.

        A table over all sizes tells which sums some exchange takes.  Items of
        equal size are alike, and a bin holds few different sizes, so pairs of
        sizes stand for the pairs of items.
        """
        edges = np.bincount(theirs + 1, minlength=self.capacity + 2)[:self.capacity + 2]
        edges = edges - np.bincount(theirs + gaps + 1, minlength=self.capacity + 2)[:self.capacity + 2]
        taken = np.cumsum(edges) > 0
        alike: dict[int, list[int]] = {}
        for item in own:
            alike.setdefault(int(self.sizes[item]), []).append(item)
        sizes = np.array(list(alike), dtype=np.int64)
        for size in sizes[taken[sizes]].tolist():
            yield [alike[size][0]]
        for k, size in enumerate(sizes.tolist()):
            rest = sizes[k + (len(alike[size]) < 2):]
            for other in rest[taken[size + rest]].tolist():
                yield [alike[size][0], alike[other][-1 if other == size else 0]]

    def _shift(self, given: list[int], taken: list[int], source: int, target: int) -> None:
        for items, a, b in ((given, source, target), (taken, target, source)):
            for item in items:
                self.bins[a].remove(item)
                self.bins[b].add(item)
                self.where[item] = b
                self.fill[a] -= self.sizes[item]
                self.fill[b] += self.sizes[item]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for sizes between 1 and ``capacity``."""
    return _Search(sizes, _best_fit(sizes, capacity), capacity).run()


def _pack_group(capacity: int, level: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        sizes = group.column("length").to_numpy()
        sequence, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
        for k, items in enumerate(pack(sizes, capacity)):
            sequence[items] = (level << 56) + (key[0].as_py() << 32) + k
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
            fill[items] = sizes[items].sum()
        made = {"sequence_id": sequence, "offset": offset, "fill": fill}
        return pa.table({**{c: group.column(c) for c in _PIECE_COLUMNS}, **{c: pa.array(v) for c, v in made.items()}})
    return run


def _in_groups(pieces: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """The pieces dealt at random to groups, each packed by itself."""
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("slot", F.lit(level)), F.lit(groups)))
    # a group costs time, not bytes, so groups are not to be merged into few tasks
    return dealt.repartition(groups, "_group").groupBy("_group").applyInArrow(_pack_group(capacity, level), f"{_PIECE}, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``group_pieces`` bounds what one task packs; the number of groups follows
    the number of pieces.
    """
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    packed, settled, level = _in_groups(pieces, groups, 0, capacity), [], 0
    while groups > 1:
        packed, level = written(packed, "packed"), level + 1
        short = packed.filter(F.col("fill") < capacity)
        n, used, tokens, large = short.agg(
            F.count(F.lit(1)), F.count_if(F.col("offset") == 0), F.sum("length"),
            F.count_if(2 * F.col("length") > capacity)).first()
        if not n or used <= max(-(-tokens // capacity), large):  # no packing of these pieces takes less
            break
        groups = max(1, round(n / group_pieces))
        again = written(_in_groups(short.select(*_PIECE_COLUMNS), groups, level, capacity), "packed")
        if again.filter("offset = 0").count() >= used:
            break
        settled.append(packed.filter(F.col("fill") == capacity))
        packed = again
    for part in settled:
        packed = packed.union(part)
    return packed.drop("slot", "fill")
