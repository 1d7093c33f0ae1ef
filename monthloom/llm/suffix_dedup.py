"""Removal of repeated passages by a sorted sample of suffixes, exact to the byte.

A byte goes if it lies in a string of 50 bytes that also starts in a document
with a smaller id.  Sorting every suffix would ship 50 bytes for each byte of
text, so one suffix is chosen of each string, by the least hash of its 16-byte
grams.  Equal strings choose at the same place, so it is enough to compare
chosen suffixes, together with the bytes around them that their strings take.

1. Texts are packed to compressed blobs and dealt in turn to parts of equal
   size, whatever their ids, sources or repetitions.
2. Each part sends the distinct hashes of its chosen grams, sorted, five bytes
   at most.  A bit comes back for each: does another part have it too?
3. Only suffixes with company go on, one of each run of equal bytes in a part,
   for the smallest id that has it; larger ids are covered by it at once.  In a
   part, hashes bring equal rows together and their bytes are compared.
   Sampled splitters part them into buckets by their leading bytes.  A leading
   gram that fills several buckets has its strings dealt singly among them.
4. Buckets sort by multikey quicksort and compare neighbours.  All strings of a
   leading gram are in one bucket, or each string is, so nothing is left to
   compare across boundaries.
5. The covered ranges go back to the parts, which unite and remove them.

The packed texts are shuffled once and read three times.  All jobs follow from
one plan, so a lost executor's share is computed again.

Defined results: a null text is the empty text; a null id is larger than all
others; documents with equal ids don't cover each other; a text may be of any
length; texts under 50 bytes stay as they are; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import suffix_sort as ss
from monthloom.llm.arrow import slices

_AT_ONCE = 50_000       # rows compared at a time
PART_BYTES = 16 << 20       # of text in one part
BLOB_BYTES = 2 << 20
SAMPLE_DOCUMENTS = 2000     # whose suffixes place the splitters; they affect balance only
_NO_ID = np.iinfo(np.int64).max
_MARK_BITS = 40             # of a gram's hash
_PACKED = "part long, task long, number long, blob binary"
_BLOB = pa.schema([("part", pa.int64()), ("task", pa.int64()), ("number", pa.int64()), ("blob", pa.binary())])


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, equal bytes of neighbouring numbers together."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.ndim == 1 else a.tobytes())
    sizes = np.array([len(p) for p in planes], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def _unpress(blob: bytes, kinds: list) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, dtype="<i8", count=len(kinds))
    at, found = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        raw = np.frombuffer(data, dtype=np.uint8, count=size, offset=at)
        at += size
        if isinstance(kind, int):  # rows of so many bytes
            found.append(raw.reshape(-1, kind))
        else:
            width = np.dtype(kind).itemsize
            found.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel())
    return found


def _batch(rows: list[tuple], schema: pa.Schema = _BLOB) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows
        else [pa.array([], type=f.type) for f in schema], schema=schema)


def _pack(parts: int):
    """Texts to blobs (ids, lengths, bytes), dealt to the parts in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", BLOB_BYTES):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
                ids = np.array([_NO_ID if i is None else i for i in some.column("doc_id").to_pylist()], dtype=np.int64)
                known = np.array([i is not None for i in some.column("doc_id").to_pylist()], dtype=np.uint8)
                blob = _press(ids, known, np.array([len(t) for t in texts], dtype=np.int64),
                              np.frombuffer(b"".join(texts), dtype=np.uint8))
                yield _batch([((task + number * 9973) % parts, task, number, blob)])
                number += 1
    return run


class _Texts:
    """The texts of one blob; ``first`` numbers its documents within the part."""

    def __init__(self, blob: bytes, first: int):
        self.ids, self.known, self.sizes, data = _unpress(blob, [np.int64, np.uint8, np.int64, np.uint8])
        self.data = np.concatenate([data, np.zeros(ss.WIDEST + 8, dtype=np.uint8)])
        self.ends = np.cumsum(self.sizes)
        self.starts, self.first = self.ends - self.sizes, first


def _texts(blobs: pa.Table) -> Iterator[_Texts]:
    """Blobs of a part in their order, whatever order they arrived in."""
    first = 0
    for row in blobs.sort_by([("task", "ascending"), ("number", "ascending")]).column("blob"):
        texts = _Texts(row.as_py(), first)
        first += len(texts.ids)
        yield texts


def _marks(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _MARK_BITS)


def _bucket_bounds(marks: np.ndarray, parts: int) -> np.ndarray:
    edges = (np.arange(1, parts, dtype=np.uint64) << np.uint64(_MARK_BITS)) // np.uint64(parts)
    return np.concatenate([[0], np.searchsorted(marks, edges), [len(marks)]])


def _send_marks(parts: int):
    """The distinct marks of a part, cut into ranges; ``part`` of a row is the range."""
    def run(key: tuple, blobs: pa.Table) -> pa.Table:
        found = [np.unique(_marks(ss.chosen_suffixes(t.data, t.starts, t.ends)[3])) for t in _texts(blobs)]
        marks = np.unique(np.concatenate(found))
        bounds = _bucket_bounds(marks, parts)
        rows = [(b, key[0].as_py(), 0, _press(np.diff(marks[x:y], prepend=np.uint64(0))))
                for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
        return pa.Table.from_batches([_batch(rows)])
    return run


def _shared_marks(key: tuple, blobs: pa.Table) -> pa.Table:
    """For each part and mark of a range: whether another part has the mark; ``part`` is the part again."""
    sent = {t: np.cumsum(_unpress(b, [np.uint64])[0], dtype=np.uint64) for t, b in zip(
        blobs.column("task").to_pylist(), blobs.column("blob").to_pylist())}
    every = np.sort(np.concatenate(list(sent.values())))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(part, key[0].as_py(), 0, _press(np.packbits(np.isin(marks, twice, assume_unique=True)),
                                             np.array([len(marks)], dtype=np.int64))) for part, marks in sent.items()]
    return pa.Table.from_batches([_batch(rows)])


_RECORD = [np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint8, ss.WIDEST]
_KINDS = ["owner", "document", "home", "shift", "gram", "strings", "rows"]


def _all_suffixes(blobs: pa.Table) -> tuple[dict[str, np.ndarray], list[_Texts]]:
    columns: dict[str, list] = {c: [] for c in ("owner", "document", "home", "gram", "strings", "mark", "blob", "low")}
    texts = list(_texts(blobs))
    for k, t in enumerate(texts):
        low, high, gram, hashes = ss.chosen_suffixes(t.data, t.starts, t.ends)
        local = np.searchsorted(t.starts, low, side="right") - 1  # an empty text starts where the next one does
        for name, value in zip(columns, (t.ids[local], local + t.first, low - t.starts[local], gram - low,
                                         high - low + 1, _marks(hashes), np.full(len(low), k), low)):
            columns[name].append(value)
    return {c: np.concatenate(v) for c, v in columns.items()}, texts


def _gather(texts: list[_Texts], blob: np.ndarray, low: np.ndarray, strings: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(blob), ss.WIDEST), dtype=np.uint8)
    for k, t in enumerate(texts):
        own = np.flatnonzero(blob == k)
        rows[own] = ss.contexts(t.data, low[own], low[own] + strings[own] - 1)
    return rows


def _row_hash(*columns: np.ndarray) -> np.ndarray:
    total = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        total = ss.mixed(total * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return total


def _kinds(s: dict[str, np.ndarray], rows: np.ndarray, kind_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where another mark begins, and where other strings do; rows of equal hashes are compared byte by byte."""
    new_mark = np.ones(len(rows), dtype=bool)
    new_mark[1:] = s["mark"][1:] != s["mark"][:-1]
    new_kind = new_mark.copy()
    new_kind[1:] |= kind_hash[1:] != kind_hash[:-1]
    equal = np.flatnonzero(~new_kind)
    for at in range(0, len(equal), _AT_ONCE):
        k = equal[at:at + _AT_ONCE]
        new_kind[k] = (rows[k] != rows[k - 1]).any(axis=1)
        for c in ("gram", "strings"):
            new_kind[k] |= s[c][k] != s[c][k - 1]
    return new_mark, new_kind


def _send_suffixes(splitters: np.ndarray):
    """Suffixes with company to their buckets; what the part can tell by itself goes along as bucket -1 - part.

    Rows are (bucket, part, kind, blob): kind 0 records, 1 covered ranges,
    2 followers, i.e. further places of a record in documents of its id.
    """
    def run(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if not blobs.num_rows:
            return pa.Table.from_batches([_batch([])])
        s, texts = _all_suffixes(blobs)
        marks = np.unique(s["mark"])
        shared = np.zeros(len(marks), dtype=bool)
        if answers.num_rows:
            bits = []
            for blob in answers.sort_by("task").column("blob"):
                packed, size = _unpress(blob.as_py(), [np.uint8, np.int64])
                bits.append(np.unpackbits(packed, count=int(size[0])))
            shared = np.concatenate(bits).astype(bool)
        mark_no = np.searchsorted(marks, s["mark"])
        keep = shared[mark_no] | (np.bincount(mark_no, minlength=len(marks)) > 1)[mark_no]
        s = {c: v[keep] for c, v in s.items()}
        shared = shared[mark_no[keep]]
        rows = _gather(texts, s["blob"], s["low"], s["strings"])
        # equal rows of the part: the smallest id stands for them
        kind_hash = _row_hash(*ss.as_words(rows), s["gram"] * 64 + s["strings"])
        order = np.lexsort((s["home"], s["document"], s["owner"], kind_hash, s["mark"]))
        s, rows, shared, kind_hash = {c: v[order] for c, v in s.items()}, rows[order], shared[order], kind_hash[order]
        new_mark, new_kind = _kinds(s, rows, kind_hash)
        heads, kind = ss.starts_of(new_kind)
        lead = heads[kind] if len(heads) else kind
        behind = s["owner"] > s["owner"][lead]
        follows = ~behind & ~new_kind
        _, mark_run = ss.starts_of(new_mark)
        several = np.bincount(mark_run[heads], minlength=1)[mark_run] > 1 if len(heads) else new_kind
        send = new_kind & (shared | several)
        out = [(-1 - part, part, 1, _press(s["document"][behind], s["home"][behind],
                                           s["home"][behind] + s["strings"][behind] - 1 + ss.SPAN))]
        f = follows & (shared | several)
        out.append((-1 - part, part, 2, _press(s["document"][lead[f]], s["home"][lead[f]], s["document"][f], s["home"][f])))
        out += _routed({c: v[send] for c, v in s.items()}, rows[send], splitters, part)
        return pa.Table.from_batches([_batch(out)])
    return run


def _routed(s: dict[str, np.ndarray], rows: np.ndarray, splitters: np.ndarray, part: int) -> list[tuple]:
    """Records by bucket; those of a gram that fills several buckets as single strings."""
    if not len(rows):
        return []
    s = {**s, "shift": np.zeros(len(rows), dtype=np.int64)}
    lead = _lead(rows, s["gram"])
    low, high = (np.searchsorted(splitters, lead, side=x) for x in ("left", "right"))
    bucket, wide = high.copy(), np.flatnonzero(high - low > 1)
    if len(wide):
        sizes = s["strings"][wide]
        which = np.repeat(wide, sizes)
        shift = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        texts = np.take_along_axis(rows[which], shift[:, None] + np.arange(ss.SPAN), axis=1)
        single = np.zeros((len(which), ss.WIDEST), dtype=np.uint8)
        single[:, :ss.SPAN] = texts
        spread = _row_hash(*ss.as_words(texts)) % (high - low)[which].astype(np.uint64)
        rest = np.ones(len(rows), dtype=bool)
        rest[wide] = False
        more = {c: v[which] for c, v in s.items()}
        more.update(shift=shift, gram=more["gram"] - shift, strings=np.ones(len(which), dtype=np.int64))
        s = {c: np.concatenate([v[rest], more[c]]) for c, v in s.items()}
        rows = np.concatenate([rows[rest], single])
        bucket = np.concatenate([bucket[rest], low[which] + 1 + spread.astype(np.int64)])
        lead = _lead(rows, s["gram"])
    order = np.lexsort((lead, bucket))
    bounds = np.searchsorted(bucket[order], np.arange(len(splitters) + 2))
    out = []
    for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
        if y > x:
            some = order[x:y]
            out.append((b, part, 0, _press(*[s[c][some].astype(k) for c, k in zip(_KINDS[:-1], _RECORD)], rows[some])))
    return out


def _lead(rows: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The leading gram of each record as one sortable value."""
    return np.ascontiguousarray(np.take_along_axis(rows, gram[:, None].astype(np.int64) + np.arange(ss.GRAM), axis=1)).view(
        f"S{ss.GRAM}").ravel()


def _compare(key: tuple, blobs: pa.Table) -> pa.Table:
    """Covered ranges of a bucket's records, by part; what is no record passes."""
    out, read = [], {c: [] for c in (*_KINDS, "part")}
    for part, kind, blob in zip(*(blobs.column(c).to_pylist() for c in ("task", "number", "blob"))):
        if kind:
            out.append((part, kind, 0, blob))
            continue
        for c, v in zip(_KINDS, _unpress(blob, _RECORD)):
            read[c].append(v)
        read["part"].append(np.full(len(read["owner"][-1]), part))
    if read["part"]:
        s = {c: np.concatenate(v) for c, v in read.items()}
        for c in ("shift", "gram", "strings"):
            s[c] = s[c].astype(np.int64)
        row, first, strings = ss.covered(s["gram"], s["strings"], s["rows"], s["owner"])
        begin = s["home"][row] + s["shift"][row] + first
        columns = [s["document"][row], s["home"][row], begin, begin + strings - 1 + ss.SPAN]
        order = np.lexsort((begin, columns[1], columns[0], s["part"][row]))
        parts = s["part"][row][order]
        for part in np.unique(parts).tolist():
            x, y = np.searchsorted(parts, [part, part + 1])
            out.append((part, 3, key[0].as_py(), _press(*[c[order[x:y]] for c in columns])))
    return pa.Table.from_batches([_batch(out)])


def _with_followers(found: dict[int, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of a part; a covered range holds at the further places of its record too."""
    plain = [np.concatenate(c) for c in zip(*found[1])] if found[1] else [np.zeros(0, dtype=np.int64)] * 3
    if not found[3]:
        return tuple(plain)
    document, home, begin, end = (np.concatenate(c) for c in zip(*found[3]))
    out = [plain, [document, begin, end]]
    lead_document, lead_home, other, other_home = (
        np.concatenate(c) for c in zip(*(found[2] or [[np.zeros(0, dtype=np.int64)] * 4])))
    if len(lead_home) and len(home):
        order = np.lexsort((lead_home, lead_document))
        width = int(max(lead_home.max(), home.max())) + 1
        names = (lead_document * width + lead_home)[order]
        asked = document * width + home
        x, y = (np.searchsorted(names, asked, side=side) for side in ("left", "right"))
        counts = y - x
        at = order[np.repeat(x - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        move = other_home[at] - np.repeat(home, counts)
        out.append([other[at], np.repeat(begin, counts) + move, np.repeat(end, counts) + move])
    return tuple(np.concatenate(c) for c in zip(*out))


def _remove(key: tuple, blobs: pa.Table, ranges: pa.Table) -> pa.Table:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept) of a part."""
    found: dict[int, list] = {1: [], 2: [], 3: []}
    for kind, blob in zip(ranges.column("task").to_pylist(), ranges.column("blob").to_pylist()):
        found[kind].append(_unpress(blob, [np.int64] * {1: 3, 2: 4, 3: 4}[kind]))
    document, begin, end = _with_followers(found)
    order = np.argsort(document, kind="stable")
    document, begin, end = document[order], begin[order], end[order]
    rows: list[tuple] = []
    for t in _texts(blobs):
        x, y = np.searchsorted(document, [t.first, t.first + len(t.ids)])
        place = t.starts[document[x:y] - t.first]
        depth = np.zeros(len(t.data) + 1, dtype=np.int32)
        np.add.at(depth, place + begin[x:y], 1)
        np.add.at(depth, place + end[x:y], -1)
        gone = np.cumsum(depth[:-1]) > 0
        for i, known, a, b in zip(t.ids.tolist(), t.known.tolist(), t.starts.tolist(), t.ends.tolist()):
            own = gone[a:b]
            removed = int(own.sum())
            spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if removed else 0
            kept = t.data[a:b][~own] if removed else t.data[a:b]
            rows.append((i if known else None, b - a, removed, spans, kept.tobytes()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.Table.from_batches([_batch(rows, schema)])


def _sample_splitters(docs: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Leading grams that part a sample of chosen suffixes evenly; a hot one occurs several times."""
    if buckets < 2:
        return np.zeros(0, dtype=f"S{ss.GRAM}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", BLOB_BYTES):
                coded = [(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
                sizes = np.array([len(c) for c in coded], dtype=np.int64)
                data = np.frombuffer(b"".join(coded) + bytes(ss.WIDEST + 8), dtype=np.uint8)
                ends = np.cumsum(sizes)
                gram = ss.chosen_suffixes(data, ends - sizes, ends)[2]
                gram = gram[::max(1, len(gram) // (50 * len(coded)))]  # some of each text, short or long
                yield pa.RecordBatch.from_arrays([pa.array(
                    list(map(bytes, ss.rows_at(data, gram, ss.GRAM))), type=pa.binary())], names=["lead"])

    sampled = docs.select("text").sample(min(1.0, SAMPLE_DOCUMENTS / max(n, 1)), seed=1)
    leads = np.sort(np.array([bytes(r[0]) for r in sampled.mapInArrow(run, "lead binary").collect()], dtype=f"S{ss.GRAM}"))
    return leads[np.arange(1, buckets) * len(leads) // buckets] if len(leads) else leads


def without_repeats(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes of every document."""
    own = docs.select(F.col("doc_id").cast("long"), "text")
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(own.sparkSession.sparkContext.defaultParallelism, -(-int(size) // part_bytes))
    packed = own.mapInArrow(_pack(parts), _PACKED).repartition(parts, "part")
    splitters = _sample_splitters(own, n, parts)
    marks = packed.groupBy("part").applyInArrow(_send_marks(parts), _PACKED)
    answers = marks.repartition(parts, "part").groupBy("part").applyInArrow(_shared_marks, _PACKED)
    sent = packed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_send_suffixes(splitters), _PACKED)
    ranges = sent.repartition(parts, "part").groupBy("part").applyInArrow(_compare, _PACKED)
    return packed.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
