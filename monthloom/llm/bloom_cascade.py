"""Exact membership by a cascade of Bloom filters over a known universe of keys.

Level 0 encodes the listed keys.  The keys of the universe that are not listed
and pass it all the same are encoded in level 1, the listed keys that pass
level 1 in level 2, and so on until no key passes by mistake.  A key of the
universe is listed if the first level that does not hold it has an odd number.

The universe is dealt by the keys' digests to shards of about ``SHARD_KEYS``
distinct keys, each with a cascade of its own, so building takes one shuffle of
16 bytes a key and no task sees more than a shard; a key that many rows share is
one key.  Looking up needs no join and no shuffle: the filters are broadcast
while they take at most ``BROADCAST_BYTES``, and in as many passes over the
rows as keep each broadcast below that otherwise.

Defined results: a null key is in no list; listed keys outside the universe are
ignored; an empty universe or list holds nothing; repeated keys count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.arrow import whole_groups
from monthloom.llm.shingles import mixed
from monthloom.session import written

SHARD_KEYS = 1 << 13
BROADCAST_BYTES = 128 << 20
MOST_LEVELS = 200  # half of the keys of a level pass the next one, so only equal digests get this far
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


def digests(keys: list[str]) -> np.ndarray:
    """Two 64-bit numbers for each key, from a cryptographic hash."""
    parts = b"".join(blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in keys)
    return np.frombuffer(parts, dtype="<u8").reshape(-1, 2)


def _places(keys: np.ndarray, level: int, hashes: int, bits) -> np.ndarray:
    """(keys, hashes): the bits of each key in a filter of so many bits (a number, or one for each key)."""
    with np.errstate(over="ignore"):
        salt = np.uint64(level + 1) * _LEVEL
        first, step = mixed(keys[:, 0] ^ salt), mixed(keys[:, 1] + salt) | np.uint64(1)
        spread = mixed(first[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None])
    return spread % (np.uint64(bits) if np.isscalar(bits) else bits.astype(np.uint64)[:, None])


def _made(keys: np.ndarray, level: int, rate: float) -> tuple[np.ndarray, int]:
    """The words of a filter and its number of hashes."""
    hashes = max(1, round(-math.log2(rate)))
    words = np.zeros(max(1, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2 / 64)), dtype=np.uint64)
    at = _places(keys, level, hashes, 64 * len(words)).ravel()
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words, hashes


def _holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def cascade(listed: np.ndarray, others: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The levels for two disjoint sets of digests."""
    levels, inside, outside = [], listed, others
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed key and another one have equal digests")
        rate = min(0.5, len(inside) / (math.sqrt(2) * max(len(outside), 1))) if not levels else 0.5
        words, hashes = _made(inside, len(levels), rate)
        passed = _holds(words, _places(outside, len(levels), hashes, 64 * len(words)))
        inside, outside = outside[passed], inside
        levels.append((words, hashes))
    return levels


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches, ["shard"]):
        keys = np.frombuffer(b"".join(group.column("digest").to_pylist()), dtype="<u8").reshape(-1, 2)
        listed = group.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        levels = cascade(keys[listed], keys[~listed])
        if levels:
            n = len(levels)
            yield pa.RecordBatch.from_arrays([
                pa.array([group.column("shard")[0].as_py()] * n, type=pa.int64()), pa.array(range(n), type=pa.int32()),
                pa.array([h for _, h in levels], type=pa.int32()), pa.array([w.tobytes() for w, _ in levels], type=pa.binary()),
            ], names=["shard", "level", "hashes", "words"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = digests(batch.column("key").to_pylist())
        yield pa.RecordBatch.from_arrays([
            pa.array([d.tobytes() for d in found], type=pa.binary()), pa.array(_number(found), type=pa.int64()),
            batch.column("listed")], names=["digest", "number", "listed"])


def _number(keys: np.ndarray) -> np.ndarray:
    """What the shard is taken from."""
    return (keys[:, 0] >> np.uint64(1)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """The cascades of some shards, laid out in one array of words."""

    shards: int           # in all
    start: np.ndarray     # (shard, level): first word of the filter
    size: np.ndarray      # (shard, level): its words, 0 if there is no such level
    hashes: np.ndarray    # (shard, level)
    words: np.ndarray
    first: int            # the shards of this part
    end: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed; false for keys of shards outside this part."""
        found = np.zeros(len(keys), dtype=bool)
        shard = _number(keys) % self.shards
        live = np.flatnonzero((shard >= self.first) & (shard < self.end))
        for level in range(self.start.shape[1]):
            size = self.size[shard[live] - self.first, level]
            passed = np.zeros(len(live), dtype=bool)
            hashes = self.hashes[shard[live] - self.first, level]
            for n in np.unique(hashes[size > 0]).tolist():
                some = np.flatnonzero((hashes == n) & (size > 0))
                at = _places(keys[live[some]], level, n, 64 * size[some])
                start = self.start[shard[live[some]] - self.first, level].astype(np.uint64)
                passed[some] = _holds(self.words, at + (start[:, None] << np.uint64(6)))
            found[live[~passed]] = level % 2 == 1
            live = live[passed]
        found[live] = self.start.shape[1] % 2 == 1
        return found


def _laid_out(rows: list, shards: int, first: int, end: int) -> Filters:
    deepest = max((r["level"] for r in rows), default=-1) + 1
    start, size, hashes = (np.zeros((end - first, deepest), dtype=np.int64) for _ in range(3))
    at, parts = 0, []
    for r in rows:
        words = np.frombuffer(r["words"], dtype=np.uint64)
        place = (r["shard"] - first, r["level"])
        start[place], size[place], hashes[place] = at, len(words), r["hashes"]
        at += len(words)
        parts.append(words)
    return Filters(shards, start, size, hashes, np.concatenate(parts) if parts else np.zeros(1, dtype=np.uint64), first, end)


class Cascade:
    """A written table of filters, and look-ups in it."""

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    def parts(self, most: int = BROADCAST_BYTES) -> list[tuple[int, int]]:
        """Ranges of shards whose filters take at most so many bytes; a shard is far smaller."""
        group = F.floor(F.col("shard") * F.lit(max(1, -(-2 * self.bytes() // most))) / F.lit(self.shards))
        ends = [r["end"] for r in self.table.groupBy(group.alias("group")).agg((F.max("shard") + 1).alias("end")).orderBy("end").collect()]
        return list(zip([0, *ends[:-1]], ends))

    def bytes(self) -> int:
        return self.table.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]

    def mark(self, rows: DataFrame, keys: str, name: str, most: int = BROADCAST_BYTES) -> DataFrame:
        """The rows with ``name``, an array that tells for each string of the array ``keys`` whether it is listed."""
        context = rows.sparkSession.sparkContext
        held = rows.withColumn(name, F.transform(keys, lambda k: F.lit(False)))
        parts = self.parts(most)
        for k, (first, end) in enumerate(parts):
            found = self.table.filter(F.col("shard").between(first, end - 1)).collect()
            shared = context.broadcast(_laid_out(found, self.shards, first, end))
            held = held.mapInArrow(_marking(shared, keys, name), held.schema)
            if k + 1 < len(parts):
                held = written(held, "marked")
        return held


def _marking(shared, keys: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, before = batch.column(keys), batch.column(name)
            flat = lists.flatten()
            codes = flat.dictionary_encode()
            known = codes.dictionary.to_pylist()
            hit = np.append(shared.value.holds(digests(known)), False) if known else np.zeros(1, dtype=bool)
            at = codes.indices.fill_null(len(known)).to_numpy()
            now = pa.array(hit[at] | before.flatten().to_numpy(zero_copy_only=False).astype(bool))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, now, mask=lists.is_null() if lists.null_count else None)
            place = batch.schema.get_field_index(name)
            yield pa.RecordBatch.from_arrays(
                [column if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return run


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade for the listed keys; both tables have one column of strings, the keys."""
    keys = universe.toDF("key").select("key", F.lit(False).alias("listed"), F.lit(True).alias("known")).union(
        listed.toDF("key").select("key", F.lit(True), F.lit(False))).filter("key IS NOT NULL")
    keys = keys.groupBy("key").agg(F.max("listed").alias("listed"), F.max("known").alias("known")).filter("known")
    coded = written(keys.select("key", "listed").mapInArrow(_digested, "digest binary, number long, listed boolean"), "keys")
    shards = max(1, -(-coded.count() // SHARD_KEYS))
    dealt = coded.select("digest", "listed", (F.col("number") % F.lit(shards)).alias("shard"))
    built = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _build, "shard long, level int, hashes int, words binary")
    return Cascade(written(built, "cascade"), shards)
