"""Near-duplicates by MinHash: banding, verification on full sets, connected components.

1. Every text becomes the set of its word shingles and 128 minima of universal
   hash functions, cut into 32 bands of 4.  Texts with equal sets form a class
   with one representative, so exact copies cost nothing from here on.  A pair
   with similarity 0.8 misses all bands with probability 4.7e-8 and fails the
   bit test below with 8.5e-8; lower similarities are refused, since both rates
   grow fast.
2. Representatives that share a band are compared with the smallest of its
   bucket (a star, not all pairs), first by one bit of each minimum, then on
   their full sets.  The links are joined to components.
3. Buckets that still hold several components may hide links between members.
   The signatures of their members are compared inside bounded tasks, members
   outside the bucket's main component against all.  What comes out is no pair,
   but which representative has to meet which part of the main component, and
   which have to meet in its pool.
4. These meet on full sets, every shingle in two independent 64-bit hashes, again inside bounded tasks; only links come out.
   Both sides are cut into parts, so no bucket, component or pool, however
   large, lands in one task, and none is capped.

Defined results: a null, empty or blank text has the empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle; documents
with equal ids are separate rows of one id; the component of rows without any
id is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.arrow import slices, whole_groups
from monthloom.llm.components import components
from monthloom.llm.shingles import shingle_sets
from monthloom.session import written

SIMILARITY = 80         # per cent
HASHES, BANDS = 128, 32
BITS_APART = 33         # of 128; six deviations from what a pair at 0.8 differs by
PART = 2048             # members of a bucket or component in one task
QUERY_PART = 1024
BROADCAST_IDS = 1_000_000
SLICE_BYTES = 1 << 20
_PROOF = 1              # seed of a second, independent hash of every shingle

_RANDOM = np.random.default_rng(8)
_FACTOR = _RANDOM.integers(1, 1 << 63, size=(HASHES, 1), dtype=np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, size=(HASHES, 1), dtype=np.uint64)
_SIGNATURE = pa.schema([("slot", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                        ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits0", pa.int64()),
                        ("bits1", pa.int64())])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash function (upper half of a x + b) over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (_FACTOR * shingles[at:at + 4096] + _SHIFT).min(axis=1), out=least)
    return least >> np.uint64(32)


def _set_hash(shingles: np.ndarray, proof: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes() + proof.tobytes(), digest_size=16).digest()


def _both_sets(texts: list[str | None], words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The set of every text under both hashes, 128 bits in all."""
    return list(zip(shingle_sets(texts, words), shingle_sets(texts, words, _PROOF)))


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band, the band's number mixed in."""
    rows = signatures.reshape(len(signatures), BANDS, HASHES // BANDS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = (key ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                sets = _both_sets(some.column("text").to_pylist(), words)
                signatures = np.stack([minima(s) for s, _ in sets])
                bits = np.packbits((signatures & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                keys = _band_keys(signatures)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(slot, slot + n)), some.column("row"), some.column("doc_id"),
                    pa.array([len(s) for s, _ in sets], type=pa.int64()), pa.array([_set_hash(*s) for s in sets]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                    pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                ], schema=_SIGNATURE)
                slot += n
    return run


def _codes(words: int):
    """(set_hash, codes, proof): full sets, sorted, under both hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                sets = _both_sets(some.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_set_hash(*s) for s in sets]),
                    *[pa.array([s[k].tobytes() for s in sets], type=pa.binary()) for k in (0, 1)],
                ], names=["set_hash", "codes", "proof"])
    return run


def _set_of(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, dtype=np.uint64)


def _proven(a: bytes, b: bytes, similarity: int) -> bool:
    """Whether two sets are linked, from their bytes under one hash."""
    x, y = _set_of(a), _set_of(b)
    return bool(_may_link(len(x), len(y), similarity) and _linked(
        len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))


def _linked(common, a, b, similarity: int):
    return 100 * common >= similarity * (a + b - common)


def _confirm(similarity: int):
    """Pairs with both sets to the pairs that are links under both hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, *sets = (batch.column(c).to_pylist() for c in ("u", "v", "codes_u", "codes_v", "proof_u", "proof_v"))
            keep = [k for k, (a, b, c, d) in enumerate(zip(*sets)) if _proven(a, b, similarity) and _proven(c, d, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in keep], type=pa.int64()) for c in (u, v)], names=["u", "v"])
    return run


def _may_link(a: int, b: int, similarity: int) -> bool:
    return 100 * min(a, b) >= similarity * max(a, b)


def _apart(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


_POOL = -1  # part that stands for the members outside a bucket's main component


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of (queries, members) of a bucket to rows (node, root, part): who has to meet what.

    A query like a member of the main component meets that part of it.  Two
    members outside that are alike both go to the pool of the main component,
    where they meet, so a bucket gives no more rows than it has members and parts.
    """
    for group in whole_groups(batches, ["bucket", "q_part", "m_part"]):
        columns = {c: group.column(c).to_numpy() for c in ("node", "root", "main", "part", "bits0", "bits1")}
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        bits = np.stack([columns["bits0"], columns["bits1"]], axis=1).view(np.uint64)  # of negative numbers, numpy counts other bits
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        in_main = columns["root"][m] == columns["main"][m]
        found = set()
        for at in range(0, len(q), 256):
            some = q[at:at + 256]
            apart = np.bitwise_count(bits[some][:, None] ^ bits[m][None]).sum(axis=2)
            near = (apart <= BITS_APART) & (columns["root"][some][:, None] != columns["root"][m][None])
            for part in np.unique(columns["part"][m][in_main & near.any(axis=0)]).tolist():
                hit = near[:, in_main & (columns["part"][m] == part)].any(axis=1)
                found.update((node, part) for node in columns["node"][some][hit].tolist())
            others = near & ~in_main
            pool = [columns["node"][some][others.any(axis=1)], columns["node"][m][others.any(axis=0)]]
            found.update((node, _POOL) for node in np.concatenate(pool).tolist())
        if found:
            nodes, parts = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in (nodes, [int(columns["main"][0])] * len(nodes), parts)],
                names=["node", "root", "part"])


def _meet(similarity: int):
    """Queries against the members of one part of a component, or of a pool, on full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["root", "part", "q_part", "m_part"]):
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            nodes = group.column("node").to_numpy()
            sets = [_set_of(c) for c in group.column("codes").to_pylist()]
            proof = group.column("proof")
            q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(m):
                continue
            sizes = np.array([len(sets[j]) for j in m])
            codes, owner = np.concatenate([sets[j] for j in m]), np.repeat(np.arange(len(m)), sizes)
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            links = []
            for i in q:
                low, high = (np.searchsorted(codes, sets[i], side=s) for s in ("left", "right"))
                counts = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=len(m))
                links += [(int(nodes[i]), int(nodes[m[j]])) for j in np.flatnonzero(
                    _linked(common, len(sets[i]), sizes, similarity)) if nodes[i] != nodes[m[j]]
                    and _proven(proof[int(i)].as_py(), proof[int(m[j])].as_py(), similarity)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*links)], names=["u", "v"])
    return run


def _parts(n: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.lit(1)).cast("long")


def _dealt(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts)


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with ``node`` and the root of its component, the node itself where it has none."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _in_parts(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, part): every representative in its part of its component."""
    nodes = _with_roots(classes.select("node"), roots)
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return nodes.join(sizes, "root").select("node", "root", _dealt(F.col("node"), _parts(F.col("size"), PART)).alias("part"))


def _bucket_units(members: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components: queries and members, in bounded units."""
    whole = classes.select("node", "bits0", "bits1").join(parts, "node")
    rows = written(members.select("bucket", "node").join(whole, "node"), "members")
    counts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "root")).alias("main")
    ).filter("kinds > 1").select("bucket", F.col("main.root").alias("main"), _parts(F.col("n"), PART).alias("m_parts"),
                                 _parts(F.col("n") - F.col("main.n"), PART).alias("q_parts"))
    rows = rows.join(mixed, "bucket")
    own = ["node", "root", "main", "part", "bits0", "bits1"]
    asking = rows.filter("root <> main").select(
        "bucket", _dealt(F.col("node"), F.col("q_parts")).alias("q_part"),
        _each("m_parts").alias("m_part"), F.lit(True).alias("asks"), *own)
    asked = rows.select(
        "bucket", _each("q_parts").alias("q_part"),
        _dealt(F.col("node"), F.col("m_parts")).alias("m_part"), F.lit(False).alias("asks"), *own)
    return asking.union(asked)


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _hidden_links(members: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Links between members of one bucket and different components."""
    parts = written(_in_parts(classes, roots), "parts")
    units = _grouped(_bucket_units(members, classes, parts), ["bucket", "q_part", "m_part"])
    asks = written(units.mapInArrow(_plausible, "node long, root long, part long").distinct(), "asks")
    pooled = F.col("part") == _POOL
    targets = asks.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "root", "part", _parts(F.col("n"), QUERY_PART).alias("q_parts"),
        F.when(pooled, _parts(F.col("n"), PART)).otherwise(F.lit(1)).cast("long").alias("m_parts"))
    members = parts.union(asks.filter(pooled).select("node", "root", "part"))
    asked = members.join(targets, ["root", "part"]).select(
        "root", "part", _each("q_parts").alias("q_part"), _dealt(F.col("node"), F.col("m_parts")).alias("m_part"),
        F.lit(False).alias("asks"), "node")
    asking = asks.join(targets, ["root", "part"]).select(
        "root", "part", _dealt(F.col("node"), F.col("q_parts")).alias("q_part"), _each("m_parts").alias("m_part"),
        F.lit(True).alias("asks"), "node")
    meeting = asked.union(asking).join(sets.select("node", "codes", "proof"), "node")
    return _grouped(meeting, ["root", "part", "q_part", "m_part"]).mapInArrow(_meet(similarity), "u long, v long")


def _require_similarity(similarity: int) -> None:
    """Bands and bit limit are set for ``SIMILARITY``; pairs below it would be lost without a word."""
    if not SIMILARITY <= similarity <= 100:
        raise ValueError(f"similarity {similarity}: bands and bit limit hold from {SIMILARITY} to 100 per cent")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; linked are sets with similarity of so many per cent."""
    _require_similarity(similarity)
    labelled = _labelled(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), words, similarity)
    return labelled.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """(row, doc_id, n_shingles, root, component_id) per row of (row, doc_id, text); no root without words."""
    own = docs.select("row", F.col("doc_id").cast("long"), "text")
    rows = written(own.mapInArrow(
        _signatures(words),
        "slot long, row long, doc_id long, n_shingles long, set_hash binary, bands array<long>, bits0 long, bits1 long"),
        "signatures")
    first = F.min(F.struct(F.col("slot").alias("node"), "doc_id", "bands", "bits0", "bits1"))
    classes = rows.filter("n_shingles > 0").groupBy("set_hash").agg(first.alias("first"), F.min("doc_id").alias("first_id"))
    classes = written(classes.select("set_hash", "first.*", "first_id"), "classes")
    # buckets with two members or more, each with its smallest
    spread = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).filter("n > 1")
    members = written(spread.join(shared.select("bucket", "center"), "bucket"), "members")
    sets = _full_sets(own, classes, members, words)
    star = members.filter("node <> center").select("node", "center").distinct()
    # the bits of a pair are compared before any set is shipped
    bits = classes.select("node", "bits0", "bits1")
    center_bits = classes.select(F.col("node").alias("center"), F.col("bits0").alias("c0"), F.col("bits1").alias("c1"))
    near = star.join(bits, "node").join(center_bits, "center").filter(
        _apart(F.col("bits0"), F.col("bits1"), F.col("c0"), F.col("c1")) <= BITS_APART).select("node", "center")
    near = written(near, "near")
    # the join on the hot side, the centers, comes last and alone, so that its large partitions can be split
    pairs = near.join(sets.select("node", F.col("codes").alias("codes_v"), F.col("proof").alias("proof_v")), "node").join(
        sets.select(F.col("node").alias("center"), F.col("codes").alias("codes_u"), F.col("proof").alias("proof_u")), "center")
    pairs = pairs.select(F.col("center").alias("u"), F.col("node").alias("v"), "codes_u", "codes_v", "proof_u", "proof_v")
    links = written(pairs.mapInArrow(_confirm(similarity), "u long, v long"), "links")
    roots = components(links)
    hidden = written(_hidden_links(members, classes, sets, roots, similarity), "hidden")
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(stars.union(hidden.select("u", "v"))) if hidden.limit(1).count() else roots
    labels = _with_roots(classes.select("node", "set_hash", "first_id"), roots)
    smallest = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(smallest, "root").select("set_hash", "root", "component_id")
    return rows.join(labels, "set_hash", "left").select("row", "doc_id", "n_shingles", "root", "component_id")


def _full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, codes, proof) of the representatives that share a bucket.

    Their texts are read again.  The list of their ids filters the scan where
    it is short enough to be broadcast, and is joined by key otherwise.
    """
    wanted = written(classes.join(members.select("node").distinct(), "node").select("node", "doc_id", "set_hash"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    coded = texts.mapInArrow(_codes(words), "set_hash binary, codes binary, proof binary")
    coded = coded.join(wanted.select("set_hash", "node"), "set_hash")
    # a class has one hash and one node, and the join has dealt the sets by the hash already
    return written(coded.groupBy("set_hash", "node").agg(*[F.first(c).alias(c) for c in ("codes", "proof")]).drop("set_hash"), "sets")


def one_of_each(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The documents with one row of each group left, the one with the smallest id; all without words stay."""
    _require_similarity(similarity)
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "numbered", compression="zstd")
    grouped = _labelled(rows.select("row", "doc.doc_id", "doc.text"), words, similarity).filter("root IS NOT NULL")
    grouped = written(grouped.select("row", "doc_id", "root"), "grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    leaving = grouped.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    leaving = written(leaving, "leaving")
    if leaving.count() <= BROADCAST_IDS:
        leaving = F.broadcast(leaving)
    return rows.join(leaving, "row", "left_anti").select("doc.*")
