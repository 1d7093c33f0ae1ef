"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns are numbered within their conversation: sorted by ranges, counted per
   range and conversation, and shifted by what earlier ranges hold, so that one
   very long conversation is many ranges.
2. Every prefix gets a name, a chain of SHA-256 digests of its turns.  Chains run
   inside blocks of ``BLOCK`` turns; the digests of whole blocks are a shorter
   sequence that is named the same way, so no task follows a whole conversation.
   Prefixes of equal name are one node.
3. Subtree totals come from contracting the tree.  A round first rakes: every
   leaf adds its total to its parent and goes.  Then it compresses: of the nodes
   with a single child left, those that a coin picks and whose child it does not
   pick are spliced out, and what they hold moves to the edge above the child.
   Chains and stars both vanish in a number of rounds logarithmic in the tree.
4. A spliced node's total is that of its child plus a known difference.  These
   references are shortened by doubling until they end at raked nodes, which
   gives every total.

Texts are shipped once as a digest and a length.  Defined results: rows without
a conversation id are ignored; a null role or text is empty, a null turn comes
first; turns of equal number are ordered by the digest of role and text, and
repeated rows are repeated turns; an empty table gives no rows, not even a
root; other columns are ignored; texts may have any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.arrow import whole_groups
from monthloom.session import written

BLOCK = 256
CHUNK = 4096                       # conversation ids joined to one string
ROOT = "00" * 32                   # name of the empty prefix
MOST_ROUNDS = 400


# ----------------------------------------------------------------------- turns


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, key, bytes): turns with their place in the conversation, from (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    # the row number parts equal turns, so a heap of copies can be cut
    order = ["conv_id", "turn", "key", "row"]
    keyed = written(own, "turns").withColumn("row", F.monotonically_increasing_id())
    pieces = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes").mapInArrow(
        _number, "conv_id long, piece int, at long, key binary, bytes long")
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece")) - F.col("n")
    # a range begins within one conversation at most, so there are fewer of these rows than ranges
    shifts = counts.withColumn("before", before).filter("before > 0").select("conv_id", "piece", "before")
    return pieces.join(F.broadcast(shifts), ["conv_id", "piece"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "key", "bytes")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, last, upto = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        if ids[0] == last:
            at[:first[1] if len(first) > 1 else len(ids)] += upto
        last, upto = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), pa.array(np.full(len(ids), piece, dtype=np.int32)), pa.array(at),
            batch.column("key"), batch.column("bytes")], names=["conv_id", "piece", "at", "key", "bytes"])


def shared_openings(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first turns of the one ``conv_id - conv_id % every``.

    The number h of turns, at most ``most``, is the digest of the id; the own
    turns follow after the first h.  Returns (conv_id, at, key, bytes, size) and
    (conv_id, size) of all conversations; the remainder has the sign of the id.
    """
    turns = written(turns, "numbered")
    convs = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "convs")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most + 1)
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    own = own.withColumn("taken", taken).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = written(own.select("conv_id", "base", "h", "taken", "size"), "openings")
    later = turns.join(own, "conv_id").filter("at >= h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "key", "bytes", "size")
    opening = turns.filter(F.col("at") < most).select(F.col("conv_id").alias("base"), "at", "key", "bytes").join(
        own.filter("taken > 0"), "base").filter("at < taken").select("conv_id", "at", "key", "bytes", "size")
    return later.unionByName(opening), own.select("conv_id", "size")


# ----------------------------------------------------------------------- names


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest chains inside blocks: the chain up to each row, and up to the row before (null for the first)."""
    for group in whole_groups(batches, ["conv_id", "block"]):
        runs, run = [], b""
        for key in group.column("key").to_pylist():
            run = hashlib.sha256(run + key).digest()
            runs.append(run)
        yield pa.RecordBatch.from_arrays([
            *[group.column(c).combine_chunks() for c in ("conv_id", "block", "at")],
            pa.array(runs, type=pa.binary()), pa.array([None, *runs[:-1]], type=pa.binary()),
            pa.array([False] * (len(runs) - 1) + [True])], names=["conv_id", "block", "at", "run", "run_before", "last"])


def _joined_name(state: Column, run: Column) -> Column:
    return F.unhex(F.sha2(F.concat(state, run), 256))


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, at, name, parent): names of the prefix that ends with each turn, and of the one before it.

    Blocks, each with its whole chain as its digest, form a sequence of their
    own: its names stand for the prefixes that end with a whole block, and
    start the chains inside the next one.
    """
    rows = turns.select("conv_id", F.floor(F.col("at") / BLOCK).alias("block"), "at", "key")
    runs = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").mapInArrow(
        _runs, "conv_id long, block long, at long, run binary, run_before binary, last boolean")
    if longest <= BLOCK:
        runs = runs.withColumns({"before": F.unhex(F.lit(ROOT)), "after": F.lit(None).cast("binary")})
    else:
        runs = written(runs, "runs")
        blocks = runs.filter("last").select("conv_id", F.col("block").alias("at"), F.col("run").alias("key"))
        names = prefix_names(blocks, -(-longest // BLOCK)).select(
            "conv_id", F.col("at").alias("block"), F.col("parent").alias("before"), F.col("name").alias("after"))
        whole = F.when(F.col("at") % BLOCK == BLOCK - 1, F.col("after"))
        runs = runs.join(names, ["conv_id", "block"]).withColumn("after", whole)
    return runs.select(
        "conv_id", "at", F.coalesce("after", _joined_name(F.col("before"), F.col("run"))).alias("name"),
        F.coalesce(_joined_name(F.col("before"), F.col("run_before")), F.col("before")).alias("parent"))


# ------------------------------------------------------------------------ trie


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the conversations that end at each.

    ``turns`` is (conv_id, at, key, bytes, size), ``convs`` (conv_id, size) with
    every conversation, also those without turns.  Nodes are (name, conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes): what
    storing each distinct prefix once saves is summed over the subtree.  Ends
    are (name, conv_id).
    """
    turns = written(turns, "rebuilt")
    longest = turns.agg(F.max("size")).first()[0] or 0
    named = prefix_names(turns, longest).join(turns.select("conv_id", "at", "bytes", "size"), ["conv_id", "at"])
    named = written(named, "prefixes")
    nodes = named.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), (F.min("at") + 1).alias("depth"), F.min("parent").alias("parent_name"),
        F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.unhex(F.lit(ROOT)).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent_name"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = written(nodes.unionByName(root), "names").withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    above = nodes.select(F.col("name").alias("parent_name"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(above, "parent_name", "left"), "linked")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    totals = subtree_totals(nodes.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.col("n_children").alias("live")), ["leaves", "saved"])
    nodes = nodes.join(totals, "node").select(
        "name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_bytes"))
    ends = named.filter("at + 1 = size").select("name", "conv_id").union(
        convs.filter("size = 0").select(F.unhex(F.lit(ROOT)), "conv_id"))
    return nodes, ends


def _coin(node: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), node), F.lit(2)) == 1


def subtree_totals(state: DataFrame, values: list[str]) -> DataFrame:
    """(node, values summed over its subtree) from (node, parent, live, values) with ``live`` children.

    Every tree has a node with null parent.  Values are summed as long.
    """
    up = [f"{v}_up" for v in values]  # what spliced nodes left on the edge to the parent
    state = written(state.select("node", "parent", "live", *values, *[F.lit(0).cast("long").alias(u) for u in up]), "state")
    raked, spliced = [], []
    for turn in range(MOST_ROUNDS):
        if not state.limit(1).count():
            break
        leaf = F.col("live") == 0
        raked.append(state.filter(leaf).select("node", *values))
        below = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.sum(leaf.cast("long")).alias("gone"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(u)).otherwise(0)).alias(f"{v}_raked") for v, u in zip(values, up)],
            # of use only where one child is left, and then they are that child's
            F.max(F.when(~leaf, F.col("node"))).alias("child"), *[F.max(F.when(~leaf, F.col(u))).alias(f"{u}_child") for u in up])
        after = state.filter(~leaf).join(below, "node").withColumn("live", F.col("live") - F.col("gone"))
        after = after.withColumns({v: F.col(v) + F.col(f"{v}_raked") for v in values}).withColumn(
            "out", (F.col("live") == 1) & F.col("parent").isNotNull() & _coin(F.col("node"), turn) & ~_coin(F.col("child"), turn))
        after = written(after.drop("gone", *[f"{v}_raked" for v in values]), "raked")
        out = after.filter("out")
        spliced.append(out.select("node", F.col("child").alias("via"),
                                  *[(F.col(v) + F.col(f"{u}_child")).alias(v) for v, u in zip(values, up)]))
        moved = out.select(F.col("child").alias("node"), F.col("parent").alias("higher"),
                           *[(F.col(v) + F.col(u)).alias(f"{u}_more") for v, u in zip(values, up)])
        state = after.filter("NOT out").join(moved, "node", "left").select(
            "node", F.coalesce("higher", "parent").alias("parent"), "live", *values,
            *[(F.col(u) + F.coalesce(f"{u}_more", F.lit(0))).alias(u) for u in up])
        state = written(state, "state")
    else:
        raise RuntimeError(f"the tree is not contracted after {MOST_ROUNDS} rounds; it has a cycle")
    if not raked:
        return state.select("node", *values)
    return _expanded(_all(raked), _all(spliced), values, len(spliced))


def _all(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    return found


def _expanded(raked: DataFrame, spliced: DataFrame, values: list[str], rounds: int) -> DataFrame:
    """Totals of all nodes: references of spliced nodes are no longer than there were rounds."""
    spliced = written(spliced, "spliced")
    for _ in range(math.ceil(math.log2(max(rounds, 1)))):
        further = spliced.select(F.col("node").alias("via"), F.col("via").alias("_via"), *[F.col(v).alias(f"_{v}") for v in values])
        spliced = written(spliced.join(further, "via", "left").select(
            "node", F.coalesce("_via", "via").alias("via"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "spliced")
    done = written(raked, "totals")
    known = done.select(F.col("node").alias("via"), *[F.col(v).alias(f"_{v}") for v in values])
    return done.union(spliced.join(known, "via").select("node", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]))


# ------------------------------------------------------------------------ ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node as comma-joined strings of bounded length."""
    for batch in batches:
        names, ids = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
        rows, begin = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or names[k] != names[begin] or k - begin == CHUNK:
                rows.append((names[begin], ids[begin], ",".join(map(str, ids[begin:k]))))
                begin = k
        if rows:
            name, first, text = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, type=pa.binary()), pa.array(first, type=pa.int64()), pa.array(text)], names=["name", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running digest at a time, so a node with very many ends takes no memory."""
    name, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if own != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _digest_rows(done)
    if name is not None:
        yield _digest_rows([(name, digest.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    name, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name, type=pa.binary()), pa.array(digest)], names=["name", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the ids that end at each node, ascending and comma-joined.

    Ids are joined to strings by ranges, in parallel within a node; the digest
    itself is sequential by nature and reads those strings in order.
    """
    order = ["name", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "name binary, first long, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name binary, ends_sha256 string")
