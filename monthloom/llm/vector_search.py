"""Exact top-k inner products with vector-approximation files.

Vectors are stored in blocks: ids, one byte per component naming a cell of the
component's range in the block, and the exact integers.

1. Query blocks meet the cells of candidate blocks, an eighth of the vectors.
   One matrix product gives a lower and an upper bound of every score; the k
   best lower bounds of each unit are merged, and the k-th of all blocks is the
   floor of a query.
2. The cells are scanned again.  Vectors whose upper bound is below the floor of
   a query are out, whatever block they are in; places and bounds of the others,
   about k for a query, come out.
3. These are read exactly, from the blocks joined by their numbers, in the order
   of their bounds, until the k-th best score is above every bound that is left.

Every unit holds a set number of query and candidate vectors, so memory is
bounded; the work is queries times candidates by nature, all of it in blocks.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; shorter vectors count as padded with
zeros; equal scores are ordered by id; a query meets no row of its own id; each
repeated query row gets its own results; an empty table gives no rows; other
columns are ignored.  Components are floor(scale * x) and should stay below 2^26.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.session import written

SCALE = 256
CELLS = 256
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
QUERY_BLOCKS_PER_UNIT = 8
READ_AT_ONCE = 16
_BLOCK = "block long, n int, ids binary, exact binary, cells binary, low binary, width binary"


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components as integers; unusable vectors are left out."""
    v, limit = F.col(f"`{vector_column}`"), F.lit(float("inf"))
    unusable = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    return vectors.filter(v.isNotNull() & F.col(f"`{id_column}`").isNotNull() & ~unusable).select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(width: int, rows: int):
    """Batches to blocks of at most ``rows`` vectors of ``width`` components."""
    def block(number: int, ids: np.ndarray, exact: np.ndarray) -> dict:
        low = exact.min(axis=0)
        step = np.maximum(1, -(-(exact.max(axis=0) - low + 1) // CELLS))
        return {"block": number, "n": len(ids), "ids": ids.tobytes(), "exact": exact.tobytes(),
                "cells": ((exact - low) // step).astype(np.uint8).tobytes(), "low": low.tobytes(), "width": step.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, have = TaskContext.get().partitionId() << 32, [], 0
        schema = None

        def full(most: int):
            nonlocal number, waiting, have
            while have >= most and have:
                ids, exact = (np.concatenate(x) for x in zip(*waiting))
                part = block(number, ids[:rows], exact[:rows])
                waiting, have, number = [(ids[rows:], exact[rows:])], max(0, have - rows), number + 1
                yield pa.RecordBatch.from_pylist([part], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[
            (c, pa.binary()) for c in ("ids", "exact", "cells", "low", "width")]])
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            exact = np.zeros((len(sizes), width), dtype=np.int64)
            exact[np.arange(width) < sizes[:, None]] = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            waiting.append((batch.column("id").to_numpy(), exact))
            have += len(sizes)
            yield from full(rows)
        yield from full(1)
    return run


def _in_blocks(vectors: DataFrame, width: int, rows: int, name: str) -> DataFrame:
    """Written blocks with dense numbers ``no`` from 0; the numbered table has one row per block."""
    blocks = written(vectors.mapInArrow(_blocks(width, rows), _BLOCK), name)
    numbers = blocks.select("block").withColumn("no", F.row_number().over(Window.orderBy("block")) - 1)
    return blocks.join(numbers, "block")


def _matrix(data: bytes, n: int, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=dtype).reshape(n, -1)


def _bounds(queries: np.ndarray, query_ids: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of a block from its cells; minus infinity for a query's own id."""
    low, step = (np.frombuffer(block[c], dtype=np.int64) for c in ("low", "width"))
    # a component lies in [low + cell * step, low + cell * step + step - 1]
    corner = (queries * step).astype(float) @ _matrix(block["cells"], block["n"], np.uint8).astype(float).T + (queries @ low)[:, None]
    above = (np.maximum(queries, 0) * (step - 1)).sum(axis=1)
    below = (np.minimum(queries, 0) * (step - 1)).sum(axis=1)
    blur = 1e-12 * (np.abs(queries).astype(float) @ (np.abs(low) + CELLS * step))  # of the product in floating point
    corner[query_ids[:, None] == np.frombuffer(block["ids"], dtype=np.int64)[None]] = -np.inf
    return corner + (below - blur)[:, None], corner + (above + blur)[:, None]


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest numbers of every row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        values = np.pad(values, ((0, 0), (0, k - values.shape[1])), constant_values=-np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k:]


def _lower_bounds(k: int):
    """(block, place, low): the k best lower bounds of each query in a unit."""
    def run(key: tuple, query_blocks: pa.Table, candidates: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], []]
        for part in query_blocks.to_pylist():
            queries, ids = _matrix(part["exact"], part["n"]), np.frombuffer(part["ids"], dtype=np.int64)
            best = np.full((part["n"], k), -np.inf)
            for block in candidates.to_pylist():
                best = _best(np.concatenate([best, _bounds(queries, ids, block)[0]], axis=1), k)
            place, at = np.nonzero(np.isfinite(best))
            columns[0] += [part["block"]] * len(place)
            columns[1] += place.tolist()
            columns[2] += best[place, at].tolist()
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, types)], names=["block", "place", "low"])
    return run


_SURVIVORS = "block long, place long, query_id long, query binary, no int, at array<int>, high array<double>"


def _survivors(key: tuple, query_blocks: pa.Table, candidates: pa.Table) -> pa.Table:
    """For each query and candidate block, the rows that may be among the best, in the order of their upper bounds."""
    rows = []
    for part in query_blocks.to_pylist():
        queries, ids = _matrix(part["exact"], part["n"]), np.frombuffer(part["ids"], dtype=np.int64)
        floors = np.frombuffer(part["floors"], dtype=float)
        for block in candidates.to_pylist():
            high = _bounds(queries, ids, block)[1]
            alive = (high >= floors[:, None]) & np.isfinite(high)
            for q in np.flatnonzero(alive.any(axis=1)).tolist():
                at = np.flatnonzero(alive[q])
                at = at[np.argsort(-high[q, at], kind="stable")]
                rows.append({"block": part["block"], "place": q, "query_id": int(ids[q]), "query": queries[q].tobytes(),
                             "no": block["no"], "at": at.tolist(), "high": high[q, at].tolist()})
    return pa.Table.from_pylist(rows, schema=pa.schema([
        ("block", pa.int64()), ("place", pa.int64()), ("query_id", pa.int64()), ("query", pa.binary()), ("no", pa.int32()),
        ("at", pa.list_(pa.int32())), ("high", pa.list_(pa.float64()))]))


def _read_exactly(exact: np.ndarray, ids: np.ndarray, query: np.ndarray, at: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) among some rows, read in the order of their upper bounds."""
    best: list[tuple[int, int]] = []
    for begin in range(0, len(at), READ_AT_ONCE):
        if len(best) == k and -best[-1][0] > high[begin]:
            break
        some = at[begin:begin + READ_AT_ONCE]
        best = sorted(best + list(zip((-(exact[some] @ query)).tolist(), ids[some].tolist())))[:k]
    return [(-s, i) for s, i in best]


def _exact_unit(k: int):
    def run(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        for block in blocks.to_pylist():
            exact, ids = _matrix(block["exact"], block["n"]), np.frombuffer(block["ids"], dtype=np.int64)
            for r in asked.to_pylist():
                query = np.frombuffer(r["query"], dtype=np.int64)
                for score, i in _read_exactly(exact, ids, query, np.array(r["at"]), np.array(r["high"]), k):
                    for column, value in zip(columns, (r["block"], r["place"], r["query_id"], i, score)):
                        column.append(value)
        return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=["block", "place", "query_id", "id", "score"])
    return run


def _packed_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One floor for every query of a block, minus infinity where there are fewer bounds than asked for."""
    for batch in batches:
        floors = []
        for n, places, lows in zip(*(batch.column(c).to_pylist() for c in ("n", "places", "lows"))):
            own = np.full(n, -np.inf)
            own[places or []] = lows or []
            floors.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(floors, type=pa.binary())], names=["block", "floors"])


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) for tables (id, v) of integer vectors."""
    width = max(1, candidates.select(F.max(F.size("v"))).first()[0] or 1,
                queries.select(F.max(F.size("v"))).first()[0] or 1)
    blocks = written(_in_blocks(candidates, width, CANDIDATE_BLOCK, "vectors"), "blocks")
    asked = written(_in_blocks(queries, width, QUERY_BLOCK, "queries").withColumn(
        "unit", F.floor(F.col("no") / QUERY_BLOCKS_PER_UNIT).cast("int")), "asked")
    n_blocks, n_asked = blocks.count(), asked.count()
    n_units = -(-n_asked // QUERY_BLOCKS_PER_UNIT)
    every = F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))).alias("no")
    units = F.explode(F.sequence(F.lit(0), F.lit(max(n_units, 1) - 1))).alias("unit")
    cells = blocks.select("n", "ids", "cells", "low", "width", "no", units).groupBy("no", "unit")
    left = asked.select("block", "n", "ids", "exact", "unit", every)
    lows = left.groupBy("no", "unit").cogroup(cells).applyInArrow(_lower_bounds(k), "block long, place long, low double")
    order = Window.partitionBy("block", "place").orderBy(F.col("low").desc())
    floors = lows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    # a block has a set number of queries
    floors = floors.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("low").alias("lows"))
    floors = written(asked.select("block", "n").join(floors, "block", "left").mapInArrow(_packed_floors, "block long, floors binary"), "floors")
    left = asked.join(floors, "block").select("block", "n", "ids", "exact", "floors", "unit", every)
    alive = left.groupBy("no", "unit").cogroup(cells).applyInArrow(_survivors, _SURVIVORS)
    alive = written(alive.join(asked.select("block", "unit"), "block"), "survivors")
    wanted = alive.select("no", "unit").distinct().toDF("no", "unit")
    reading = wanted.join(blocks.select("no", "n", "ids", "exact"), "no").toDF("no", "unit", "n", "ids", "exact")
    best = alive.groupBy("no", "unit").cogroup(reading.groupBy("no", "unit")).applyInArrow(
        _exact_unit(k), "block long, place long, query_id long, id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k best other rows for every row whose id is divisible by ``every``."""
    whole = whole_vectors(vectors, id_column, vector_column, scale)
    return search(whole.filter(F.col("id") % every == 0), whole, k)
