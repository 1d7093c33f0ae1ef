"""Token-id output: Parquet files with list columns, and reading them back.

Documents are put in ascending id order by a range partitioning and encoded
partition by partition.  The files hold one row per document: its ids as a
list column with dictionary encoding, its id, place and length as columns with
delta encoding, in row groups and pages of set size with page indexes, so a
reader can fetch metadata alone or the tokens of some documents.

Defined results: a null text is the empty text and holds the end id only; null
ids come first; rows with equal ids are kept and ordered by text; an empty
table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom.llm.arrow import slices
from monthloom.llm.tokens import encoder
from monthloom.session import written

SLICE_BYTES = 2 << 20
BROADCAST_PARTS = 100_000  # one small row per file part
_FILE_ROW = "part int, place long, doc_id long, local_start long, n_tokens long, ids array<int>"
_FILE_TYPES = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
                         ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                flat, sizes = own.encode(some.column("text").to_pylist())
                values = np.insert(flat, np.cumsum(sizes), end_id).view("<i4")
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(place, place + n)),
                    some.column("doc_id").cast(pa.int64()), pa.array(start + ends - sizes), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ], schema=_FILE_TYPES)
                place, start = place + n, start + int(ends[-1])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the ids of every text, ended by ``end_id``, in ascending ``doc_id`` order."""
    ordered = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    writer = ordered.mapInArrow(_encode_rows(tokenizer, end_id), _FILE_ROW).write
    for key, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",     # delta encoding where there is no dictionary
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": "1000",
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens[, ids]); without ``tokens`` only the metadata columns are read.

    ``start`` counts the ids of all documents before.  The files hold places
    within a part; the totals of the parts, one small row each, add up to it.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = written(totals.select(
        "part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before")), "offsets")
    if before.count() <= BROADCAST_PARTS:
        before = F.broadcast(before)
    columns = ["doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens"]
    return files.join(before, "part").select(*columns, *(["ids"] if tokens else []))
