"""Spans found in texts: running a finder over a table, and digests of its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.llm.arrow import slices

SLICE_BYTES = 8 << 20
Span = tuple[str, int, int]
SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def add_spans(docs: DataFrame, column: str, find: Callable[[str], list[Span]], carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all of them, if none are named) and the spans of ``text`` as ``column``.

    Works row by row in batches, without a shuffle; positions count code
    points, ends are exclusive.  The carried columns travel as one, so their
    names don't matter; one named like ``column`` gives way to it.
    """
    names = [c for c in (carry if carry is not None else docs.columns) if c.lower() != column.lower()]
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    source = docs.select(F.struct(*quoted).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                found = [[{"kind": k, "begin": a, "end": b} for k, a, b in find(t)] if t else []
                         for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(found, type=_ARROW_SPANS)], names=["row", "spans"])

    schema = T.StructType([source.schema["row"], T.StructField("spans", SPAN_TYPE)])
    return source.mapInArrow(run, schema).select(*[f"row.{c}" for c in quoted], F.col("spans").alias(column))


def replace_texts(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """The documents with ``change`` applied to their texts; ``n_chars`` follows where a text changed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                old = some.column("text").to_pylist()
                new = [change(t) if t else t for t in old]
                columns = {"text": pa.array(new, type=some.schema.field("text").type)}
                if "n_chars" in some.schema.names:
                    sizes = some.column("n_chars")
                    columns["n_chars"] = pa.array(
                        [n if a == b else len(b) for n, a, b in zip(sizes.to_pylist(), old, new)], type=sizes.type)
                yield pa.RecordBatch.from_arrays(
                    [columns.get(c, some.column(c)) for c in some.schema.names], schema=some.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:begin:end of every span in its order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest_columns(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    """Counts per base kind, the digest of base spans and the list of all spans."""
    return [
        *[F.size(of_kinds(spans, (k,))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(of_kinds(spans, kinds)).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    ]
