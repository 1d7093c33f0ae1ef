"""One registered query per operator: its digest columns over a whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import conversation_trie, mixing, near_dedup, packing, pii, quality, queries_sql, secret_scan, spelling, suffix_dedup, token_counts, token_files, url_filter, vector_search
from monthloom.llm.shipping import ship
from monthloom.llm.spans import digest_columns
from monthloom.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the same package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_suffix_dedup", queries_sql.REPEATED_STRINGS)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", *digest_columns(F.col("spans"), pii.BASE_KINDS))


@_query("op3_quality", queries_sql.QUALITY)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_documents(spark, sf_dir))


@_query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", *digest_columns(F.col("spans"), secret_scan.BASE_KINDS))


@_query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@_query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@_query("op7_top_k", queries_sql.TOP_K)
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.top_k(vectors).withColumnRenamed("id", "vec_id")


@_query("op8_near_dedup", queries_sql.NEAR_DUPLICATES)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), words=2)


@_query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _digest_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().astype("<u4", copy=False)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)),
            pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], type=pa.int64()),
        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


@_query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    rows = token_files.read_token_files(spark, path).select("doc_id", "start", "ids")
    return rows.mapInArrow(_digest_tokens, "doc_id long, start long, n_tokens long, ids_crc32 long")


# Host and path rules, and whether they allow.
URL_RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]


@_query("op13_url_filter", queries_sql.URL_FILTER)
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a rule are blocked if all pages of their host and path are thin."""
    ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "rule string, allow boolean")
    judged = url_filter.judge(pages.select(F.col("page_id").alias("id"), "url"), rules, url_filter.thin_pages(pages))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "listed", "verdict")


@_query("op12_spelling", queries_sql.SPELLING)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_documents(spark, sf_dir), least_length=6, least_count=5, every=199)
    return spelling.spelling_variants(words, times=5)


@_query("op11_conversation_trie", queries_sql.CONVERSATION_TRIE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations open with turns of another one, are named by their prefixes and summed over subtrees."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nodes, ends = conversation_trie.trie(*conversation_trie.shared_openings(conversation_trie.numbered_turns(rows)))
    digests = conversation_trie.end_digests(ends)
    return nodes.join(digests, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
