"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents.  All but the last return documents.

Defined results: null, empty and blank texts fail the rules and go; repeated rows
are copies, of which one stays; texts of any length are taken whole; a null
source is a host and a source of its own; rows without an id are kept like all
others; other columns are carried, whatever their names; an empty table gives
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monthloom.llm import mixing, near_dedup, packing, quality, secret_scan
from monthloom.llm.queries import tokenizer_path
from monthloom.llm.shipping import ship
from monthloom.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host is rejected, go."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    ship(spark)
    return near_dedup.one_of_each(docs, words=5, similarity=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ship(spark)
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their targets."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None  # tokens and fitted rates have no SQL; a brute-force version is in the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
