"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from monthloom.llm import near_dedup, secret_scan
from monthloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.llm.test_native import brute_quality
from tests.llm.test_near_dedup import brute as brute_near
from tests.oracle import difference, spark_rows, sql_rows

SMALL = os.path.join(os.path.dirname(SF_DIR), "sf0.001")


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(spark_rows(QUERIES[name](spark, SF_DIR)), sql_rows(duck, ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_or_more_per_document(spark, name):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert QUERIES[name](spark, SMALL).count() >= n


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "secret scans", "mixing", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    good = stages["quality rules"](spark, docs, SMALL)
    assert {r.doc_id for r in good.collect()} == {i for i, r in before.items() if not brute_quality(r.text)[-1]}
    alone = stages["near duplicates"](spark, good, SMALL)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in alone.collect()} == {i for i, _, _, kept in brute_near(rows, 5) if kept}
    masked = stages["secret scans"](spark, alone, SMALL)
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: secret_scan.masked(r.text) for r in alone.collect()}
    mixed = stages["mixing"](spark, masked, SMALL)
    for table in (good, alone, masked, mixed):
        assert table.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    taken = mixed.collect()
    assert taken and all(texts[r.doc_id] == r.text for r in taken)
    packed = stages["packing"](spark, mixed, SMALL).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) == len({(r.doc_id, r.piece) for r in packed if r.start == 2048 * r.piece})
    assert {r.doc_id for r in packed} == {r.doc_id for r in taken}
    assert sum(1 for r in packed if r.piece == 0) == len(taken)


def test_whole_pipeline(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_signature_misses_are_rare():
    """Chance that a pair at the limit shares no band, and that its bits differ too much."""
    from math import comb

    rows = near_dedup.HASHES // near_dedup.BANDS
    assert (1 - 0.8 ** rows) ** near_dedup.BANDS < 1e-7
    n, p = near_dedup.HASHES, (1 - 0.8) / 2
    assert sum(comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(near_dedup.BITS_APART + 1, n + 1)) < 1e-6
