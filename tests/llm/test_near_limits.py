"""Near-duplicates stop rather than lose links."""

import pytest

from monthloom.llm import components, near_dedup


@pytest.mark.parametrize("similarity", [0, 50, 79, 101])
@pytest.mark.parametrize("run", [near_dedup.near_duplicates, near_dedup.one_of_each])
def test_similarities_without_bands_are_refused(spark, run, similarity):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="similarity"):
        run(docs, 1, similarity)


def test_unstable_components_are_an_error(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    assert {r.root for r in components.components(chain).collect()} == {0}
    monkeypatch.setattr(components, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="stable"):
        components.components(chain)
