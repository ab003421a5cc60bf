"""Late redelivery to a rollup of several commits."""

import pytest

from lexloom.llm import token_rollups


def test_redelivery_after_many_commits(spark, tmp_path):
    store = token_rollups.Rollups(spark, str(tmp_path / "r"))
    changes = spark.createDataFrame([("insert", "a", "t@1", "s", "en", 3, 0)], "op string, doc_key string, tokenizer string, source string, lang string, n_tokens long, seq int")
    for batch in (1, 2, 10, 11, 13):
        assert store.apply(batch, changes)
    for batch in (1, 2, 10, 11, 13):
        assert not store.apply(batch, changes)
    with pytest.raises(ValueError):
        store.apply(12, changes)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "t@1", 1, 3)]
