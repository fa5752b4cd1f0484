import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from checks.compare import compare, connect  # noqa: E402
from hazardlake.llm import exact, mixing  # noqa: E402
from hazardlake.llm.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = compare(spark, connect(SMALL), name, QUERIES[name], SQL[name], SMALL)
    assert found["ok"], found


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, before, SMALL).cache()
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty(), name
        before = after
    assert exact.exact_dedup(before).filter("NOT kept").isEmpty()
    mixed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert mixed.exceptAll(mixing.taken(mixing.mix_sources(before)).select(mixed.columns)).isEmpty()
