"""Registered queries of the numbered operators, and the pipeline, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checker import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WITH_SQL = sorted(k for k in entry.LLM_QUERIES if k in entry.LLM_ORACLES)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, entry.LLM_QUERIES[name], entry.LLM_ORACLES[name])
    assert ok, note


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entry.LLM_QUERIES if k.startswith("op")) == list(range(1, 14))
    assert "pipeline" in entry.LLM_QUERIES


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert 200 > counts[0] >= counts[1] > counts[2] and counts[4] == counts[3]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]
