"""Registered queries whose result SQL can state, against DuckDB on sf0.001."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from factloom.llm import queries
from oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF, duck(SF))
    assert r["match"], r


def test_all_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))


def test_pipeline_on_odd_repeated_and_no_rows(spark, odd_docs, tmp_path):
    """Columns named like those that the stages use inside, null ids and texts,
    repeated rows, labels of one class; then no rows at all."""
    docs = odd_docs.withColumns({c: F.lit(c) for c in ("__toxicity", "__sha", "__own", "__id")})
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        stage = rows
        for key, function in corpus_pipeline.STAGES[:-1]:
            stage = function(spark, stage, folder)
            assert stage.columns == docs.columns, key
        kept = [(r.doc_id, r.text) for r in stage.collect()]
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in packed} == {i for i, _ in kept} and len(kept) == len(set(kept))
        assert (name == "none") == (not packed)
