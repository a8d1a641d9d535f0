"""Registered queries against their SQL, and the pipeline stage by stage."""

import importlib

import pytest

import corpus_pipeline
from canonframe.llm import decontaminate as D, queries
from tests.harness import compare, connect

from .helpers import SF, documents, no_docs, odd_docs


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    docs = documents(spark)
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns, name
        now = [r["doc_id"] for r in docs.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids
        ids = set(now)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    held = [b" " + b" ".join(D.words_of(r["text"])) + b" " for r in items]
    assert not any(w in b" " + b" ".join(D.words_of(r["text"])) + b" " for r in docs.collect() for w in held)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in out} == ids and all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()} == {(r["doc_id"], r["ids_sha256"]) for r in out}


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_stages_stand_odd_rows(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
