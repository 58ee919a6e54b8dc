"""The stages one after another, each on what the one before kept."""

import os

import pytest

import corpus_pipeline
from lodeframe.llm.registry import queries, tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "substring", "mixing", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.dtypes == docs.dtypes, name
        rows = now.collect()
        ids = [r["doc_id"] for r in rows]
        assert set(ids) <= set(before) and rows
        if name != "mixing":
            assert len(set(ids)) == len(ids)
        before = {r["doc_id"]: r["text"] for r in rows}
        now = spark.createDataFrame(rows, docs.schema)
    words = [t.split() for _, t in sorted(before.items())]
    seen: dict[tuple[str, ...], int] = {}
    for n, w in enumerate(words):
        assert all(seen.setdefault(tuple(w[s : s + 51]), n) == n for s in range(len(w) - 50))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    assert os.path.exists(tokenizer_path())
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50
    assert len(queries()) == 10 and corpus_pipeline.ORACLE_SQL is None
