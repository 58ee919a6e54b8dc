"""Nulls, empty, very long and repeated texts, repeated ids, ties, empty tables and clashing column names, for every
operator on documents and for every stage of the pipeline as a stage."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import lm_scoring, media, mixing, packing, quality, sharding, simhash, substring
from lodeframe.llm.registry import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or give to their results.
CLASHING = "_hash _bucket _own _key _past _sum size rank target taken slot shard law to kind place piece start length fp fingerprint component_id band seed level n word x d a q dim weight before score payload feature labels quality similarity position _lodeframe_positions".split()


def told(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("river stone field cloud letter window paper garden summer winter bridge harbour").lower() + str(rng.randrange(40)) for _ in range(n))


def table(spark):
    shared, long = told(70, 5), told(30_000, 6)
    rows = [(i, told(40, i), "en", "web", None) for i in range(8)]
    rows += [(20, shared, "en", "web", 1), (21, shared, "en", None, 1), (21, shared, "en", None, 1), (21, told(20, 9) + " " + shared, None, "book", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "web", 0), (32, " \t\n", "en", "web", 3), (None, told(12, 7), "en", "web", None), (None, None, None, None, None), (33, "é" * 9 + " \U0001f600", "fr", "book", 11), (40, long, "en", "web", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def crowded(docs):
    return docs.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])


def classified(docs):
    labels = docs.sparkSession.createDataFrame([(i, 1, 0) for i in range(8)] + [(20, 0, 0)], "doc_id long, quality int, toxic int")
    return quality.classify(docs, labels)


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "simhash 0.8": lambda docs: simhash.near_duplicates(docs, width=5, similarity=0.8),
    "substring": substring.repeated_passages,
    "sharding": sharding.hilbert_shards,
    "lm_scoring": lm_scoring.stupid_backoff,
    "mixing": lambda docs: mixing.curriculum(docs).drop("positions"),
    "packing": lambda docs: packing.pack(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "media": media.media_column,
    "quality": classified,
}
#: Operators with one row for each row of documents.
EACH = {"sharding", "lm_scoring", "mixing", "media", "quality"}


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    docs, run = table(spark).cache(), OPERATORS[name]
    found = rows_of(run(docs))
    assert rows_of(run(crowded(docs))) == found
    if name in EACH:
        assert len(found) == docs.count()
    assert run(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], crowded(table(spark)).cache()
    out = stage(spark, docs, DATA)
    if name != "packing":
        assert out.dtypes == docs.dtypes
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= {r["doc_id"] for r in docs.collect()}
        if name == "simhash":
            assert sum(i in (20, 21) for i in ids) < 4 and set(range(8)) <= set(ids)
        if name == "substring":  # of the rows of 21 those of least text alone are cut; a row that is a copy throughout goes
            own, texts = told(20, 9), {(r["doc_id"], r["text"]) for r in out.collect()}
            assert (20, told(70, 5)) in texts and any(i == 21 and own in t for i, t in texts)
            assert set(ids) | {21} == {r["doc_id"] for r in docs.collect()}
    else:
        assert out.agg(F.sum("length")).first()[0] > 30_000
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.count() == 0 and empty.dtypes == out.dtypes
