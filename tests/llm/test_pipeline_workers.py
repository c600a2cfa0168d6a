"""Python workers of the pipeline's stages: one a task in the last stage, and of one kind only."""

import corpus_pipeline as P
import pytest
from pyspark import SparkContext

from slidespark.llm import bpe, toxicity
from slidespark.llm.queries import vocabulary

DOCS = [(i, f"word{i % 7} other {'vile scum' if i % 3 == 0 else 'kind words'} <|endoftext|> é{i}") for i in range(60)] + [(60, None), (61, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").localCheckpoint()


def test_bpe_stage_has_one_worker_a_task(spark, docs):
    got = P.bpe_stage(spark, docs, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    rows = lambda d: sorted((r.doc_id, bytes(r.ids), r.decoded) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(want)) == len(DOCS)


def test_toxicity_starts_no_workers_for_its_small_tables(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").localCheckpoint()

    def refused(*_, **__):
        raise AssertionError("a list of rows became an RDD of Python")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    model = toxicity.fit(docs, labels)
    assert model.terms
