from collections import defaultdict

import corpus_pipeline as pipeline
import pytest

from tests.llm.test_near_dedup import plain_staying
from wayfold.llm import langid, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return [*out, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_filters_follow_their_models(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r["doc_id"], quality.features((r["text"] or "").encode())) for r in stages[0].collect()]
    assert ids(stages[1]) == sorted(i for i, x in rows if model.score(__import__("numpy").array([x]))[0] >= 0.7)
    model = langid.train(stages[1])
    found = [(r["doc_id"], model.predict(r["text"])) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted(i for i, (lang, s, _) in found if lang != "und" and s >= 0.5)


def test_copies(stages):
    top = defaultdict(int)
    for r in stages[2].collect():
        top[r["text"]] = max(top[r["text"]], r["doc_id"])
    assert ids(stages[3]) == sorted(top.values())
    assert ids(stages[4]) == plain_staying([(r["doc_id"], r["text"]) for r in stages[3].collect()])


def test_packing_holds_every_document(stages):
    assert sorted({r["doc_id"] for r in stages[5].collect()}) == ids(stages[4])


def test_empty_documents(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
