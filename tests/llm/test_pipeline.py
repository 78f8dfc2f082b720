"""The pipeline: each stage against its operator or brute force, on what the stage before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import classes, hits
from tidemark.llm import bpe, pii, quality_classifier
from tidemark.llm.tables import documents, hex256, table


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """The rows after each stage, the input first."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = documents(spark, sf), [documents(spark, sf).toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.toPandas())
    return out


def test_order_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]
    for df in kept[1:-1]:
        assert list(df.columns) == list(kept[0].columns)


def test_quality_stage(spark, sf, kept):
    want = quality_classifier.score(documents(spark, sf), table(spark, sf, "labels")).filter("predicted = 1")
    assert sorted(kept[1]["doc_id"]) == sorted(r.doc_id for r in want.collect())


def test_near_duplicate_stage(kept):
    docs = list(zip(kept[1]["doc_id"], kept[1]["text"]))
    assert sorted(kept[2]["doc_id"]) == sorted({c for *_, c in classes(docs)}) and len(kept[2]) < len(kept[1])


def test_benchmark_stage(spark, sf, kept):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    found = {d: hits(t, items) for d, t in zip(kept[2]["doc_id"], kept[2]["text"])}
    assert sorted(kept[3]["doc_id"]) == sorted(d for d, (n, hit, _) in found.items() if not hit or 20 * hit < n)


def test_personal_data_stage(kept):
    before = kept[3].set_index("doc_id")["text"]
    after = kept[4].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    for i, text in before.items():
        assert after["text"][i] == pii.mask(text) and after["n_chars"][i] == len(pii.mask(text))


def test_token_stage(kept):
    texts = kept[4].set_index("doc_id")["text"]
    own = bpe.codec(bpe.vocabulary_path())
    assert sorted(kept[5]["doc_id"]) == sorted(texts.index)
    for r in kept[5].itertuples():
        assert own.decode(list(r.ids)) == texts[r.doc_id] and r.decoded_sha256 == hex256(texts[r.doc_id].encode())


def test_run(spark, sf, kept):
    got = corpus_pipeline.run(spark, sf)
    assert got.select(F.count("*"), F.sum("n_tokens")).first() == (len(kept[5]), kept[5]["n_tokens"].sum())
