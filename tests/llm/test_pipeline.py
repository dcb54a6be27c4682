"""The pipeline: its stages on their own inputs, and all of them together."""

import pytest

from helpers import empty, table

op5_simhash = pytest.importorskip("strandwise.llm.op5_simhash")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_rows_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows
        assert all(r == before[r.doc_id] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == docs.count()


def test_run_is_the_stages(spark, sf_dir):
    a = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert a == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_rows(spark, sf_dir, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = table(spark)
    assert stage(spark, docs, sf_dir).count() <= 4 * docs.count()
    assert stage(spark, empty(spark), sf_dir).count() == 0


def test_near_dedup_compares_by_the_covering(spark, sf_dir, monkeypatch):
    met = []
    monkeypatch.setattr(op5_simhash, "near_links", lambda reps, bits, real=op5_simhash.near_links: met.append((reps.count(), bits)) or real(reps, bits))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    corpus_pipeline.near_dedup(spark, docs, sf_dir).count()
    assert met == [(len({op5_simhash.fingerprint(r.text, 5) for r in docs.collect()}), 2)]
