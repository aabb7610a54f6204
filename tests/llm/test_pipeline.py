"""The pipeline against its parts on a small table."""

import os

import corpus_pipeline
from pixelloom.llm import sentencepiece_chunks


def test_stages_in_order_and_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        import pytest

        pytest.skip("test tables are not here")
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    names = rows.columns
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        rows = step(spark, rows, sf)
        path = str(tmp_path / f"s{k}")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        assert (rows.columns == names) == (k < len(corpus_pipeline.STAGES) - 1)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))
    assert set(whole.columns) == set(sentencepiece_chunks.digests(sentencepiece_chunks.encode_documents(spark.read.parquet(f"{sf}/documents.parquet").limit(1), decode=True)).columns)


def test_stages_take_empty_tables_and_nulls(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None)]):
        rows = spark.createDataFrame(data, schema)
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, rows, sf)
            assert out.count() <= len(data)
