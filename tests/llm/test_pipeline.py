import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from fallline.llm import byte_bpe, importance, jaccard_join, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_run_equals_the_stages_by_hand(spark):
    rows = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id for r in quality_rules.judge(documents, quality_rules.train(documents, labels)).filter("kept").collect()}
    left = documents.filter(documents.doc_id.isin(list(verdict)))
    drawn = {r.doc_id for r in importance.resample(left, labels).filter("kept").collect()}
    left = left.filter(left.doc_id.isin(list(drawn)))
    first = {r.doc for r in jaccard_join.jaccard_classes(left).filter("doc = component_id").collect()}
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = {r.doc_id: enc.encode_ordinary(r.text) for r in left.collect() if r.doc_id in first and not any(i in f" {' '.join(words(r.text))} " for i in items)}
    assert rows == expected


def test_stages(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    if os.path.isdir(SF):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs.limit(0), SF).columns == docs.columns
