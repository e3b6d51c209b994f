import os

import pytest

import corpus_pipeline as P
from quern.llm import bpe, exact_dedup, mixing, order_minhash, toxicity
from quern.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = P.STAGES[0][1](spark, docs, SF)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    single = P.STAGES[1][1](spark, clean, SF)
    texts = {}
    for r in clean.collect():
        texts[r.text] = max(r.doc_id, texts.get(r.text, -1))
    assert {r.doc_id for r in single.collect()} == set(texts.values())
    near = P.STAGES[2][1](spark, single, SF)
    assert {r.doc_id for r in near.collect()} == {r.class_id for r in order_minhash.near_classes(single).collect()}
    mixed = P.STAGES[3][1](spark, near, SF)
    assert mixed.columns == docs.columns
    passes = {r.doc_id: len(r.slots) for r in mixing.mix(near).collect() if r.slots}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == passes
    last = P.STAGES[4][1](spark, mixed, SF)
    model = bpe.load(tokenizer_path())
    want = {r.doc_id: len(model.tok.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect()}
    assert {r.doc_id: r.n_tokens for r in last.collect()} == want
    assert exact_dedup.exact_dedup(mixed.limit(0)).count() == 0
