"""The corpus pipeline against the plain versions, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from playlake.llm import langid
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = langid.fit_model(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = {d for d, t in texts.items() if not model.predict(t)[2]}
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [(d, texts[d]) for d in sorted(expected)]
        if at == 1:
            expected = {max(before[i][0] for i in g) for g in brute.equal_groups(before).values()}
        elif at == 2:
            expected = {c for _, c in brute.classes(before).values()}
        elif at == 3:
            expected = {d for d, v in brute.contamination(before, items).items() if not v[4]}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == expected
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().collect()} == expected
