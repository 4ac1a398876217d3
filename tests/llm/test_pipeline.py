"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import numpy as np
import public_tokenizers

import corpus_pipeline
from sigplane.llm import packing


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.agg({"length": "sum"}).first()[0] > counts[-1]


def test_the_last_stage_keeps_the_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = {1: "Some words, and more. " * 400, 2: "", 3: "one"}
    rows = corpus_pipeline.packed(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    for d, text in texts.items():
        ids = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == d)
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
