"""The quality stage keeps what the classifier predicts as good."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import quality_cnn


def test_stage_rejects_what_is_predicted_bad(spark, monkeypatch):
    scores = {1: 0.1, 2: 0.3, 3: 0.45, 4: 0.5, 5: 0.9}
    monkeypatch.setattr(quality_cnn, "train", lambda docs, labels: None)
    monkeypatch.setattr(quality_cnn, "score", lambda docs, net: docs.withColumn("_score", F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[F.col("doc_id").cast("int")]))
    docs = spark.createDataFrame([(i, f"text {i}") for i in scores], "doc_id bigint, text string")
    labels = "/root/testdata/sf0.001"
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, labels).collect()}
    assert kept == {r.doc_id for r in quality_cnn.classify(docs, docs).collect() if r.predicted} == {4, 5}
