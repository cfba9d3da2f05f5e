"""What the pipeline's stages hold: no shuffled texts in the decontamination, nothing of the encoding in workers that other operators use next."""

from __future__ import annotations

import gc
import re
import weakref
from types import SimpleNamespace

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from spanforge.llm import byte_bpe, quality_cnn
from tests.llm.data import DOC

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.mark.parametrize("few", [500_000, 2])
def test_decontamination(spark, tmp_path, monkeypatch, few):
    """Contaminated documents are dropped whether they are broadcast or too many for that; a broadcast needs no shuffle of texts."""
    spark.createDataFrame([(1, ITEM), (2, "only three words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [None, "", ITEM, f"x {ITEM.upper()} y", ITEM.rsplit(" ", 2)[0], "only three words, and more", ITEM.replace("zeta", "zet")]
    ids = [*range(len(texts)), None, None, 0]
    rows = [(i, t, "en", "s", None, 0.5, "x", "y") for i, t in zip(ids, [*texts, ITEM, "kept", ITEM], strict=True)]
    monkeypatch.setattr(corpus_pipeline, "FEW", few, raising=False)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/docs")
        left = corpus_pipeline.decontaminated(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
        assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(0, None), (1, ""), (4, texts[4]), (6, texts[6]), (None, "kept")]))
        shuffles = re.findall(r"Exchange hashpartitioning", left._jdf.queryExecution().executedPlan().toString())
        assert bool(shuffles) == (few == 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_other_operators_let_go_what_encoding_keeps():
    """A worker that encoded holds its codec for the next encoding task only."""
    sent = byte_bpe.Codec({bytes([i]): i for i in range(256)}, r"\S+|\s+")
    gone = weakref.ref(sent)
    assert byte_bpe._mine(sent.name, SimpleNamespace(value=sent)) is byte_bpe._mine(sent.name, None) is sent
    del sent
    docs = SimpleNamespace(schema=T.StructType(), drop=lambda *a: docs, mapInArrow=lambda run, kind: run)
    assert list(quality_cnn.score(docs, quality_cnn.Network())(iter([]))) == []
    gc.collect()
    assert gone() is None
