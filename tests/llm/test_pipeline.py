"""The pipeline's stages against brute force, and the queries against their SQL."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from spanforge.llm import registry
from tests.harness import check
from tests.llm.data import empty, hard
from tests.llm.test_pipeline_shingles import shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    check(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas().set_index("doc_id")
    columns = docs.columns
    seen = [set(before.index)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        now = docs.toPandas()
        assert set(now.doc_id) <= seen[-1] and now.doc_id.is_unique
        seen.append(set(now.doc_id))
        if i == 1:  # no two documents that are left are near copies
            sets = {r.doc_id: shingles(r.text) for r in now.itertuples()}
            ids = sorted(sets)
            assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
        if i == 3:
            assert not now.text.str.contains(r"(?:token|password)\s*[:=]\s*\"?[0-9a-f]{16}").any()
            changed = [r for r in now.itertuples() if r.text != before.text[r.doc_id]]
            assert all(corpus_pipeline.MASK in r.text and r.n_chars == len(r.text) for r in changed)
        if i == 4:
            assert now.lossless.all() and (now.n_tokens == now.ids.map(len)).all()
    assert len(seen[1]) > 0.6 * len(seen[0]) and all(len(b) > 0.6 * len(a) for a, b in zip(seen, seen[1:], strict=False))


def test_hard_rows(spark, tmp_path):
    docs = hard(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.columns == hard(spark).columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
