"""Texts of several megabytes, longer than what a task works on at a time."""

from __future__ import annotations

import hashlib
import random

import pytest

from spanforge.llm import byte_bpe, decontaminate, near_dedup, secret_scan, sharding
from tests.llm.data import words

SECRET = "token = 0641917ea4e9feb9cda83477b57ac265"


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(12)
    item = words(rng, 14, 10**6)
    text = words(rng, 400_000, 10**6)
    other = text.split()
    other[1000] = "changed"
    rows = [(1, f"{text} {SECRET}"), (2, f"{' '.join(other)} {item}"), (3, item), (4, None), (5, "x" * (3 << 20))]
    assert len(text) > 2 << 20
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rows, item


def test_decontaminate(spark, long):
    docs, rows, item = long
    got = {r.doc_id: r for r in decontaminate.report(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()}
    assert [got[i].n_hit for i in range(1, 6)] == [0, 14, 14, 0, 0] and got[2].n_words == 400_014 and got[5].n_words == 1


def test_secrets(long):
    docs, rows, _ = long
    got = {r.doc_id: r for r in secret_scan.digest(docs).collect()}
    at = len(rows[0][1]) - len(SECRET)
    assert f"assign:{at}:{len(rows[0][1])}" in got[1].spans and (got[1].n_assign, got[1].n_hex, got[2].n_assign) == (1, 1, 0) and got[4].spans == ""


def test_shards(long):
    docs, rows, _ = long
    got = {r.doc_id: r for r in sharding.interleave(docs.selectExpr("*", "'s' AS source")).collect()}
    assert all(got[i].size == len((t or "").encode()) + 1 for i, t in rows)


def test_near_copies(long):
    docs, _, _ = long
    got = {r.doc_id: r.component_id for r in near_dedup.link(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_encoding(long):
    docs, rows, _ = long
    got = {r.doc_id: r for r in byte_bpe.digest(docs).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows) and got[1].n_tokens > 400_000
