"""What a worker keeps of pre-tokens is bounded in bytes, within a text too, and changes no result."""

from __future__ import annotations

import random
from sys import getsizeof

import public_tokenizers
import pyarrow as pa
import pytest

from spanforge.llm import byte_bpe
from tests.llm.data import DOC, hard_rows


def held(codec: byte_bpe.Codec) -> int:
    """Bytes of the recent results of a codec."""
    total = 0
    for found in (codec.recent, codec.recent._old):
        for key, value in found.items():
            total += getsizeof(key) + getsizeof(value) + sum(getsizeof(v) for v in value if isinstance(value, tuple)) + 100
    return total


@pytest.fixture
def codec():
    return byte_bpe.Codec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_many_words_of_one_text(codec):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(600_000))
    assert codec.digest(text)[0] > 600_000
    assert held(codec) <= 2 * byte_bpe.KEEP


def test_long_pre_tokens(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEEP", 4 << 20)
    for i in range(60):
        codec.digest(chr(97 + i % 26) * (10_000 if i % 2 else 100_000) + "z" * i)
    assert 1 << 19 < held(codec) <= 8 << 20
    assert max(map(len, codec.recent)) < 20_000


def test_results_depend_on_nothing_kept(spark, monkeypatch):
    docs = spark.createDataFrame(hard_rows(), DOC).repartition(3)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.Codec.load(path, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "KEEP", 20_000)
    texts = [r[1] or "" for r in hard_rows()] * 3
    few = [(own.encode(t).tolist(), own.digest(t)) for t in texts]
    assert held(own) <= 40_000
    monkeypatch.setattr(byte_bpe, "KEEP", 0)
    none = byte_bpe.Codec.load(path, public_tokenizers.PATTERN)
    assert [(none.encode(t).tolist(), none.digest(t)) for t in texts] == few and held(none) == 0
    assert sorted(map(str, (r._ids for r in byte_bpe.tokenize(docs).collect()))) == sorted(str(i) for i, _ in few[: len(texts) // 3])


def test_vocabularies_that_differ_within_are_told_apart(spark):
    """Same pattern, number of keys, first and last key: each is used for its own call."""
    docs = spark.createDataFrame([(1, "abba")], "doc_id bigint, text string")
    one = {bytes([i]): i for i in range(256)}
    two = one | {b"b": one[b"c"], b"c": one[b"b"]}
    got = [byte_bpe.tokenize(docs, byte_bpe.Codec(ranks, public_tokenizers.PATTERN)).first()._ids for ranks in (one, two, one)]
    assert got == [[97, 98, 98, 97], [97, 99, 99, 97], [97, 98, 98, 97]]


def test_type_of_ids(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r._ids for r in byte_bpe.tokenize(docs).collect()] == [[], []]
    codec = byte_bpe.codec()
    assert pa.array(codec.encode("one two")).type == pa.int32()
