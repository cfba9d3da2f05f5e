"""Repeats under hot groups and colliding hashes: only symbols decide."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.data import words


def hot_texts() -> list[str]:
    """A passage in all texts, between different words; some copies have other white space."""
    rng = random.Random(8)
    passage = words(rng, 60, 10**6)
    out = [f"{words(rng, rng.randrange(45), 10**6)} {passage} {words(rng, rng.randrange(45), 10**6)}" for _ in range(60)]
    return [t.replace(" ", "\n ") if i % 5 == 0 else t for i, t in enumerate(out)] + ["short", "", out[3], " ".join(["same"] * 300)]


def by_words(texts: list[str]) -> dict[int, tuple[int, str]]:
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = {}
    for n, w in enumerate(split):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out[n] = len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return out


def by_bytes(texts: list[str]) -> dict[int, tuple[int, str]]:
    seen, out = set(), {}
    for n, t in enumerate(texts):
        b, gone = t.encode(), set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(b[i : i + 100])
        out[n] = len(gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()
    return out


@pytest.mark.parametrize("buckets", [None, 3])
@pytest.mark.parametrize("group", [8, 40, repeats.GROUP])
def test_hot_groups(spark, monkeypatch, buckets, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    if buckets:  # groups are made by three hashes only: different prefixes meet, and nothing else may follow from it
        plain = repeats.anchors

        def colliding(*args, **more):
            from pyspark.sql import functions as F

            return plain(*args, **more).withColumn("ctx", F.xxhash64("hash", "ctx")).withColumn("hash", F.when(F.col("known"), F.col("hash")).otherwise(F.pmod("hash", F.lit(buckets))))

        monkeypatch.setattr(repeats, "anchors", colliding)
    texts = hot_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs, text=False).collect()}
    assert got == by_words(texts) and sum(x[0] > 0 for x in got.values()) == 62
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(docs, text=False).collect()}
    assert got == by_bytes(texts) and sum(x[0] > 0 for x in got.values()) >= 60


def test_words_are_compared_as_words():
    import pyarrow as pa

    numbers, ends = repeats.Words.numbers(pa.array([b"a b  a", b"b\na", b""]))
    assert numbers.tolist() == [0, 1, 0, 1, 0] and ends.tolist() == [0, 3, 5, 5]
    data, starts, stops, first = repeats.Words.spans(pa.array(["a bc", None, "d"]))
    assert [bytes(data[x:y]) for x, y in zip(starts, stops, strict=True)] == [b"a", b"bc", b"d"] and first.tolist() == [0, 2, 2, 3]
    assert np.array_equal(repeats.Bytes.numbers(pa.array([b"ab", b"c"]))[1], [0, 2, 3])


def test_a_text_of_several_megabytes(spark):
    rng = random.Random(2)
    part = words(rng, 40_000, 10**7)
    big = f"{part} {words(rng, 200_000, 10**7)} {part}"
    assert len(big) > 2 << 20
    docs = spark.createDataFrame([(1, big), (2, part), (3, "clean words only")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup(docs, text=False).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [80_000, 40_000, 0]
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, text=False).collect()}
    assert got[2].n_removed == got[2].n_bytes == len(part) and got[3].n_removed == 0 and got[1].n_removed == len(part) and got[1].n_spans == 1
