"""Words and passages that collide under sums of powers, and crowded bands: nothing is linked or removed but by its content."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanforge.llm import kernels, near_dedup, substring_dedup, suffix_dedup
from tests.llm.test_operators import LOWER, space_words


def thue_morse(n: int) -> tuple[str, str]:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_words_are_told_apart(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")
    assert sorted(tuple(r)[:4] for r in near_dedup.link(docs).collect()) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]
    tail = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id bigint, text string")
    assert {r["n_removed"] for r in substring_dedup.dedup(docs, text=False).collect()} == {0}
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{a}\n{tail}")], "doc_id bigint, text string")
    assert {r["n_removed"] for r in substring_dedup.dedup(docs, text=False).collect()} == {35}


def test_thue_morse_bytes_are_told_apart(spark):
    """With windows so long that the words fit, sums of powers would call the contexts equal."""
    a, b = thue_morse(2048)
    docs = spark.createDataFrame([(1, f"{a}x"), (2, f"{b}x"), (3, f"{a}x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(docs, window=2049, text=False).collect()}
    assert got == {1: 0, 2: 0, 3: 2049}


def test_spans_of_all_lengths_hash_by_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 3000)
    ends = starts + rng.integers(0, 100, 3000)
    hashes = kernels.span_hash(data, starts, ends)
    held: dict[bytes, int] = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist(), strict=True):
        assert held.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(held.values())) == len(held)


def crowd(seed: int) -> list[tuple[int, str]]:
    """Texts of one template, which fills most bands of all, with some truly near pairs and one large group of near copies."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(70):
        own = [f"o{i}x{j}" for j in range(rng.randrange(14, 30))]
        texts.append(template + own)
        if i % 7 == 0:
            texts.append(template + own[:-1] + [f"z{i}"])
    for i in range(60):
        copy = template + [f"g{j}" for j in range(25)]
        copy[rng.randrange(60)] = f"edit{i}"
        texts.append(copy)
    rng.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


@pytest.mark.parametrize("few", [0, 16, 10**6])
def test_crowded_bands_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    rows = crowd(4)
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, t in rows for w in [space_words(t.translate(LOWER))]}
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.link(docs).collect()} == label
    assert len(set(label.values())) < len(label) - 50
