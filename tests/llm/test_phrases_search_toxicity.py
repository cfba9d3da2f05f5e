"""Collocations and ranked search against brute force, toxicity by held-out accuracy; nulls, empty and long texts, ties, repeated rows, empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanforge.llm import collocations, lexical_search, toxicity
from spanforge.llm.common import table
from tests.llm.data import DOC, empty, hard, hard_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é😀", "\x00z", "\x1cq"]
    texts = [None, "", " \t ", ".,;", "x" * 5000, "New York\tcity, new york city. NEW YORK! york\x0bnew"] * 3
    for _ in range(60):
        words = [rng.choice(vocabulary[: rng.choice((3, 6, 15))]) for _ in range(rng.randrange(1, 60))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for w in words))
    rows = [(i, t, ("en", "fr", None, "und")[i % 4], "s", None, 0.5, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, texts[21], "en", None, None, None, None, None)]


def mined(rows: list[tuple], least: int, top: int) -> set[tuple]:
    by: dict[str, list[list[str]]] = defaultdict(list)
    for row in rows:
        by[row[2] or "und"] += [p for x in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(LOWER)) if (p := [w for w in re.split(r"[\x20\x09]+", x) if w])]
    out = set()
    for lang, parts in by.items():
        f = Counter(tuple(p[i : i + k]) for p in parts for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(len(p) for p in parts)
        rank = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(c >= least and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in f.items() if len(q) == 3):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rank.append((-s, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top])}
    return out


@pytest.mark.parametrize("words, pairs", [(10**6, 10**6), (0, 10**6), (10**6, 0)])
def test_collocations(spark, monkeypatch, words, pairs):
    monkeypatch.setattr(collocations, "WORDS", words)
    monkeypatch.setattr(collocations, "PAIRS", pairs)
    monkeypatch.setattr(collocations, "PIECE", 40)  # texts are split into words by many pieces
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(6)
    for least, top in ((4, 30), (10, 2000)):
        got = [tuple(r) for r in collocations.top(collocations.phrases(docs, least), top).collect()]
        assert len(got) == len(set(got)) and set(got) == mined(rows, least, top), (least, len(got))
    assert len(got) > 10


def test_collocations_of_nothing(spark):
    assert collocations.top(collocations.phrases(empty(spark))).count() == 0


@pytest.mark.parametrize("split", [1 << 27, 100_000])
def test_tiles_add_up(spark, monkeypatch, split):
    """Dense and sparse tiles, whole or in parts, against a plain count."""
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 3000, 300_000) ** 3 // 9_000_000, rng.integers(0, 3000, 300_000) ** 3 // 9_000_000
    want = Counter(zip(i.tolist(), j.tolist(), strict=True))
    ids = np.stack([i, j, np.full(len(i), -1)], 1).reshape(-1, 3000)
    texts = spark.createDataFrame([("en", x.tolist()) for x in ids], "lang string, ids array<int>").repartition(4)
    monkeypatch.setattr(collocations, "HELD", 200_000)
    monkeypatch.setattr(collocations, "SPLIT", split)
    for least in (3, 1):
        got = [((r["i"], r["j"]), r["n"]) for r in collocations.tile_counts(texts, collocations.neighbours, least, 400_000).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {k: n for k, n in want.items() if n >= least}
    dense = list(collocations.counted(np.repeat([1, 2, 3], 40_000), np.repeat([5, 5, 6], 40_000)))
    assert [(t[:2], *(x.tolist() for x in t[2:])) for t in dense] == [((0, 0), [1, 2, 3], [5, 5, 6], [40_000] * 3)]
    assert collocations.bands(np.array([0, 1023, 1024, 2047, 2048, 4096, 1 << 30])).tolist() == [0, 0, 1, 1, 2, 3, 21]


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_007)], "a bigint, l bigint, r bigint")
    a, left, r = row.first()
    assert row.select(collocations._score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * r)


def ranked(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d[0], Counter(w)) for d in docs if (w := words(d[1]))]
    total, length = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = set()
    for item, text in set(items):
        scores = []
        for doc, c in held:
            m = 75 + 25 * c.total() * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out |= {(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


ITEMS = [(0, "w1x w2x w2x W3X"), (1, hard_rows()[9][1]), (2, ""), (3, None), (None, "und one"), (4, "one"), (4, "one"), (5, "nowhere-to-be-found é 😀 naïve"), (6, "w1x " * 300 + hard_rows()[8][1])]


@pytest.mark.parametrize("k, block, most, piece", [(20, 2_000_000, 500_000, 4 << 20), (3, 50, 40, 30), (1, 500, 500_000, 7)])
def test_search(spark, monkeypatch, k, block, most, piece):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = [tuple(r) for r in lexical_search.search(hard(spark), items, k, most).collect()]
    want = ranked(hard_rows(), ITEMS, k)
    # rows of one item with equal scores and ids are interchangeable
    assert Counter((r[0], r[2], r[3]) for r in got) >= Counter((r[0], r[2], r[3]) for r in want) and {(r[0], r[1], r[3]) for r in got} == {(r[0], r[1], r[3]) for r in want}


def test_search_in_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(hard(spark), items.limit(0)).count() == 0


def test_search_stops_early_and_loses_nothing():
    rng = np.random.default_rng(3)
    n = 20_000
    term = np.repeat(np.arange(3), n)
    doc = np.concatenate([rng.permutation(n) for _ in range(3)])
    impact = (rng.pareto(1.5, 3 * n) * 1000).astype(np.int64) + 1
    block = lexical_search.Block(term, doc, impact)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    docs, scores = block.best([(0, 1), (1, 1), (2, 1)], 20, 0)
    want = np.lexsort((np.arange(n), -total))[:20]
    order = np.lexsort((docs, -scores))[:20]
    assert docs[order].tolist() == want.tolist() and scores[order].tolist() == total[want].tolist()
    assert block.best([(0, 1), (9, 1)], 5, 10**9)[0].size == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert bad.predicted.mean() > 0.75 and good.predicted.mean() < 0.03
    ranks = rows.score.rank()
    assert (ranks[rows.toxic == 1].mean() - (len(bad) + 1) / 2) / len(good) > 0.93


def test_toxicity_hard_cases(spark):
    sf = "/root/testdata/sf0.001"
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    docs = spark.createDataFrame([*hard_rows(), (77, "idiot moron " * 20_000, None, None, None, None, None, None)], DOC)
    got = toxicity.score(docs.withColumnRenamed("score", "_score"), model).select("doc_id", "text", "_score").collect()
    assert len(got) == docs.count() and all(0 <= r["_score"] <= 1 for r in got)
    assert len({r["_score"] for r in got if not r["text"]}) == 1
    assert toxicity.score(empty(spark), model).count() == 0
    pair = model.compressors()
    for r in got[:20]:  # the score by its definition
        text = (r["text"] or "").encode().lower()
        saved = [len(pair[1].compress(toxicity.STUB + text[a : a + 56])) - len(pair[0].compress(toxicity.STUB + text[a : a + 56])) for a in range(0, len(text), 56)]
        z = toxicity.features(np.array([sum(s >= model.threshold for s in saved)]), np.array([len(saved)])) @ model.weights + model.bias
        assert abs(r["_score"] - 1 / (1 + math.exp(-z[0]))) < 1e-9
    one = table(spark, sf, "labels").where("toxic = 0")
    assert {round(r["score"], 6) < 0.5 for r in toxicity.classify(hard(spark), one).collect()} == {True}
    assert {r["score"] for r in toxicity.classify(hard(spark), one.limit(0)).collect()} == {0.5}


def test_toxic_passages_by_slow_rule():
    text = b"you clown! what a clown, clownish"
    known = np.unique(toxicity.grams(b" clown"))
    assert toxicity.passages(text, known, np.array([9])) == {b" clown"}
    assert toxicity.passages(b"abc", known, np.array([9])) == set()
    assert toxicity.filled([(5, b" clown"), (9, b"fool "), (2, b"rare")], 3) == b" clownfool " + toxicity.STUB
