"""The near-dedup stage against brute force on shingles of five words."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.data import DOC, hard_rows, words


def shingles(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_near_duplicates_of_five_words_only(spark):
    rng = random.Random(4)
    texts = [r[1] for r in hard_rows() if r[1] is None or r[1].isascii()]
    base = words(rng, 400, 5000).split()
    texts += [" ".join(base), " ".join(f"other{i}" if i % 20 == 10 else w for i, w in enumerate(base)), " ".join(f"once{i}" if i == 200 else w for i, w in enumerate(base))]
    texts += ["just four short words", "JUST four short words", "just four short w0rds"]
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(i for i in range(len(texts)) if group[i] == g) for g in group}
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, "x", "y") for i, t in enumerate(texts)], DOC).repartition(5)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    n = len(texts)
    assert got == want and {n - 6, n - 5, n - 3, n - 1} <= got and not {n - 4, n - 2} & got
