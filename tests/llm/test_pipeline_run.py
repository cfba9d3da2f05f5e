"""run() against the stages' rules, applied one document after the other."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import quality_cnn, secret_scan
from spanforge.sources.shared import clear, mark
from tests.llm.test_pipeline_shingles import shingles

SF = "/root/testdata/sf0.001"
UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def groups(texts: dict[int, str]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    return {i: min(j for j in group if group[j] == group[i]) for i in group}


def test_run_equals_the_rules_one_by_one(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    since = mark(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_cnn.classify(docs, labels).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert 0 < len(texts) <= docs.count()
    first = groups(texts)
    texts = {i: t for i, t in texts.items() if first[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {i for i, t in texts.items() for w in [item_words(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}
    assert dirty
    texts = {i: t for i, t in texts.items() if i not in dirty}
    kept = spark.createDataFrame(list(texts.items()), docs.select("doc_id", "text").schema)
    field = secret_scan.train(kept)
    masked = {}
    for i, t in texts.items():
        merged: list[tuple[int, int]] = []
        for a, b in sorted(starts(secret_scan.scan_texts(pa.array([t]), field)[0], t)):
            if merged and a < merged[-1][1]:
                a, b = merged[-1][0], max(b, merged.pop()[1])
            merged.append((a, b))
        masked[i] = t
        for a, b in reversed(merged):
            masked[i] = masked[i][:a] + corpus_pipeline.MASK + masked[i][b:]
    assert any(corpus_pipeline.MASK in t for t in masked.values())
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(",".join(map(str, encoding.encode_ordinary(t))).encode()).hexdigest() for i, t in masked.items()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want and got.where(~F.col("lossless")).isEmpty()
    clear(spark, since)


def starts(spans: list[tuple[int, int, int]], text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment, its value."""
    return [secret_scan.ASSIGN.match(text, a).span(2) if k == 0 else (a, b) for a, b, k in spans]


def test_columns_of_any_name(spark):
    """Columns that bear the stages' own names come through unchanged."""
    names = ["_score", "_found", "_masked", "_key", "_h", "_ids", "column1", "text_key"]
    docs = spark.createDataFrame([(i, f"some plain text number {i} with words", *[f"{n}{i}" for n in names]) for i in range(6)], ", ".join(["doc_id bigint", "text string", *[f"{n} string" for n in names]]))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == ["doc_id", "text", *names]
    assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names) and docs.count() >= 1
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()
