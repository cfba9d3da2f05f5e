"""The learned operators against slow references, other patterns and held-out formats."""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import exact_topk, quality_cnn, secret_scan
from tests.llm.data import words


def slow_logit(net: quality_cnn.Network, text: bytes) -> float:
    """One text, one position and one filter at a time."""
    step, half = quality_cnn.STRIDE, quality_cnn.HALF
    halves = (len(text) + step + half - 1) // half
    numbers = list(text) + [quality_cnn.PAD] * (halves * half - len(text))
    blocks = [np.concatenate([net.w["embed"][b] for b in numbers[i : i + step]]) for i in range(0, len(numbers), step)]
    best, each = [], half // step
    for h in range(halves):
        found = np.zeros(quality_cnn.FILTERS)
        for i in range(h * each, (h + 1) * each):
            if i + 1 < len(blocks):  # a filter spans two blocks; none begins in a text's last one
                found = np.maximum(found, blocks[i] @ net.w["filters"][0] + blocks[i + 1] @ net.w["filters"][1] + net.w["bias"])
        best.append(found)
    chunks = [np.max(best[h : h + 2], 0) for h in range(halves)]
    return float(np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.w["out"] + net.w["shift"][0] + net.prior)


SHAPES = {
    "glpat": lambda r: "glpat-" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(20)),
    "google": lambda r: "AIza" + "".join(r.choice(string.ascii_letters + string.digits + "_") for _ in range(35)),
    "jwt": lambda r: "eyJ" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(30)) + "." + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)),
    "bearer": lambda r: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32)),
}


def held_out_lines(n: int, seed: int = 77) -> tuple[list[str], list[tuple[int, int] | None]]:
    """Secrets in formats that training has not, after names that the base patterns lack, and lines without any."""
    rng = random.Random(seed)
    plain = lambda k: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 10))) for _ in range(k))
    texts, spans = [], []
    for i in range(n):
        value = list(SHAPES.values())[i % 4](rng)
        lead = f"{plain(6)} {rng.choice(['credential', 'auth', 'bearer'])}: "
        texts.append(f"{lead}{value} {plain(6)}")
        spans.append((len(lead), len(lead) + len(value)))
        other = rng.choice([str(rng.randrange(10**9)), f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02d}-11", f"https://{plain(1)}.example.org/{plain(1)}", plain(1).capitalize() * 2])
        texts.append(f"{plain(8)} {other} {plain(8)}")
        spans.append(None)
    return texts, spans


def test_added_spans_on_held_out_formats(spark):
    """Figures for README: recall of secrets that no base pattern finds, and the share of added spans that are secrets."""
    field = secret_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts, spans = held_out_lines(200)
    found = secret_scan.scan_texts(pa.array(texts), field)
    hit = [any(k == 3 and a < s[1] and b > s[0] for a, b, k in x) for x, s in zip(found, spans, strict=True) if s]
    added = [any(s and a < s[1] and b > s[0] for s in [s]) for x, s in zip(found, spans, strict=True) for a, b, k in x if k == 3]
    print(f"recall {np.mean(hit):.3f}, precision {np.mean(added):.3f}")
    assert np.mean(hit) >= 0.6 and np.mean(added) >= 0.9


def test_whole_gaps_and_long_names():
    """All that separates a token from the one before is seen, however long it is."""
    near, far = (secret_scan.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[3] for t in ("token=abcdef", "token  =          abcdef"))
    assert near[1, 4] == far[1, 4]
    long = f"{'x' * 60}_password = abcdef"
    assert secret_scan.tokens(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))[3][1, 4] == near[1, 4]


def test_base_patterns_by_hand():
    """Each kind found one character at a time."""

    def runs(text, inside, least):
        out, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in inside:
                j += 1
            if j - i >= least:
                out.append((i, j))
            i = max(j, i + 1)
        return out

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["AKIA", "QZ09", "deadbeef", "0123", " ", "é", "x-", "token", "=", '"']) for _ in range(30))
        hexes = [(a, b, 2) for a, b in runs(text, "0123456789abcdef", 16)]
        access, i = [], 0
        while (i := text.find("AKIA", i)) >= 0:
            j = i + 4
            while j < len(text) and text[j] in string.ascii_uppercase + string.digits:
                j += 1
            if j - i >= 5:
                access += [(i, j, 1)] * (j - i >= 18)
                i = j
            else:
                i += 1
        got = secret_scan.base_spans(text)
        assert [s for s in got if s[2] == 2] == hexes and [s for s in got if s[2] == 1] == access


def test_topk_of_repeated_query_ids(spark):
    """A query id with two vectors has a result for each; clustered vectors, so that cells are eliminated."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 6, (6, 12))
    v = np.repeat(centres, 60, 0) + rng.normal(0, 0.3, (360, 12))
    rows = [(i, v[i].tolist()) for i in range(360)] + [(50, v[200].tolist()), (100, v[100].tolist())]
    got = exact_topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)).collect()
    whole = [(i, np.floor(256 * np.array(x))) for i, x in rows]
    want = []
    for q, x in {(i, tuple(y)) for i, y in whole if i % 50 == 0}:
        scores = sorted(((-int(np.dot(x, y)), i) for i, y in whole if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.query_id == 50 for r in got) == 10


def test_a_long_text_is_learned_from_and_scored(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, words(rng, 4000 if i % 2 else 50)) for i in range(40)] + [(41, "good text " * 400_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    net = quality_cnn.train(docs, labels)
    found = {r.doc_id: r._score for r in quality_cnn.score(docs, net).collect()}
    assert len(found) == 41 and all(0 <= x <= 1 for x in found.values())
    again = quality_cnn.train(docs.repartition(7), labels)
    assert all(np.array_equal(net.w[k], again.w[k]) for k in net.w)


@pytest.mark.parametrize("size", [0, 1, 3, 255, 256, 600, 1500])
def test_scores_equal_a_slow_reference(size):
    rng = np.random.default_rng(size)
    net = quality_cnn.Network()
    for w in net.w.values():
        w += rng.normal(0, 0.2, w.shape).astype(np.float32)
    text = bytes(rng.integers(32, 127, size).astype(np.uint8))
    data = np.frombuffer(text, np.uint8)
    assert net.logits(data, np.array([0, size]))[0] == pytest.approx(slow_logit(net, text), abs=1e-3)
