"""Each operator against brute force on the hard cases, and on empty tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanforge.llm import byte_bpe, decontaminate, exact_topk, html_extract, near_dedup, quality_cnn, secret_scan, sharding, substring_dedup, suffix_dedup
from spanforge.llm import repeats
from tests.llm.data import empty, hard, hard_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
bag = lambda rows: Counter(map(tuple, rows))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_decontaminate(spark):
    docs = hard_rows()
    items = [(1, " ".join(docs[20][1].split()[35:60])), (1, docs[9][1]), (2, "TWO words"), (3, None), (4, ""), (None, docs[9][1]), (12, "w1x"), (5, " ".join(docs[21][1].upper().split()[31:41]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            for a in range(max(1, len(w) - 9)):
                wins[tuple(w[a : a + 10])].add(i)
    want = []
    for d in docs:
        w, hit, found = cut(d[1]), set(), set()
        for size in {len(x) for x in wins}:
            for a in range(len(w) - size + 1):
                got = wins.get(tuple(w[a : a + size]))
                if got:
                    found |= got
                    hit |= set(range(a, a + size))
        want.append((d[0], len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    assert bag(decontaminate.report(hard(spark), bench).drop("_dc_key").collect()) == bag(want)
    assert sum(x[5] for x in want) > 10
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert {r.contaminated for r in decontaminate.report(hard(spark), bench.limit(0)).collect()} == {False}


def test_decontaminate_without_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(1, hard_rows()[9][1])], "item_id bigint, text string")
    want = bag(decontaminate.report(hard(spark), bench).collect())
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert bag(decontaminate.report(hard(spark), bench).collect()) == want


def test_secret_base_patterns(spark):
    docs = hard_rows()
    want = []
    for d in docs:
        t, spans = d[1] or "", []
        for k, p, least in ((0, secret_scan.ASSIGN, 12), (1, secret_scan.ACCESS, 18), (2, re.compile("[0-9a-f]+"), 16)):
            spans += [(m.start(), k, m.end()) for m in p.finditer(t) if len(m[2] if k == 0 else m[0]) >= least]
        n = Counter(k for _, k, _ in spans)
        want.append((d[0], n[0], n[1], n[2], sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    got = secret_scan.digest(hard(spark)).collect()
    assert bag(r[:5] for r in got) == bag(want)
    assert secret_scan.digest(empty(spark)).count() == 0


def test_secret_field_finds_formats_the_patterns_lack(spark):
    field = secret_scan.train(hard(spark))
    import pyarrow as pa

    texts = ["please use ghp_A8dk2KslQ9zmXW3pTr7YbNc5VuE1oIhGfJ4t in the header", "client_secret: Zx9Kq2LmV7bTr5PwYc8N for the app", "the quick brown fox, and it was there on the day"]
    found = secret_scan.scan_texts(pa.array(texts), field)
    assert found[0] and found[1] and not found[2]


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    field = secret_scan.Field(rng.normal(0, 1.5, (secret_scan.OFFSETS[-1], 3)) + np.array([0, 0, 4.0]), rng.normal(0, 1, (3, 3)))
    feats = np.stack([rng.integers(a, b, 400) for a, b in zip(secret_scan.OFFSETS[:-1], secret_scan.OFFSETS[1:], strict=True)], 1)
    first = np.array([0, 0, 37, 200, 400])
    got = field.tags(feats, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        score = field.emit[feats[a:b]].sum(1)
        best, back = None, []
        for t in range(b - a):
            best = field.move[2] + score[t] if t == 0 else (lambda p: (back.append(p.argmax(0)), p.max(0))[1])(best[:, None] + field.move) + score[t]
        if b > a:
            tag = [int((best + field.move[:, 2]).argmax())]
            for p in reversed(back):
                tag.append(int(p[tag[-1]]))
            assert got[a:b].tolist() == tag[::-1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>First  <i>line</i><br>more&nbsp;text.<p>Second &#233; line</p><ul><li>x<li>y</ul><div class="comments"><p>Reader says</p></div><form><input>Sign up</form></article><aside>Side</aside><footer>&copy; F</footer></body></html>"""


def test_html(spark):
    plain = "<div id='menu'>Home</div><p>" + "long text " * 30 + "</p><p>Short.</p><p>" + "more of it " * 30 + "</p><div class='sidebar'><p>Aside</p></div>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only"), (5, "u", plain), (5, "u", plain), (6, "u", "<nav>x</nav>")]
    got = sorted(map(tuple, html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()), key=lambda r: r[0])
    assert got[0][2] == "A & B\nFirst line more text.\nSecond é line\nx\ny"
    assert [r[2] for r in got[1:4]] == ["", "", "only"]
    assert got[4][2].split("\n")[1] == "Short." and got[4] == got[5] and got[6][2] == ""
    assert all(r[3] == len(r[2]) for r in got)


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 4)
    rows = sharding.interleave(hard(spark)).collect()
    docs = hard_rows()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == bag((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    share = Counter(r.source for r in rows)
    for i in range(16):
        for source, n in Counter(r.source for r in rows if r.shard == i).items():
            assert abs(n - share[source] / 16) < 2
    assert sharding.interleave(empty(spark)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4 + 0.01]) for i in range(160)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (250, [0.5] * 6), (250, [0.5] * 6), (None, [1.0]), (300, []), (7, [9.0] * 6)]
    got = exact_topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    whole = [(i, [float(np.floor(np.float32(x) * np.float64(256))) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        scores = sorted((-int(sum(a * b for a, b in zip(qv, v, strict=False))), i) for i, v in whole if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert bag(got) == bag(want)
    assert exact_topk.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_quality(spark):
    rows = [(i, ("of the " * 40 if i % 3 else "### %%% " * 40) + str(i)) for i in range(240)] + [(500, None), (501, ""), (None, "of the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_cnn.classify(docs, labels).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in range(240) if got[i].held_out]) > 0.95
    assert got[4].held_out == (zlib.crc32(b"4") % 3 == 1)
    assert quality_cnn.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_network_gradients():
    net = quality_cnn.Network()
    rng = np.random.default_rng(0)
    texts, labels = [rng.integers(97, 110, n).astype(np.uint8) for n in (3, 700, 1100)], np.array([0.0, 1, 1])

    def loss():
        data = np.concatenate(texts)
        z = net.logits(data, np.cumsum([0] + [len(t) for t in texts]))
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    g = net.gradients(texts, labels)
    for key, at in (("filters", (0, 5, 3)), ("filters", (1, 7, 9)), ("embed", (100, 2)), ("out", (4,)), ("out", (40,)), ("bias", (6,))):
        old = net.w[key][at]
        net.w[key][at] = old + 1e-2
        up = loss()
        net.w[key][at] = old - 1e-2
        down = loss()
        net.w[key][at] = old
        assert abs((up - down) / 2e-2 - g[key][at]) < 2e-3 + 0.1 * abs(g[key][at])


def test_near_dedup(spark):
    docs = hard_rows()
    sets = []
    for d in docs:
        w = space_words((d[1] or "").translate(LOWER))
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) != 1 else frozenset(w))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    want = bag((d[0], len(s), least[g] if s else d[0], (least[g] if s else d[0]) == d[0]) for d, s, g in zip(docs, sets, group, strict=True))
    assert bag(near_dedup.link(hard(spark)).drop("text_key").collect()) == want
    assert near_dedup.link(empty(spark)).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 1 << 62, 400).astype(np.uint64), rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for keep in (400, 380, 360):
        both = [np.sort(one), np.sort(np.concatenate([one[:keep], two[keep:]]))]
        found = near_dedup.samples(np.concatenate(both), np.array([0, 400, 800]))
        odd = near_dedup.odd_sketches(found)
        bits = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64))
        assert bits <= near_dedup._limit(round(100 * keep / (800 - keep)))


def test_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = hard_rows()
    got = byte_bpe.digest(hard(spark)).collect()
    want = []
    for d in docs:
        ids = enc.encode_ordinary(d[1] or "")
        want.append((d[0], len(ids), sha(",".join(map(str, ids))), sha(d[1] or "")))
    assert bag(got) == bag(want)
    out = byte_bpe.tokenize(hard(spark)).collect()
    assert all(bytes(r._decoded) == (r.text or "").encode() and r._ids == enc.encode_ordinary(r.text or "") for r in out)
    assert byte_bpe.digest(empty(spark)).count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    found = byte_bpe.PerfectHash(keys)
    assert [found.find(k) for k in keys] == list(range(5000)) and found.n == 5000 and found.find(b"x") == -1


def once(docs):
    """Distinct documents in the operators' order."""
    return sorted({((d[0] is not None, d[0] or 0), d[1] or "") for d in docs}, key=lambda x: x[0])


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_substring_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BATCH", 1 << 12)
    docs = hard_rows()
    seen = Counter()
    for _, t in once(docs):
        w = space_words(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for d in docs:
        w, gone = space_words(d[1]), set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        want.append((d[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sum(x[2] > 0 for x in want) > 15
    assert bag(substring_dedup.dedup(hard(spark)).drop("kept").collect()) == bag(want)
    assert substring_dedup.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BATCH", 1 << 12)
    docs, found, seen = hard_rows(), {}, set()
    for key, t in once(docs):
        b, gone = t.encode(), set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(b[i : i + 100])
        found[key, t] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), sha(bytes(x for i, x in enumerate(b) if i not in gone)))
    want = bag((d[0], *found[(d[0] is not None, d[0] or 0), d[1] or ""]) for d in docs)
    assert bag(suffix_dedup.dedup(hard(spark)).drop("kept").collect()) == want
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(5)
    for length, dtype in ((35, np.uint64), (100, np.uint8), (9, np.uint8)):
        symbols = np.tile(rng.integers(0, 3, 70), 12).astype(dtype)
        symbols[rng.integers(0, len(symbols), 9)] = 7
        starts = np.sort(rng.choice(len(symbols) - length + 1, 300, replace=False))
        by, common = repeats.order(symbols, starts, length)
        rows = [symbols[starts[i] :][:length].tolist() for i in by]
        assert all(a <= b for a, b in zip(rows, rows[1:], strict=False)) or dtype == np.uint64
        for i in range(1, len(rows)):
            assert common[i] == next((j for j in range(length) if rows[i][j] != rows[i - 1][j]), length)
        seen, lpf = [], suffix_dedup.longest_previous_factors(by, common)
        for p in range(len(starts)):
            mine = symbols[starts[p] :][:length].tolist()
            best = max((next((j for j in range(length) if mine[j] != o[j]), length) for o in seen), default=0)
            assert lpf[p] == best
            seen.append(mine)


def test_settle_across_batches(spark):
    """Groups that are longer than a batch keep their first context and lose no repeat."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(1, 1, i, 0, 1) for i in range(9)] + [(2, c, 10 * c + i, 0, 1) for c in range(3) for i in range(4)] + [(3, 5, 1, 0, 1), (4, 1, 1, 0, 1), (4, 2, 1, 0, 2)]
    # contexts that share half of their digest are told apart by the other half
    found = spark.createDataFrame([(h, c // 2, c, *rest, False) for h, c, *rest in rows] + [(9, 9, 9, 9, 9, 9, True)], repeats.ANCHOR)
    want = {e: bag(repeats.settle(found, e).collect()) for e in (True, False)}
    assert sum(n for r, n in want[False].items() if r[0] == 1) == 8 + 9 + 1 and sum(n for r, n in want[True].items() if r[0] == 1) == 9 + 12 + 1
    assert sum(n for r, n in want[True].items() if r[0] == 0) == 3 + 2
    old = spark.conf.get(conf)
    try:
        for size in ("1", "2", "3", "5"):
            spark.conf.set(conf, size)
            for e in (True, False):
                assert bag(repeats.settle(found, e).collect()) == want[e]
    finally:
        spark.conf.set(conf, old)
