"""The epistasis flow against a plain computation of its rules, and the condition cache."""

from __future__ import annotations

import hashlib
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from spanforge.operators import epistasis
from spanforge.streaming import progress


class Thirds:
    """The square of the number of G at every third place."""

    calls = 0

    def score(self, sequences):
        return [float(sum(c == "G" for c in s[::3])) ** 2 for s in sequences]


SEQ = {"g1": "".join("ACGT"[int(hashlib.sha256(f"{i}".encode()).hexdigest(), 16) % 4] for i in range(400)), "g2": "".join("ACGT"[int(hashlib.sha256(f"x{i}".encode()).hexdigest(), 16) % 4] for i in range(300))}
SEQ["g1"] = SEQ["g1"][:350] + "N" + SEQ["g1"][351:]
START = {"g1": 1000, "g2": 50}
HITS = [("g1", "R01", 1040, 1070), ("g1", "R02", 1200, 1230), ("g2", "R01", 40, 80)]
NULLS = [("g1", "R01", 1, 1120, 1150), ("g1", "R01", 2, 1300, 1330)]
WINDOWS = [(g, START[g] + a, START[g] + a + 40, a % 80 == 0) for g in SEQ for a in range(0, len(SEQ[g]) - 39, 20)]


def order(n, *keys):
    return sorted(range(1, n + 1), key=lambda i: hashlib.sha256("|".join(map(str, (*keys, i))).encode()).hexdigest())


def score(s):
    return float(sum(c == "G" for c in s[::3])) ** 2


def plain(threshold, seed=3, mask_seed=4, reshuffles=2, repeats=2):
    conds = [(g, r, "hit", r, k, s, e) for g, r, s, e in HITS for k in range(reshuffles)] + [(g, f"{h}_null{j}", "null", h, k, s, e) for g, h, j, s, e in NULLS for k in range(reshuffles)]
    rows, knocked = [], {}

    def scan(g, text):
        out, base = {}, score(text)
        for w in WINDOWS:
            if w[0] != g:
                continue
            a, b = w[1] - START[g], w[2] - START[g]
            for r in range(repeats):
                block = text[a:b]
                piece = "".join(block[i - 1] for i in order(b - a, seed, g, w[1], w[2], r))
                out[w, r] = (None if "N" in block else score(text[:a] + piece + text[b:]) - base, sum(x != y for x, y in zip(block, piece, strict=True)))
        return out

    ref = {g: scan(g, SEQ[g]) for g in SEQ}
    for g, mask, kind, hit, k, s, e in conds:
        lo, hi = max(s, START[g]), min(e, START[g] + len(SEQ[g]))
        a, b = lo - START[g], hi - START[g]
        block = SEQ[g][a:b]
        text = SEQ[g][:a] + "".join(block[i - 1] for i in order(b - a, mask_seed, g, lo, hi, f"mask{k}")) + SEQ[g][b:]
        knocked.setdefault((g, mask), []).append(score(text) - score(SEQ[g]))
        found = scan(g, text)
        for w in WINDOWS:
            if w[0] == g and found[w, 0][0] is not None:
                x, y = [ref[g][w, r][0] for r in range(repeats)], [found[w, r][0] for r in range(repeats)]
                up = mean(map(abs, y)) > threshold >= mean(map(abs, x))
                down = mean(map(abs, y)) <= threshold < mean(map(abs, x))
                same = all(ref[g][w, r][1] == found[w, r][1] for r in range(repeats))
                over = w[1] < hi and lo < w[2]
                rows.append((g, mask, kind, hit, k, w, mean(x), mean(y), mean(q - p for p, q in zip(x, y, strict=True)), up, down, over, over or same))
    return rows, knocked


@pytest.fixture(scope="module")
def tables(spark):
    targets = spark.createDataFrame([(g, START[g], s) for g, s in SEQ.items()], "gene_id string, start0 bigint, sequence string")
    hits = spark.createDataFrame(HITS, "gene_id string, region_id string, start0 bigint, end0 bigint")
    nulls = spark.createDataFrame(NULLS, "gene_id string, hit_id string, number int, start0 bigint, end0 bigint")
    windows = spark.createDataFrame(WINDOWS, "gene_id string, start0 bigint, end0 bigint, is_control boolean")
    return targets, hits, nulls, windows


@pytest.mark.parametrize("chunk", [256, 3])
def test_flow(spark, tables, chunk):
    targets, hits, nulls, windows = tables
    out = epistasis.run(targets, hits, nulls, windows, Thirds, 2, 2, 30.5, seed=3, mask_seed=4, chunk=chunk)
    rows, knocked = plain(30.5)
    got = {(r.gene_id, r.mask_id, r.rep, r.start0): r for r in out["windows_by_condition"].collect()}
    assert len(got) == sum(1 for g in SEQ for w in WINDOWS if w[0] == g for c in [*HITS, *NULLS] for k in range(2) if c[0] == g)
    assert sum(r.valid for r in got.values()) == len(rows) < len(got)
    for g, mask, kind, hit, k, w, x, y, e, up, down, over, paired in rows:
        r = got[g, mask, k, w[1]]
        assert (r.kind, r.matched_to, r.is_control, r.delta_ref, r.delta_masked, r.epsilon, r.crosses_up, r.crosses_down, r.overlaps_mask, r.pairing_ok) == (kind, hit, w[3], x, y, e, up, down, over, paired)
    assert {(r.gene_id, r.mask_id, r.rep): r.knockout_effect for r in out["mask_effects"].collect()} == {(*m, k): v for m, each in knocked.items() for k, v in enumerate(each)}
    regions = {(r.gene_id, r.mask_id, r.target_id): r for r in out["region_epistasis"].collect()}
    want = {}
    for g, mask in knocked:
        mine = [r for r in rows if r[:2] == (g, mask) and not r[11]]
        for target in [*(h for h in HITS if h[0] == g), None]:
            if target and (mask == target[1]):
                continue
            on = [r for r in mine if (r[5][3] if target is None else r[5][1] < target[3] and target[2] < r[5][2])]
            if on:
                each = [mean(r[8] for r in on if r[4] == k) for k in (0, 1)]
                want[g, mask, target[1] if target else "CONTROL"] = (len({r[5] for r in on}), mean(each), stdev(each), mean(float((e > 0) - (e < 0) == (mean(each) > 0) - (mean(each) < 0)) for e in each))
    assert regions.keys() == want.keys()
    for k, (n, e, sd, agree) in want.items():
        r = regions[k]
        assert r.n_windows == n and r.n_reps == 2 and r.epsilon_mean == pytest.approx(e) and r.epsilon_sd_reps == pytest.approx(sd) and r.sign_consistency == pytest.approx(agree)
        assert r.mask_effect_mean == pytest.approx(mean(knocked[k[:2]]))
        nulls_ = [v[1] for q, v in want.items() if q[0] == k[0] and q[2] == k[2] and q[1].startswith(k[1] + "_null")]
        assert r.n_null_masks == (len(nulls_) or None) and r.exceeds_all_nulls == (abs(e) > max(map(abs, nulls_)) if nulls_ else None)
    assert any(r[9] or r[10] for r in rows)


def test_masks_that_do_nothing_are_errors(spark):
    targets = spark.createDataFrame([("g", 0, "A" * 50 + "N" + "ACGT" * 10)], "gene_id string, start0 bigint, sequence string")
    for span, message in (((0, 20), "unchanged by the reshuffle"), ((45, 60), "letters other than")):
        hits = spark.createDataFrame([("g", "R01", *span)], "gene_id string, region_id string, start0 bigint, end0 bigint")
        with pytest.raises(Exception, match=message):
            epistasis.backgrounds(targets, epistasis.conditions(hits, None, 1), 1).collect()


def test_windows_and_controls(spark, tables):
    targets, hits, nulls, windows = tables
    tested = windows.withColumn("chrom", F.lit("c")).drop("is_control")
    all_hits = hits.withColumn("chrom", F.lit("c"))
    mine = all_hits.where("region_id = 'R01'")
    got = {(r.gene_id, r.start0): r.is_control for r in epistasis.select_windows(tested, all_hits, mine, 10, 2, 5).collect()}
    near = lambda w, table: any(h[0] == w[0] and w[1] < h[3] + 10 and h[2] - 10 < w[2] for h in table)
    assert {k for k, c in got.items() if not c} == {w[:2] for w in WINDOWS if near(w, [h for h in HITS if h[1] == "R01"])}
    controls = {k for k, c in got.items() if c}
    assert len(controls) == 4 and all(not near(w, HITS) for w in WINDOWS if w[:2] in controls)
    assert {(r.gene_id, r.start0): r.is_control for r in epistasis.select_windows(tested, all_hits, mine, 10, 2, 5, everything=True).collect()} == {w[:2]: not near(w, HITS) for w in WINDOWS}


def test_condition_cache(spark, tables, tmp_path):
    targets, hits, nulls, windows = tables
    conds = epistasis.fingerprints(epistasis.conditions(hits, nulls, 2), windows, ["scorer", 1])
    path, worked = str(tmp_path / "cache"), []

    def work(left):
        worked.append(left.count())
        return left.select("gene_id", "cond_id", F.length("cond_id").alias("value"))

    some = conds.where("kind = 'hit'")
    assert progress.left_over(some, path, ["gene_id", "cond_id"]).count() == 6
    assert progress.resume_conditions(some, path, ["gene_id", "cond_id"], work).count() == 6
    assert progress.left_over(conds, path, ["gene_id", "cond_id"]).count() == 4
    assert progress.resume_conditions(conds, path, ["gene_id", "cond_id"], work).count() == 10
    again = progress.resume_conditions(conds, path, ["gene_id", "cond_id"], work)
    assert worked == [6, 4] and again.count() == 10 and sorted(again.columns) == ["cond_id", "gene_id", "value"]
    changed = epistasis.fingerprints(epistasis.conditions(hits, nulls, 2), windows, ["scorer", 2])
    with pytest.raises(ValueError, match="other settings"):
        progress.resume_conditions(changed, path, ["gene_id", "cond_id"], work)
    moved = epistasis.fingerprints(epistasis.conditions(hits, nulls, 2), windows.where("start0 > 1000"), ["scorer", 1])
    with pytest.raises(ValueError, match="g1, R01_rep0"):
        progress.resume_conditions(moved.where("cond_id = 'R01_rep0' AND gene_id = 'g1'"), path, ["gene_id", "cond_id"], work)


def test_what_a_crash_leaves_is_not_read(spark, tables, tmp_path):
    targets, hits, nulls, windows = tables
    conds = epistasis.fingerprints(epistasis.conditions(hits, None, 1), windows, [])
    path = str(tmp_path / "cache")
    # results were appended, but the run ended before its conditions were
    conds.select("gene_id", "cond_id", F.lit(-1).alias("value"), F.lit("lost").alias("run")).write.parquet(f"{path}/results")
    got = progress.resume_conditions(conds, path, ["gene_id", "cond_id"], lambda left: left.select("gene_id", "cond_id", F.lit(1).alias("value")))
    assert [r["value"] for r in got.collect()] == [1, 1, 1]


@pytest.mark.parametrize("size", [16, 7, 1000])
def test_bases_are_counted_by_two_lookups(spark, size):
    import random

    from spanforge.operators import sampling

    rng = random.Random(4)
    seqs = {c: "".join(rng.choice("ACGTacgtN" if rng.random() < 0.05 else "ACGTacgt") for _ in range(n)) for c, n in (("c1", 500), ("c2", 64), ("c3", 1))}
    chunks = spark.createDataFrame([(c, a // size, s[a : a + size]) for c, s in seqs.items() for a in range(0, len(s), size)], "chrom string, chunk bigint, sequence string").repartition(3)
    index = sampling.base_index(chunks)
    spans = [(c, a, b) for c, s in seqs.items() for _ in range(60) for a, b in [sorted((rng.randrange(-3, len(s) + 3), rng.randrange(-3, len(s) + 3)))] if a < b]
    rows = spark.createDataFrame(list(enumerate(spans)), "i long, s struct<chrom:string,start0:bigint,end0:bigint>").select("i", "s.*")
    for r in sampling.base_share(rows, index, ["i"], size=size).collect():
        c, a, b = spans[r.i]
        part = seqs[c][a:b].upper() if a >= 0 and b <= len(seqs[c]) else None
        assert r.clear == (part is not None and set(part) <= set("ACGT"))
        if r.clear:
            assert r.gc == pytest.approx(sum(x in "GC" for x in part) / (b - a))


def test_nulls_on_sequences_keep_their_promises(spark):
    import random

    from spanforge.operators import sampling

    rng = random.Random(7)
    seqs = {g: "".join(rng.choice("ACGT") for _ in range(3000)) for g in ("g1", "g2")}
    seqs["g1"] = seqs["g1"][:500] + "N" * 300 + seqs["g1"][800:]
    hits = [(f"{g}r{i}", g, 900 + 400 * i, 960 + 410 * i) for g in seqs for i in range(4)] + [("g2wide", "g2", 100, 2990)]
    chunks = spark.createDataFrame([(g, a // 128, s[a : a + 128]) for g, s in seqs.items() for a in range(0, 3000, 128)], "gene_id string, chunk bigint, sequence string")
    df = spark.createDataFrame(hits, "region_id string, gene_id string, start0 bigint, end0 bigint")
    space = spark.createDataFrame([(g, 0, 3000) for g in seqs], "gene_id string, start0 bigint, end0 bigint")
    tss = spark.createDataFrame([("g1", 0, 200)], "gene_id string, start0 bigint, end0 bigint")
    nulls = sampling.matched_nulls(df, space, sampling.base_index(chunks, ["gene_id"]), ["gene_id"], ["gene_id"], 3, 5, 0.05, tries=400, forbidden=tss, size=128)
    rows, of = nulls.collect(), {h[0]: h for h in hits}
    gc = lambda s: sum(x in "GC" for x in s) / len(s)
    for r in rows:
        _, g, a, b = of[r.hit_id]
        text = seqs[g][r.start0 : r.end0]
        assert r.end0 - r.start0 == b - a and set(text) <= set("ACGT") and abs(gc(text) - gc(seqs[g][a:b])) <= 0.05 + 1e-9
        assert not any(r.start0 < h[3] and h[2] < r.end0 for h in hits if h[1] == g) and not (g == "g1" and r.start0 < 200)
        assert not any(o is not r and o.gene_id == r.gene_id and r.start0 < o.end0 and o.start0 < r.end0 for o in rows)
    assert {r.region_id: (r.wanted, r.found) for r in sampling.unmatched(df, nulls, 3).collect()}["g2wide"] == (3, 0)
    assert len([r for r in rows if r.gene_id == "g1"]) >= 8
