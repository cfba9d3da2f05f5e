"""The enrichment at its registered size against brute force; tests/test_queries.py holds it against the SQL."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanforge.plans import enrichment_queries as E
from spanforge.plans.views import view
from tests.harness import canonical, duck

SF = "/root/testdata/sf0.001"


def u(*keys) -> float:
    return int(hashlib.sha256("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)


@pytest.fixture(scope="module")
def brute(spark):
    """{(gene, track): bp of regions x (observed, then each permutation)} by a covered-bp table of each chromosome."""
    reach = defaultdict(lambda: np.zeros(6_000_000, np.int8))
    for t in view(spark, SF, "tracks").collect():
        assert t.start0 >= 0
        reach[t.track, t.chrom][t.start0 : t.end0] = 1
    upto = {k: np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for k, v in reach.items()}
    names = sorted({t for t, _ in upto})
    blocks = defaultdict(list)
    for b in view(spark, SF, "tested").collect():
        blocks[b.gene_id, b.chrom].append((b.start0, b.end0))
    out = defaultdict(list)
    for r in view(spark, SF, "regions").collect():
        fit = [(a, b - a - r.length + 1) for a, b in sorted(blocks[r.gene_id, r.chrom]) if b - a - r.length + 1 > 0]
        if not fit:
            continue
        before = np.concatenate([[0], np.cumsum([n for _, n in fit])])
        at = np.array([int(u(E.SEED, r.region_id, p) * int(before[-1])) for p in range(1000)])
        i = np.searchsorted(before, at, side="right") - 1
        starts = np.concatenate([[r.start0], np.array([a for a, _ in fit])[i] + at - before[i]])
        for t in names:
            c = upto.get((t, r.chrom), np.zeros(6_000_001, np.int64))
            out[r.gene_id, t].append(c[np.minimum(starts + r.length, 6_000_000)] - c[np.minimum(starts, 6_000_000)])
    return {k: np.array(v) for k, v in out.items()}


def of(brute, track):
    return np.concatenate([v for (_, t), v in brute.items() if t == track])


def test_counts_and_p_values_of_1000_permutations(spark, brute):
    tracks = {t for _, t in brute}
    got = {(r.track, r.perm): (r.n_overlap, r.cov_bp) for r in E.null_overlap_counts(spark, SF).where("stratum = 'all'").collect()}
    want = {(t, p - 1): (int((bp[:, p] > 0).sum()), int(bp[:, p].sum())) for t in tracks for bp in [of(brute, t)] for p in range(1001)}
    assert got == want
    found = {r.track: r for r in E.enrichment_cov_by_set(spark, SF).where("stratum = 'all'").collect()}
    for t in tracks:
        sums = of(brute, t).sum(0)
        assert found[t].n_perm == 1000 and found[t].p_enrich == pytest.approx((1 + (sums[1:] >= sums[0]).sum()) / 1001, abs=1e-6)
        assert found[t].null_mean == pytest.approx(sums[1:].mean()) and found[t].null_sd == pytest.approx(sums[1:].std(ddof=1))


def test_bootstrap_of_2000_replicates(spark, brute):
    each = {k: (int(v[:, 0].sum()) * 1000, int(v[:, 1:].sum())) for k, v in brute.items() if v.any()}
    genes = sorted({g for g, _ in each})
    drawn = [[genes[int(u(E.SEED, rep, slot) * len(genes))] for slot in range(len(genes))] for rep in range(2000)]
    for r in E.gene_bootstrap_ci(spark, SF).collect():
        sums = [np.sum([each.get((g, r.track), (0, 0)) for g in d], axis=0) for d in drawn]
        ratios = np.array([a / b for a, b in sums if b])
        assert (r.ci_lo, r.ci_hi) == pytest.approx(tuple(np.percentile(ratios, (2.5, 97.5))), abs=1e-6)
        assert r.p_le1 == pytest.approx((ratios <= 1).mean(), abs=1e-6)


def test_contrasts_are_the_same_each_time(spark):
    sf = "/root/testdata/sf0.01"
    want = canonical(duck(sf).execute(E.ORACLE["stratum_contrasts"]).df())
    for _ in range(3):
        pd.testing.assert_frame_equal(canonical(E.stratum_contrasts(spark, sf).toPandas()), want, check_dtype=False)


def test_covered_bp_equals_the_range_join(spark):
    """The two lookups give what joining each interval with each block gives, beyond the first and the last block too."""
    from spanforge.operators import coverage, intervals as I

    blocks = I.merge(view(spark, SF, "tracks"), ("track", "chrom"))
    rows = spark.range(4_000).selectExpr("id AS region_id", "concat('chr', id % 7) AS chrom", "(id * 7919) % 2700000 - 50000 AS start0", "(id * 7919) % 2700000 - 50000 + id % 60000 + 1 AS end0")
    want = I.range_join(rows, blocks, ("chrom",)).groupBy("region_id", F.col("r_track").alias("track")).agg(F.sum(I.overlap_bp()).alias("bp"))
    for step in (1 << 10, 1 << 13, 1 << 22):
        steps = coverage.coverage_steps(blocks, "track", step=step)
        got = coverage.covered(rows.join(coverage.bounds(steps), "chrom"), steps, "track", step=step).select("region_id", "track", "bp")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
