"""Expected coverage against a sum over every placement and against draws; bootstrap intervals and rank correlations against plain computations; path keys, ticks and samples."""

from __future__ import annotations

import hashlib
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanforge.functions import exprs
from spanforge.operators import coverage, sampling, stats


def world(seed: int):
    rng = random.Random(seed)
    blocks = {}
    for t in ("a", "b"):
        at, mine = rng.randrange(50), []
        while at < 9000:
            n = rng.randrange(1, 400)
            mine.append((at, at + n))
            at += n + rng.randrange(1, 500)
        blocks[t] = mine
    tested = [("g", "c", 100, 700), ("g", "c", 900, 4000), ("h", "c", -50, 9500), ("k", "c", 3, 40)]
    regions = [("r1", "g", "c", 150, 350), ("r2", "g", "c", 1000, 3500), ("r3", "h", "c", 5000, 5001), ("r4", "h", "c", 0, 9000), ("r5", "k", "c", 5, 30), ("r6", "k", "c", 5, 300)]
    return blocks, tested, regions


@pytest.mark.parametrize("step", [64, 2048])
def test_expected_coverage_is_exact(spark, monkeypatch, step):
    blocks, tested, regions = world(3)
    df = spark.createDataFrame([(t, "c", a, b) for t, mine in blocks.items() for a, b in mine], "track string, chrom string, start0 bigint, end0 bigint")
    space = spark.createDataFrame(tested, "gene_id string, chrom string, start0 bigint, end0 bigint")
    rows = spark.createDataFrame(regions, "region_id string, gene_id string, chrom string, start0 bigint, end0 bigint")
    held = sampling.fitting_blocks(rows, space)
    steps = coverage.areas(coverage.coverage_steps(df, "track", ("chrom",), step), "track")
    got = {(r.region_id, r.track): r.expected_bp for r in coverage.expected(held, steps, "track", step=step).collect()}
    want = {}
    for name, gene, _, s, e in regions:
        starts = [p for g, _, a, b in tested if g == gene for p in range(a, b - (e - s) + 1)]
        for t, mine in blocks.items():
            bp = sum(max(0, min(p + e - s, y) - max(p, x)) for p in starts for x, y in mine)
            if bp:
                want[name, t] = bp / len(starts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())
    assert not any(k[0] == "r6" for k in got)  # it fits nowhere


def test_draws_agree_with_the_expectation(spark):
    blocks, tested, regions = world(5)
    df = spark.createDataFrame([(t, "c", a, b) for t, mine in blocks.items() for a, b in mine], "track string, chrom string, start0 bigint, end0 bigint")
    space = spark.createDataFrame(tested, "gene_id string, chrom string, start0 bigint, end0 bigint")
    rows = spark.createDataFrame(regions, "region_id string, gene_id string, chrom string, start0 bigint, end0 bigint")
    steps = coverage.areas(coverage.coverage_steps(df, "track"), "track")
    exp = {(r.region_id, r.track): r.expected_bp for r in coverage.expected(sampling.fitting_blocks(rows, space), steps, "track").collect()}
    drawn = sampling.placements(rows, space, 1000, 7).join(coverage.bounds(steps), "chrom")
    found = coverage.covered(drawn, steps, "track").groupBy("region_id", "track").agg(F.sum("bp").alias("s"), F.sum(F.col("bp") * F.col("bp")).alias("q")).collect()
    for r in found:
        mean = r.s / 1000
        error = math.sqrt(max(r.q / 1000 - mean * mean, 1e-9) / 1000)
        assert abs(mean - exp[r.region_id, r.track]) < 5 * error + 1e-6, r


def test_space_without_perturbed(spark):
    space = spark.createDataFrame([("g", "c", 0, 100), ("g", "c", 90, 200)], "gene_id string, chrom string, start0 bigint, end0 bigint")
    rows = spark.createDataFrame([("g", "c", 50, 60), ("g", "c", 55, 70), ("h", "c", 0, 200)], "gene_id string, chrom string, start0 bigint, end0 bigint")
    got = lambda e: sorted((r.start0, r.end0) for r in sampling.available(space, rows, exclude_perturbed=e).collect())
    assert got(False) == [(0, 200)] and got(True) == [(0, 50), (70, 200)]


def unit(*keys):
    return int(hashlib.sha256("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_fold_interval(spark):
    rng = random.Random(1)
    rows = [(k, f"g{rng.randrange(n)}", float(rng.randrange(50)), float(rng.randrange(1, 40))) for k, n in (("a", 9), ("b", 4), ("c", 30)) for _ in range(60)]
    rows += [("d", f"g{i}", 1.0, 1.0) for i in range(10)] + [("a", "g0", None, 3.0), ("a", "g1", float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "k string, gene string, o double, e double").repartition(5)
    got = {r.k: r for r in stats.fold_ci(df, ["k"], "gene", "o", "e", 200, 9, min_rows=20).collect()}
    assert got.keys() == {"a", "b", "c"} and got["b"].fold is None and got["b"].ci_lo is None and got["b"].n_genes <= 4
    for k in "ac":
        mine = pd.DataFrame([r for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]], columns=["k", "gene", "o", "e"]).groupby("gene")[["o", "e"]].sum().sort_index()
        boot = []
        for rep in range(200):
            ids = [int(unit(9, rep, s) * len(mine)) for s in range(len(mine))]
            boot.append(mine.o.iloc[ids].sum() / mine.e.iloc[ids].sum())
        assert got[k].fold == pytest.approx(mine.o.sum() / mine.e.sum()) and [got[k].ci_lo, got[k].ci_hi] == pytest.approx(np.percentile(boot, [2.5, 97.5]).tolist())


def test_rank_correlation_interval(spark):
    rng = random.Random(2)
    rows = [(k, f"g{rng.randrange(6)}", float(rng.randrange(8)), float(rng.randrange(12))) for k in "ab" for _ in range(80)] + [("c", "g", 1.0, 2.0)] * 3 + [("a", "g1", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, gene string, x double, y double").repartition(4)
    got = {r.k: r for r in stats.spearman_ci(df, ["k"], "gene", "x", "y", 60, 4, min_rows=10, blocks=7).collect()}
    assert got.keys() == {"a", "b"}
    for k in "ab":
        mine = pd.DataFrame([r[1:] for r in rows if r[0] == k and r[2] is not None], columns=["gene", "x", "y"])
        names = sorted(mine.gene.unique())
        each = {g: mine[mine.gene == g] for g in names}
        rho = lambda d: d.x.rank().corr(d.y.rank())
        boot = [rho(pd.concat([each[names[int(unit(4, rep, s) * len(names))]] for s in range(len(names))])) for rep in range(60)]
        assert got[k].n == len(mine) and got[k].rho == pytest.approx(rho(mine)) and [got[k].ci_lo, got[k].ci_hi] == pytest.approx(np.percentile(boot, [2.5, 97.5]).tolist())


def test_path_keys(spark):
    paths = ["/a/b", " /a//b/ ", "/a/./b", "/a/x/../b", "/../a/b", "a/../..", "..", "./", "a/b/../../../c", "/", "x", "/a/b/c/../../..", "../../x/..", "a/./../b"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", exprs.path_key("p").alias("k")).collect()
    assert {r.p: r.k for r in got} == {p: os.path.normpath(p.strip()) for p in paths}


def test_ticks(spark):
    spans = [(0, 80), (13, 1000), (999, 1_000_000), (5, 13), (100, 900), (7, 123_456_789)]
    for r in spark.createDataFrame(spans, "a bigint, b bigint").withColumn("t", exprs.ruler_ticks("a", "b")).collect():
        raw = (r.b - r.a) / 8
        step = next(int(m * 10 ** math.floor(math.log10(raw))) for m in (1, 2, 5, 10) if raw <= m * 10 ** math.floor(math.log10(raw)))
        assert r.t == [p for p in range(-(-r.a // step) * step, r.b + 1, step)]


def test_samples_follow_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one, two = ({r.k for r in sampling.context_sample(df.repartition(n), 50, 3, ["k"]).collect()} for n in (1, 7))
    assert one == two and len(one) == 50
    some = {r.k for r in sampling.row_sample(df, 1000, 3, ["k"]).collect()}
    assert 850 < len(some) < 1150 and some == {r.k for r in sampling.row_sample(df.repartition(9), 1000, 3, ["k"]).collect()} and sampling.row_sample(df, 5000, 3, ["k"]).count() == 5000
