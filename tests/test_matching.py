"""Motifs by prefixes against a comparison of every pair, and chromosomes by ranked kinds of match."""

from __future__ import annotations

import random
import re

import pytest

from spanforge.operators import motifs
from spanforge.sources import contigs


def norm(x):
    return re.sub("[^A-Za-z0-9]", "", x).upper()


def slow(symbol, alias):
    a = norm(alias)
    return symbol == a if len(a) < 3 or len(symbol) < 3 else symbol == a or symbol.startswith(a) or a.startswith(symbol)


def test_prefix_matches_are_those_of_every_pair(spark):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("AB1") for _ in range(rng.randrange(0, 7)))
    names, groups = sorted({make() for _ in range(150)}), [(f"l{rng.randrange(20)}", make()) for _ in range(60)]
    results = spark.createDataFrame([(c, f"{n}(F)/x/{i}", float(rng.randrange(9))) for i, n in enumerate(names) for c in ("c1", "c2") if rng.random() < 0.8], "cell_type string, motif string, neglog10p double")
    found = motifs.matched(results, spark.createDataFrame(groups, "label string, alias string"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    got = {(r.cell_type, r.motif, r.label): r.is_representative for r in found.collect()}
    rows = results.collect()
    want = {(r.cell_type, r.motif, g) for r in rows for g, a in groups if slow(norm(r.motif.split("/", 1)[0].split("(", 1)[0]), a)}
    assert set(got) == want
    for key in {(c, g) for c, _, g in want}:
        mine = sorted((-r.neglog10p, r.motif) for r in rows if (r.cell_type, r.motif, key[1]) in want and r.cell_type == key[0])
        assert [m for (c, m, g), first in got.items() if (c, g) == key and first] == [mine[0][1]]


def test_contigs(spark):
    index = spark.createDataFrame([("chr1", 100), ("2", 90), ("chr3", 80), ("3", 70), ("M", 16), ("s1", 5)], "contig string, length bigint")
    names = ["chr1", "1", "Chr01", "chr2", "3", "chr03", "chrM", "MT", "s1", "chrs1", "9", None]
    df = spark.createDataFrame([(n,) for n in names], "chrom string")
    got = {mode: {r.chrom: (r.contig, r.status) for r in contigs.outcomes(df, index, mode).collect()} for mode in contigs.MODES}
    assert got["exact"] == {n: (n, "exact") if n in ("chr1", "3", "s1") else (None, "missing") for n in names if n}
    assert got["toggle"] == got["exact"] | {"1": ("chr1", "toggled"), "chr2": ("2", "toggled"), "chrM": ("M", "toggled"), "chrs1": ("s1", "toggled")}
    assert got["auto"] == got["exact"] | {"1": ("chr1", "primary"), "Chr01": ("chr1", "primary"), "chr2": ("2", "primary"), "chr03": (None, "ambiguous"), "chrM": ("M", "primary"), "MT": ("M", "primary")}
    with pytest.raises(ValueError, match=r"9 \(missing\), chr03 \(ambiguous\)"):
        contigs.resolved(df.where("chrom IN ('9', 'chr03', '1')"), index)
    with pytest.raises(ValueError, match="one of"):
        contigs.outcomes(df, index, "loose")
    spans = spark.createDataFrame([("1", 0, 100), ("2", 5, 6)], "chrom string, start0 bigint, end0 bigint")
    assert {(r.contig, r.contig_length) for r in contigs.inside(contigs.resolved(spans, index)).collect()} == {("chr1", 100), ("2", 90)}
    for bad in (("1", -1, 5), ("1", 5, 101), ("1", 5, 5)):
        with pytest.raises(ValueError, match="beyond"):
            contigs.inside(contigs.resolved(spark.createDataFrame([bad], "chrom string, start0 bigint, end0 bigint"), index))
