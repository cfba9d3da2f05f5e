"""The scan with a stand-in scorer, and joins with promises."""

from __future__ import annotations

import numpy as np
import pytest

from spanforge.operators import joins, scan


class Position:
    """Scores the share of G weighted by place."""

    def score(self, sequences):
        return np.array([sum(i for i, c in enumerate(s) if c == "G") / len(s) for s in sequences])


def test_scan(spark):
    seq = "ACGT" * 100
    seq = seq[:120] + "A" * 40 + seq[160:200] + "N" + seq[201:]
    targets = spark.createDataFrame([("G1", "chr1", 1000, seq), ("G2", "chr1", 5, "ACG")], "gene_id string, chrom string, start0 bigint, sequence string")
    found = scan.scan(targets, Position, 40, 40, 3, seed=1, pairs=False).cache()
    rows = {(r.window_id, r.repeat): r for r in found.collect()}
    assert len(rows) == 10 * 3 and {k[0] for k in rows} == set(range(10))
    assert {rows[3, i].status for i in range(3)} == {"unchanged"} and rows[5, 0].status == "ambiguous_bases"
    assert rows[0, 0].status == "tested" and rows[0, 0].delta == pytest.approx(rows[0, 0].prediction - rows[0, 0].baseline)
    assert rows[5, 0].delta is None and len({rows[0, i].prediction for i in range(3)}) > 1
    again = {(r.window_id, r.repeat): r for r in scan.scan(targets.repartition(3), Position, 40, 40, 3, seed=1, pairs=False).collect()}
    assert again == rows
    out = scan.finish(found, 3, 0.0, 1)
    assert sorted((r.start0, r.end0) for r in out["tested"].collect()) == [(1000, 1120), (1160, 1200), (1240, 1400)]
    assert {r.status for r in out["windows"].collect()} == {"tested", "unchanged_all_repeats"}
    assert all(r.length_bp > 0 for r in out["regions"].collect())


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string")
    b = spark.createDataFrame([(1, "p", 5), (3, "q", 6)], "id bigint, v string, n bigint")
    assert sorted(map(tuple, joins.one_to_one(a, b, ["id"]).collect())) == [(1, "x", 5), (2, "y", None)]
    with pytest.raises(ValueError):
        joins.one_to_one(a.union(a), b, ["id"])
    with pytest.raises(ValueError):
        joins.lookup(a, b, ["id"], ["n"])
    kept, left = joins.audited(a, b, ["id"], "missing")
    assert [r.id for r in kept.collect()] == [1] and [tuple(r) for r in left.collect()] == [(2, "missing")]
    lists = spark.createDataFrame([(1, "l1"), (1, "l2"), (1, "l2"), (9, "l1")], "id bigint, list string")
    assert {r.id: r.n_lists for r in joins.membership(a, lists, "id", "list").collect()} == {1: 2, 2: 0}
    ids = spark.createDataFrame([("s", 1), ("s", 2), ("t", 7), ("t", 8)], "name string, id bigint")
    assert sorted(map(tuple, joins.resolved(ids, b, "name", "id").select("name", "id").collect())) == [("s", 1), ("t", 7), ("t", 8)]
    names = spark.createDataFrame([("s",), ("u",), ("z",)], "name string")
    more = spark.createDataFrame([("u", 4), ("s", 9)], "name string, id bigint")
    assert sorted(map(tuple, joins.with_fallback(names, ids, more, "name", "id").collect())) == [("s", 1), ("s", 2), ("u", 4)]
    pairs = spark.createDataFrame([("a", "b", 2.0)], "p string, q string, d double")
    assert sorted(map(tuple, joins.symmetric(pairs, "p", "q", ["d"]).collect())) == [("a", "b", 2.0), ("b", "a", -2.0)]
