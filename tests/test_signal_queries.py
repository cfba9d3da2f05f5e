"""Calibration against brute force over the table's own values."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from spanforge.operators import stats
from spanforge.plans.signal_queries import BINS, calibrate_quantile
from spanforge.plans.views import view

SF = "/root/testdata/sf0.001"


def test_quantile_is_not_capped(spark):
    bp = defaultdict(Counter)
    for r in view(spark, SF, "tracks").collect():
        bp[r.track][r.value] += r.end0 - r.start0
    got = {r.track: r for r in calibrate_quantile(spark, SF).collect()}
    assert set(got) == set(bp) and BINS == 200_000
    for track, sums in bp.items():
        upto, total = 0, sum(sums.values())
        for value in sorted(sums):
            upto += sums[value]
            if upto >= 0.97 * total:
                break
        width = max(sums) / BINS
        assert value > 39 and got[track].bp_total == total
        assert value - 1.01 * width <= got[track].threshold <= value


def test_bins_reach_each_keys_largest_value(spark):
    rows = [("a", 0, 90, -1.0), ("a", 90, 100, 1e6), ("b", 0, 50, 0.001), ("b", 50, 100, 0.002), ("none", 0, 10, 0.0)]
    hist = stats.scaled_histogram(spark.createDataFrame(rows, "track string, start0 bigint, end0 bigint, value double"), ["track"], 1000)
    assert {(r.track, r.bin, r.bp) for r in hist.collect()} == {("a", 0, 90), ("a", 999, 10), ("b", 500, 50), ("b", 999, 50), ("none", 0, 10)}
    found = {r.track: r.threshold for r in stats.quantile_cutoff(hist, ["track"], hist.width, 0.97).collect()}
    assert found["a"] == pytest.approx(999_000) and found["b"] == pytest.approx(0.001998) and found["none"] is None
