"""Statistics against published or enumerated values."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from spanforge.operators.sampling import _euler_shuffle
from spanforge.operators.stats import fisher_exact, signed_rank


def test_fisher():
    assert fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70)  # the lady tasting tea, two-sided
    assert fisher_exact(0, 0, 0, 0) == 1.0
    for a, b, c, d in itertools.product(range(4), repeat=4):
        row, col, n = a + b, a + c, a + b + c + d
        p = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, col - (n - row)), min(row, col) + 1)} if n else {0: 1.0}
        assert fisher_exact(a, b, c, d) == pytest.approx(sum(x for x in p.values() if x <= p.get(a, 1.0) * (1 + 1e-7)))


def test_signed_rank_is_exact_without_ties():
    x = np.array([1.5, -0.5, 2.5, 3.0, -1.0, 4.0, 0.0])
    w, two, greater, less = signed_rank(x)
    sizes = np.abs(x[x != 0])
    ranks = sizes.argsort().argsort() + 1
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    assert w == ranks[x[x != 0] > 0].sum()
    assert greater == pytest.approx(np.mean([s >= w for s in sums])) and less == pytest.approx(np.mean([s <= w for s in sums]))
    assert two == pytest.approx(min(1, 2 * min(greater, less)))


def test_signed_rank_of_few_or_tied_values():
    assert all(math.isnan(v) for v in signed_rank(np.array([1.0, 2, 0, 3, 4])))
    w, two, greater, less = signed_rank(np.array([1.0, 1, -1, 2, 2, 3, -4, 5]))
    assert 0 < greater < 0.5 < less < 1 and two == pytest.approx(2 * greater)


def test_shuffle_keeps_pairs():
    rng = np.random.default_rng(0)
    seen = set()
    for text in ("ACGTACGTTTGACCAGTA", "AAAA", "AB", "", "ABCABCABCAAB"):
        for _ in range(40):
            out = _euler_shuffle(text, rng)
            assert Counter(zip(out, out[1:], strict=False)) == Counter(zip(text, text[1:], strict=False)) and out[:1] == text[:1] and out[-1:] == text[-1:]
            seen.add(out)
    assert len(seen) > 40
