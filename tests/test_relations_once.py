"""Vectors of a rhythm are made once for all rhythms that the constraints don't tell apart, and equal ones that end alike go on as one."""

import numpy as np
import pytest

from metrika.operators import bounding


def masks(rng, rows, alike):
    """Costs of every pair of states for two constraints; `alike`: none depends on where the syllable before stands."""
    out = [[rng.integers(0, 1 << 9, rows) for _ in range(2)] for _ in bounding.PAIRS]
    if alike:
        for one, two in ((("s1", "w1"), ("s2", "w1")), (("w1", "s1"), ("w2", "s1"))):
            out[bounding._PAIR[two]] = out[bounding._PAIR[one]]
    return [m for pair in out for m in pair]


@pytest.mark.parametrize("alike", [True, False])
def test_relations_equal_all_pairs(alike):
    rng = np.random.default_rng(5)
    n, found = np.array([1, 2, 3, 5, 8, 9, 9]), masks(rng, 7, alike)
    row, total = bounding.vectors_together(n, found, 2, 18)
    width = (18).bit_length() + 1
    expected = []
    for r in range(len(n)):
        v = [(t & ((1 << width) - 1), t >> width) for t in total[row == r].tolist()]
        below = lambda x, y: x[0] <= y[0] and x[1] <= y[1]
        front = [x for x in v if not any(below(y, x) and y != x for y in v)]
        bounds = sum(below(x, y) and x != y for x in front for y in v)
        expected.append([len(front), bounds, len(front) * (len(v) - 1) - bounds])
    assert bounding.relations(n, found, 2, 18).tolist() == expected


def test_equal_costs_are_worked_on_once(monkeypatch):
    made, real = [], bounding._sums
    monkeypatch.setattr(bounding, "_sums", lambda size, cost, *a: made.append(len(cost)) or real(size, cost, *a))
    one = [m[:1] for m in masks(np.random.default_rng(1), 1, True)]
    out = bounding.relations(np.full(50, 7), [np.repeat(m, 50) for m in one], 2, 18)
    assert made == [1] and (out == out[0]).all() and out[0, 0] > 0
