"""Undominated scansions of a batch of rhythms against the walk of one rhythm at a time."""

import numpy as np
import pytest

from metrika.operators import bounding


@pytest.mark.parametrize(("constraints", "longest", "rhythms"), [(6, 18, 120), (8, 10, 200), (1, 6, 50), (6, 3, 40), (6, 18, 0)])
def test_batch_finds_what_the_walk_of_one_rhythm_finds(constraints, longest, rhythms):
    rng = np.random.default_rng(constraints * 100 + longest)
    n = rng.integers(1, longest + 1, rhythms)
    some = lambda: rng.integers(0, 1 << longest, rhythms) & rng.integers(0, 1 << longest, rhythms) & ((1 << n) - 1)
    masks = [some() for _ in range(len(bounding.PAIRS) * constraints)]
    assert bounding.fits(constraints, longest)
    row, counts, offsets, places = bounding.walk_together(n, masks, constraints, longest)
    mine = [(int(r), c.tolist(), places[a:b].tolist()) for r, c, a, b in zip(row, counts, offsets[:-1], offsets[1:], strict=True)]
    assert sorted(mine) == sorted((r, list(c), p) for r, c, p in bounding.walk(n, masks, constraints, longest))


def test_many_constraints_go_one_rhythm_at_a_time():
    assert not bounding.fits(12, 18)
