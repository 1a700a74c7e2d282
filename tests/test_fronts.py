"""Fronts of rhythms come with numbers of scansions instead of lists of them, and sums of two fronts are made in the pair's own row."""

import random

import numpy as np
import pytest

from metrika.operators import bounding, parse, texts, tokens, units
from metrika.plans import interface_queries
from test_relations_once import masks
from test_texts_read_once import odd, told

SF = "/root/testdata/sf0.001"
WIDTH = bounding.sum_width(18)


def front(vectors):
    """Counts -> number of scansions of those that no other dominates."""
    below = lambda x, y: x != y and all(a <= b for a, b in zip(x, y, strict=True))
    return {v: m for v, m in vectors.items() if not any(below(w, v) for w in vectors)}


def packed(counts):
    return sum(c << (WIDTH * k) for k, c in enumerate(counts))


@pytest.mark.parametrize("alike", [True, False])
def test_fronts_of_both_variants(alike):
    rng = np.random.default_rng(7)
    n, two = np.array([1, 2, 3, 7, 8, 8]), np.array([False, True, True, False, True, True])
    first, second = (masks(rng, 6, alike) for _ in range(2))
    every = [{} for _ in n]
    for variant, found in enumerate((first, second)):
        row, counts, offsets, _ = bounding.walk_together(n, found, 2, 18)
        for k, r in enumerate(row.tolist()):
            if variant == 0 or two[r]:
                v = tuple(counts[k].tolist())
                every[r][v] = every[r].get(v, 0) + int(offsets[k + 1] - offsets[k])
    ends, v, many = bounding.fronts(n, np.column_stack(first), np.column_stack(second)[two], two, 2, 18)
    got = [dict(zip(v[a:b].tolist(), many[a:b].tolist(), strict=True)) for a, b in zip(ends, ends[1:])]
    assert got == [{packed(c): m for c, m in front(x).items()} for x in every]
    best = [min(front(x), key=lambda c: (2.0 * c[0] + c[1], c)) for x in every]
    assert bounding.leads(ends, v, [2.0, 1.0], 18).tolist() == [packed(c) for c in best]


def test_sums_that_no_other_dominates_are_counted(monkeypatch):
    monkeypatch.setattr(bounding, "PAIRS_AT_ONCE", 64)
    rng = random.Random(3)
    some = lambda k: front({tuple(rng.randint(0, 9) for _ in range(3)): rng.randint(1, 5) for _ in range(k)})
    pairs = [(some(a), some(b)) for a in (1, 2, 9, 40) for b in (1, 3, 30)]
    expected = []
    for f, g in pairs:
        sums = {}
        for x, m in f.items():
            for y, k in g.items():
                v = tuple(p + q for p, q in zip(x, y, strict=True))
                sums[v] = sums.get(v, 0) + m * k
        expected.append(sum(front(sums).values()))
    sides = []
    for side in zip(*pairs, strict=True):
        flat = [(packed(c), m) for f in side for c, m in f.items()]
        sides += [np.append(0, np.cumsum([len(f) for f in side])), *np.array(flat, np.int64).T]
    assert bounding.kept_sums(*sides, 3, 18).tolist() == expected


def test_both_ways_agree(spark, monkeypatch):
    for docs in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet").limit(20)):
        lines = tokens.line_parts(docs)
        meter = parse.Meter(weights=dict(zip(parse.DEFAULT.names, (2.0, 1.0, 0.5, 1.0, 0.0, 3.0), strict=True)))
        fast = told(texts.combined(lines, meter))
        assert told(texts.combined_neighbours(units.neighbours_of(docs), meter)) == fast
        with monkeypatch.context() as m:
            m.setattr(parse, "sums_local", lambda meter: False)
            assert told(texts.combined(lines, meter)) == fast != []


def test_no_parse_is_listed(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("parses are listed")

    monkeypatch.setattr(texts, "lists_of", refused)
    monkeypatch.setattr(parse, "undominated", refused)
    assert interface_queries.QUERIES["combine_parses"](spark, SF).count() > 0
