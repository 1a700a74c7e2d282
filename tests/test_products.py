"""Products of any number of pieces against an enumeration of all combinations."""

import itertools
from collections import Counter

from metrika.operators import parse, products, texts, units

PIECES = ["all would be well", "and now the day", "of many little rivers", "when shall we see them", "or not", "the"]


def frame(spark, *lines):
    rows = [(k, i + 1, words.split(), 5) for k, line in enumerate(lines) for i, words in enumerate(line)]
    return spark.createDataFrame(rows, "line long, piece int, words array<string>, r int")


def minimal(vectors):
    return {v for v in vectors if not any(o != v and all(a <= b for a, b in zip(o, v, strict=True)) for o in vectors)}


def enumerated(lists):
    """Every combination of the pieces' parses."""
    return Counter(tuple(map(sum, zip(*combo, strict=True))) for combo in itertools.product(*lists))


def test_products_equal_enumeration(spark):
    lines = [PIECES[:n] for n in range(1, 6)] + [[PIECES[0]] * 3, [PIECES[5], PIECES[1], PIECES[5]], [PIECES[5]]]
    pieces = frame(spark, *lines).drop("r")
    lists = {}
    for r in units.rhythms(pieces).join(texts.parse_lists(pieces), texts.RHYTHM).collect():
        lists[r.line, r.piece] = [tuple(p.v) for p in r.parses]
    got = {r.line: r for r in products.combined(pieces).collect()}
    assert set(got) == set(range(7))  # a piece of one syllable has no parse, and a unit of such pieces no row
    for k, line in enumerate(lines[:7]):
        all_ = enumerated([lists[k, i + 1] for i in range(len(line)) if (k, i + 1) in lists])
        good = minimal(set(all_))
        best = min(good, key=lambda v: (sum(v), v))
        r = got[k]
        assert (r.n_product, r.n_kept, r.best_score) == (sum(all_.values()), sum(all_[v] for v in good), sum(best))
        assert tuple(r[c] for c in parse.DEFAULT.names) == best and r.n_pieces == sum((k, i + 1) in lists for i in range(len(line)))


def test_long_products_stay_small(spark):
    r = products.combined(frame(spark, [PIECES[2]] * 40).drop("r")).first()
    one = products.combined(frame(spark, [PIECES[2]]).drop("r")).first()
    assert r.n_pieces == 40 and r.n_product == one.n_product**40 and r.best_score == 40 * one.best_score


def test_clause_pieces(spark):
    rows = spark.createDataFrame([(1, "And we know That you see and hear it because".split(), 7), (2, ["and"], 7), (3, [], 7), (4, None, 7)], "id int, words array<string>, p int")
    found = {}
    for r in products.clause_pieces(rows).collect():
        found.setdefault(r.id, []).append((r.piece, " ".join(r.words)))
    assert {k: sorted(v) for k, v in found.items()} == {1: [(1, "And we know"), (2, "That you see"), (3, "and hear it"), (4, "because")], 2: [(1, "and")]}
    assert products.combined(frame(spark).drop("r")).count() == 0
