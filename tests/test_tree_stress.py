"""Stress over constituency trees: deep, broken and random ones, against a plain walk."""

import random

from metrika.operators import trees

SCHEMA = "text_id string, sent_num int, node int, parent int, label string, word_num int, lstress double"


def plain(nodes):
    """(word_num -> pstress, total) of one sentence's nodes, by walking up and down."""
    info = {n[2]: n for n in nodes}
    below = {}
    for n in sorted(info):
        below.setdefault(info[n][3], []).append(n)

    def stressed(n):
        todo = [n]
        while todo:
            k = todo.pop()
            if k in below:
                todo += below[k]
            elif info[k][6] is not None and info[k][6] > -1:
                return True
        return False

    loss = dict.fromkeys(info, 0)
    for n, kids in below.items():
        if n in info and len(kids) > 1:
            tail = []
            for k in reversed(kids):
                if not info[k][4].startswith("NN"):
                    break
                tail.insert(0, k)
            able = [k for k in kids if stressed(k)]
            head = tail[0] if info[n][4] == "NP" and len(tail) > 1 else able[-1] if able else kids[-1]
            for k in kids:
                loss[k] = 0 if k == head else -1
    out = {}
    for n, x in info.items():
        if n not in below:
            total, at = 0, n
            while at in info:
                total, at = total + loss[at], info[at][3]
            out[x[5]] = (float(loss[n]), None if x[6] is None else x[6] + total)
    return out


def test_random_trees(spark):
    rng, rows = random.Random(3), []
    for s in range(30):
        size = rng.randint(2, 25)
        for n in range(size):
            parent = rng.randrange(n) if n else -1
            rows.append(("t", s, n, parent, rng.choice(["NP", "VP", "NN", "NNS", "DT"]), n, rng.choice([0.0, -0.5, -1.0, None])))
    got = {}
    for r in trees.tree_stress(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.sent_num, {})[r.word_num] = (r.pstress, r.total)
    assert got == {s: plain([r for r in rows if r[1] == s]) for s in range(30)}


def test_five_thousand_levels(spark):
    deep = [("t", 1, n, n - 1, "VP", None, 0.0) for n in range(5_000)] + [("t", 1, 10_000 + n, n, "NN", n, 0.0) for n in range(5_000)]
    got = {r.word_num: r.total for r in trees.tree_stress(spark.createDataFrame(deep, SCHEMA)).collect()}
    # A leaf stands after its sister phrase, so it heads every phrase but the innermost, which has it alone.
    assert got == {n: -float(n) for n in range(5_000)}


def test_circles_and_missing_parents(spark):
    rows = [("t", 1, 1, 2, "VP", None, 0.0), ("t", 1, 2, 1, "VP", None, 0.0), ("t", 1, 3, 1, "NN", 1, 0.0), ("t", 1, 4, 99, "NN", 2, 0.0), ("t", 2, 1, None, "NN", 1, -1.0)]
    got = {(r.sent_num, r.word_num): r.total for r in trees.tree_stress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2): 0.0, (2, 1): -1.0}
    assert trees.tree_stress(spark.createDataFrame([], SCHEMA)).count() == 0
