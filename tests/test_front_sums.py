"""Neighbouring parts as one: fronts are added within a row, and the parts' rhythms are read once."""

import random

import pyarrow as pa

from metrika.operators import texts, units


def plain(f, g):
    sums = {}
    for *x, m in f:
        for *y, n in g:
            v = tuple(a + b for a, b in zip(x, y, strict=True))
            sums[v] = sums.get(v, 0) + m * n
    less = lambda w, v: w != v and all(a <= b for a, b in zip(w, v, strict=True))
    return sorted([*v, n] for v, n in sums.items() if not any(less(w, v) for w in sums))


def test_sums_equal_all_pairs():
    rng = random.Random(3)
    front = lambda n: [[rng.randint(0, 9) for _ in range(6)] + [rng.randint(1, 5)] for _ in range(n)]
    fronts = [front(n) for n in (1, 2, 5, 30, 40)]
    both = [(f, g) for f in fronts for g in fronts]
    got = texts._sums(*(pa.array([p[k] for p in both], pa.list_(pa.list_(pa.int64()))) for k in (0, 1))).to_pylist()
    assert [sorted(x) for x in got] == [plain(f, g) for f, g in both]


def test_rhythms_are_read_once_and_no_sums_are_shuffled(spark, monkeypatch):
    read, made = units.rhythms, []
    monkeypatch.setattr(units, "rhythms", lambda *a: made.append(1) or read(*a))
    words = [["the", "merry", "month"], ["of", "all", "winter"], ["when", "roses", "can", "blow"], ["the", "merry", "month"]]
    rows = [(t, 1, k + 1, words[(t + k) % 4]) for t in range(4) for k in range(3)]
    out = texts.combined(spark.createDataFrame(rows, "text_id int, line_num int, linepart int, words array<string>"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert made == [1] and "LeftAnti" not in plan and "BroadcastHashJoin" not in plan
    assert out.count() == 8
