"""Rhyme by feature distance against plain dynamic programming and union of links."""

import random

from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import segments as S
from metrika.operators import rhyme


def plain_distance(a, b):
    if a == b:
        return 0.0
    u, v = P.segment(a), P.segment(b)
    if not u or not v:
        return 1.0
    far = lambda x, y: sum(abs(p - q) for p, q in zip(P.inventory()[x], P.inventory()[y], strict=True)) / 24
    return P.min_edit(u, v, lambda _: 1.0, lambda _: 1.0, far) / max(len(u), len(v))


def test_distance_equals_dynamic_programming(spark):
    rng = random.Random(0)
    bases = [b for b in P.inventory() if len(b) == 1]
    words = ["".join(rng.choice(bases) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["at", "ət", "%", "iː"]
    pairs = [(a, b) for a in words[:40] for b in words[30:]]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").withColumn("d", S.rime_distance(F.col("a"), F.col("b"))).collect()
    for r in rows:
        if r.a is None or r.b is None:
            assert r.d is None
        elif P.segment(r.a) == P.segment(r.a.replace("ː", "")) and P.segment(r.b) == P.segment(r.b.replace("ː", "")):
            assert abs(r.d - plain_distance(r.a, r.b)) < 1e-9, (r.a, r.b)


def plain_ids(ends, dist, most=0.35, window=4):
    """Groups of one text's lines (line -> (word, rime)) by links with the nearest line."""
    near = {}
    for i, (w, r) in ends.items():
        found = [(dist(r, ends[j][1]), j) for j in range(i - window, i + window + 1) if j != i and j in ends and r is not None and ends[j][1] is not None and ends[j][0] != w]
        if found:
            near[i] = min(found)
    root = {i: i for i in ends}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for i, (d, j) in near.items():
        if d <= most and (near.get(j, (0, None))[1] == i or d <= most / 2):
            linked |= {i, j}
            a, b = sorted((find(i), find(j)))
            root[b] = a
    order = sorted({find(i) for i in linked})
    return {i: order.index(find(i)) + 1 if i in linked else 0 for i in ends}


def test_groups_equal_union_of_links(spark):
    rng = random.Random(1)
    texts = [[rng.choice(["cat", "mat", "day", "way", "log", "dog", "bring", "sing", "light", "bite", "pst"]) for _ in range(40)] for _ in range(6)]
    texts.append(["cat", "mat", "dog", "log"])
    rows = spark.createDataFrame([(t, k + 1, ["a", w]) for t, ws in enumerate(texts) for k, w in enumerate(ws)], "text_id int, line_num int, words array<string>")
    ends = {}
    for r in rhyme.line_ends(rows).collect():
        ends.setdefault(r.text_id, {})[r.line_num] = (r.word, r.rime)
    got = {(r.text_id, r.line_num): r.rhyme_id for r in rhyme.rhyme_ids(rows, by="features").collect()}
    assert got == {(t, k): v for t, e in ends.items() for k, v in plain_ids(e, plain_distance).items()}
    assert [got[6, k] for k in (1, 2, 3, 4)] == [1, 1, 2, 2]


def test_one_long_text(spark):
    # A single text of many lines: no task holds it as one group.
    lines = spark.range(1, 60_001).select(F.lit(1).alias("text_id"), F.col("id").cast("int").alias("line_num"), F.array(F.when(F.col("id") % 4 < 2, "cat").otherwise("stone"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), F.when(F.col("id") % 4 == 0, "at").otherwise("oat"))).otherwise("sing")).alias("words"))
    got = rhyme.rhyme_ids(lines)
    assert got.count() == 60_000 and got.where("rhyme_id > 0").count() > 0
    assert rhyme.rhyme_ids(lines.limit(0)).count() == 0
