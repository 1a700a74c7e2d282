"""What the driver holds: the training entries of op9 once, and no round of plans for components that are known."""

import random
import tracemalloc

from metrika.llm import common, quality


def test_quality_training_holds_its_entries_once():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3_000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(9_000)]
    entries = sum(len(set(zip(*quality.features([t.encode()])[:2], strict=True))) for t in texts)
    tracemalloc.start()
    quality.fit(texts, [k % 3 for k in range(len(texts))], 3, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * entries  # 75 bytes an entry before, 35 now


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tags = []
    write = common.written
    monkeypatch.setattr(common, "written", lambda df, tag: tags.append(tag) or write(df, tag))
    found = common.components(spark.createDataFrame([(1, 2), (3, 1), (1, 3), (7, 9), (5, 5)], "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert tags == ["edges"]


def test_components_of_a_path_and_a_circle(spark):
    rows = [(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 55), (55, 50)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(1, 41), 1) | dict.fromkeys((50, 55, 60), 50)
