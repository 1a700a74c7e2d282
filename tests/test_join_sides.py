"""Joins whose sides grow with the input are never broadcast by Spark's own guess of their size."""

import pytest

from metrika.operators import trees

NODES = [("a", 1, 1, -1, "VP", None, 0.0), ("a", 1, 2, 1, "NN", 1, 0.0), ("a", 1, 3, 1, "VB", 2, -0.5), ("a", 1, 4, 1, "DT", 3, -1.0)]
SCHEMA = "text_id string, sent_num int, node int, parent int, label string, word_num int, lstress double"


@pytest.mark.parametrize("three", [False, True])
def test_tree_stress_broadcasts_no_side_by_a_guess(spark, monkeypatch, three):
    plans = []

    def watched(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    write = trees.written
    monkeypatch.setattr(trees, "written", watched)
    nodes = spark.createDataFrame(NODES, SCHEMA)
    if three:
        from pyspark.sql import functions as F

        out = trees.statistics(nodes.withColumn("n_syll", F.lit(1)))
    else:
        out = trees.tree_stress(nodes)
    assert out.count() == 3
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4
    assert not any("BroadcastHashJoin" in plan for plan in plans)
