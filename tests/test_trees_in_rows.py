"""Tree stress is made within a sentence's row: no joins, and as many tables for a deep tree as for a flat one."""

from metrika.operators import trees

SCHEMA = "text_id string, sent_num int, node string, parent string, label string, word_num int, lstress double"


def test_no_join_and_no_table_a_round(spark, monkeypatch):
    plans = []
    write = trees.written
    monkeypatch.setattr(trees, "written", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag))
    deep = [("t", 1, f"p{n}", f"p{n - 1}", "VP", None, 0.0) for n in range(300)] + [("t", 1, f"w{n}", f"p{n}", "NN", n, 0.0) for n in range(300)]
    out = trees.tree_stress(spark.createDataFrame(deep, SCHEMA))
    # A leaf (w) stands after its sister phrase (p), so it heads every phrase; the phrase below it loses one.
    assert {r.word_num: r.total for r in out.collect()} == {n: -float(n) for n in range(300)}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5
    assert not any("Join" in plan for plan in plans)
