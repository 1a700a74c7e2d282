"""Joins whose sides grow with the input are never broadcast by Spark's own guess of their size."""

from metrika.llm import common, minhash


def test_near_duplicates_broadcasts_no_side_by_a_guess(spark, monkeypatch):
    plans = []

    def watched(write):
        def run(df, tag):
            plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, tag)

        return run

    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)  # the broadcast behind a count
    monkeypatch.setattr(minhash, "written", watched(minhash.written))
    monkeypatch.setattr(common, "written", watched(common.written))
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text + " other"), (4, "alone"), (5, None)], "doc_id long, text string")
    out = minhash.near_duplicates(docs)
    assert [(r.doc_id, r.component_id) for r in out.orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"members", "edges", "links", "open"} <= {tag for tag, _ in plans}
    assert [tag for tag, plan in plans if "BroadcastHashJoin" in plan] == []
