"""The pair counts of the learned sentence statistics are made once."""

import pytest

from metrika.operators import punkt
from metrika.plans import sentence_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["punkt_starters", "punkt_collocations"])
def test_texts_are_read_once(spark, name):
    plan = sentence_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "regexp_extract_all" not in plan


def test_verdicts_read_the_texts_once(spark, monkeypatch):
    made = []
    counted = punkt.pair_counts
    monkeypatch.setattr(punkt, "pair_counts", lambda texts: made.append(1) or counted(texts))
    texts = spark.createDataFrame([(1, "Dr. Who came. He left."), (2, None)], "doc_id long, text string")
    out = punkt.sentences(texts)
    assert made == [1]
    assert [(r.text_id, r.sent_num, r.sentence) for r in out.orderBy("sent_num").collect()] == [(1, 1, "Dr. Who came."), (1, 2, " He left.")]
