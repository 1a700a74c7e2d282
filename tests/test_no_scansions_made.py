"""Queries that need no list of all scansions don't make one."""

import pytest

from metrika.operators import parse, texts
from metrika.plans import parse_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["maxent_predict", "maxent_accuracy"])
def test_sums_over_scansions_are_made_without_them(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("all scansions are made")

    monkeypatch.setattr(parse, "scored", refused)
    assert parse_queries.QUERIES[name](spark, SF).count() > 0


def test_best_parses_of_texts_need_no_lists(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all undominated scansions are listed")

    monkeypatch.setattr(texts, "parse_lists", refused)
    docs = spark.createDataFrame([(1, "Shall I compare thee to a summer's day?")], "doc_id long, text string")
    rows = texts.parse_texts(docs).collect()
    assert [(r.parse_rank, r.is_best, r.is_bounded) for r in rows] == [(1, True, False)]
