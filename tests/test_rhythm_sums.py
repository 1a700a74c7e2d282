"""Sums over scansions and relations of vectors are made within a rhythm's row, without its scansions."""

import pytest
from pyspark.sql import functions as F

from metrika.operators import parse, tokens, units
from metrika.plans import parse_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["viol_all", "bounding_relation"])
def test_no_scansion_is_made(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("all scansions are made")

    monkeypatch.setattr(parse, "scored", refused)
    assert parse_queries.QUERIES[name](spark, SF).count() > 0


def test_both_ways_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Shall I compare thee to a summer's day? Thou art"), (2, None), (3, "no vowel: brrr, all day")], "doc_id long, text string")
    encoded = units.encoded(tokens.line_parts(docs))
    meter = parse_queries.ALL_METER
    told = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    fast = told(parse.totals(encoded, meter)), told(parse.relations(encoded))
    monkeypatch.setattr(parse, "local", lambda meter: False)
    assert fast == (told(parse.totals(encoded, meter)), told(parse.relations(encoded)))


def test_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    encoded = units.encoded(tokens.line_parts(docs))
    assert parse.totals(encoded).count() == 0 == parse.relations(encoded).agg(F.count("*")).first()[0]
