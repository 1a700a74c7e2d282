"""A step of the MaxEnt fit is one pass over the rhythms: nothing is joined."""

from pyspark.sql import functions as F

from metrika.operators import maxent, parse
from metrika.plans import parse_queries

SF = "/root/testdata/sf0.001"


def test_steps_join_nothing(spark, monkeypatch):
    rows = parse_queries.observed_rhythms(spark, SF).where(F.col("n") <= 8).persist()
    rows.count()

    def refused(*_, **__):
        raise AssertionError("rhythms are joined")

    monkeypatch.setattr(type(rows), "join", refused)
    model = maxent.fit_rhythms(rows, parse.DEFAULT.key, list(parse.DEFAULT.names), rounds=3)
    assert model.iterations and any(w > 0 for w in model.weights.values())
