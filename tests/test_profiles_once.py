"""Profiles are learned once, and a text's trigrams become rows once a distinct one."""

from metrika.operators import languages
from metrika.plans import language_queries

SF = "/root/testdata/sf0.001"


def test_detection_reads_the_labelled_texts_no_more(spark):
    plan = language_queries.language_profiles(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "profiles-" in plan


def test_trigrams_of_odd_texts(spark):
    rows = [(1, "Aa, aA aa!"), (2, None), (3, ""), (4, "12 ?"), (5, "é")]
    found = languages.trigrams(spark.createDataFrame(rows, "text_id long, text string"), "text_id")
    at = {(r.text_id, r.gram): r.n for r in found.collect()}
    assert at == {(1, " aa"): 3, (1, "aa "): 3, (1, "a a"): 2, (5, " é "): 1}
