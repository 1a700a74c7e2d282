"""Tokens are numbered and pronounced in their text's own row: nothing is sorted, and no text or word is read twice."""

import pytest

from metrika.operators import sylls, tokens
from metrika.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["syllable_table", "first_forms", "median_syllables"])
def test_texts_are_dealt_out_once_and_tokens_never(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert plan.count("ArrowEvalPython") == 2


@pytest.mark.parametrize("name", ["flat_segments", "sylls_per_line"])
def test_sums_by_text_make_no_table_of_syllables(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "syll_ipa" not in plan


def test_units_are_read_once(spark):
    plan = registry.QUERIES["unit_masks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_odd_texts(spark):
    rows = [(1, 'He said "No." "Go," I don\'t.\n\nEnd'), (2, None), (3, ""), (4, "--"), (5, "x")]
    found = tokens.tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    at = {(r.text_id, r.word_num): r for r in found.collect()}
    assert {k for k, _ in at} == {1, 4, 5}
    end = at[1, max(n for k, n in at if k == 1)]
    assert (end.word_txt, end.para_num, end.line_num, end.sent_num) == ("\n\nEnd", 2, 2, 3)
    words = {r.sylls for r in sylls.first_forms(found).where("text_id = 1").collect()}
    assert "'don't" in words  # an apostrophe of the spelling is no stress mark
    assert [r.word_num for r in sylls.median_sylls(found).where("text_id = 5").collect()] == []
