"""Rhyme queries read the texts once, meet by sides that Spark may not broadcast by a guess, and measure a rime once."""

import pytest
from pyspark.sql import functions as F

from metrika.functions import segments
from metrika.operators import rhyme, tokens
from metrika.plans import analysis_queries, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rhyme_ids_by_features", "summary_rows", "scheme_match", "is_sonnet", "rhyme_edges"])
def test_texts_are_read_once(spark, monkeypatch, name):
    write, plans = rhyme.written, []

    def watched(df, tag):
        plans.append(plan(df))
        return write(df, tag)

    monkeypatch.setattr(rhyme, "written", watched)
    monkeypatch.setattr(analysis_queries, "written", watched)
    plans.append(plan(registry.QUERIES[name](spark, SF)))
    assert sum(p.split("== Initial Plan ==")[0].count("documents.parquet") for p in plans) == 1
    # Tables of schemes and window sizes are fixed and small; they have no key in common with texts.
    assert not any("BroadcastHashJoin [text_id" in p or "BroadcastHashJoin [a#" in p for p in plans)


def test_last_words_equal_those_of_whole_lines(spark):
    texts = ["one two\n 3 four 5\n!!\n'tis o'er_ 9a9 --\nÉté; ñ'", "", "12 34", None, "a" * 3000 + " 1", "’twas “said”\r\nx_y z_1 _"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    last = lambda df: {(r.text_id, r.line_num): r.w for r in df.select("text_id", "line_num", F.element_at("words", -1).alias("w")).collect()}
    got = last(tokens.line_ends(rows))
    assert got == last(tokens.whole_lines(rows)) and len(got) == 7


def test_written_distances_equal_those_of_expressions(spark):
    rimes = ["", "%", "a", "at", "ãt", "iː", "eɪn", "o", "ʰat", "atʷ", "ssst", "oːnnd", "ablestandig", None]
    rows = spark.createDataFrame([(a, b) for a in rimes for b in rimes], "a string, b string")
    wanted = {(r.a, r.b): r.d for r in rows.withColumn("d", segments.rime_distance(F.col("a"), F.col("b"))).collect()}
    got = {(r.a, r.b): r.dist for r in rhyme.distinct_distances(rows).collect()}
    assert {k: got[k] for k in wanted if None not in k} == {k: d for k, d in wanted.items() if None not in k}
    assert got["a", None] is None and got[None, "a"] is None
