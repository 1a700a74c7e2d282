"""Tokens of whole texts leave Python as syllables: no token is a row on its way, and each distinct one is told once."""

import pyarrow as pa
from pyspark.sql import functions as F

from metrika.operators import sylls, tokens
from metrika.plans import registry

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "He said: \"No.\" 'Go,' she could.\n\n  All's well\x01--that’s—it ²3 brrr\x1f!"), (2, None), (3, ""), (4, "--"), (5, "x"), (6, "\x1f"),
    (7, "&mdash;O\u0085\n \nÉté Œuvre İstanbul all THE &amp;c. (Would I?) 12 a1 _b '' banana-split"), (8, "word " * 50),
]


def told(df):
    return sorted(map(tuple, df.collect()))


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def test_syllables_equal_those_of_the_tokens(spark):
    for docs in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        plain = sylls.syllables(tokens.tokens(docs))
        found = sylls.syllables_of(docs)
        assert found.dtypes == plain.dtypes
        assert told(found) == told(plain)


def test_no_token_is_a_row(spark):
    plan = registry.QUERIES["syllable_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_tokens_are_forgotten_and_known_again(monkeypatch):
    found = [tokens.T.tokens_of(tokens.T.cleaned(t)) for _, t in ODD if t]
    ids = pa.array(range(len(found)))
    told = lambda: [c.to_pylist() for c in sylls._spelled_out(ids, found)]
    first = told()
    monkeypatch.setattr(sylls._Spoken, "MOST", 3)
    assert told() == first == told()


def test_more_tokens_than_are_taken_together(spark):
    docs = spark.createDataFrame([(k, f"Over all the hills, {k} times\n" * 4_000) for k in range(24)], "doc_id long, text string")
    sums = lambda df: df.groupBy("text_id").agg(F.count("*"), F.sum(F.xxhash64(*df.columns) % 1_000_003))
    assert told(sums(sylls.syllables_of(docs))) == told(sums(sylls.syllables(tokens.tokens(docs))))
