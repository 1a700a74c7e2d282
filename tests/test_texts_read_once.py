"""Rhythms of whole texts are told in the text's own row, and scores over all scansions without making them."""

from pyspark.sql import functions as F

from metrika.operators import parse, texts, tokens, units
from metrika.plans import parse_queries

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Shall I compare thee\n \t\n to a summer’s day?\r\nThou art -- more lovely"), (2, None), (3, ""), (4, "\n\nAll day, 12 brrr: no_vowel &mdash;when&eacute; it's ‘so’"),
    (5, ",,;a be—see\x0b\n\x1c\nagain  and now .\n"), (6, "&amp;euml;té ÉTÉ Œuvre œil 3x ²nd (all, may; be) " + "banana " * 9), (7, "'"), (8, "a\nb\n\nc, d"),
]


def told(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def test_texts_give_the_rhythms_of_their_parts(spark):
    for docs in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = units.rhythms(tokens.line_parts(docs)).select(*texts.UNIT, *texts.RHYTHM)
        assert told(units.rhythms_of(docs).distinct()) == told(rows.select(*texts.RHYTHM).distinct())
        after = rows.select("text_id", "line_num", (F.col("linepart") - 1).alias("linepart"), *(F.col(k).alias(f"{k}2") for k in texts.RHYTHM))
        found = units.neighbours_of(docs).select(*texts.UNIT, *units.unpacked("a1", "a2"), *(c.alias(f"{k}2") for k, c in zip(texts.RHYTHM, units.unpacked("b1", "b2"), strict=True)))
        assert told(found) == told(rows.join(after, texts.UNIT))


def test_pieces_are_forgotten_and_known_again(monkeypatch):
    batch = [t for _, t in ODD]
    first = [x.tolist() for x in units._read(batch, 18, 2)]
    monkeypatch.setattr(units._Known, "MOST", 3)
    assert [x.tolist() for x in units._read(batch, 18, 2)] == first == [x.tolist() for x in units._read(batch, 18, 2)]


def test_scores_are_summed_without_scansions(spark, monkeypatch):
    encoded = units.variants(units.rhythms_of(odd(spark)))
    meter = parse.Meter(weights=parse_queries.WEIGHTS)
    plain = parse.scored(encoded, meter).groupBy(*meter.key).agg(F.min("score").alias("least"), F.avg("score").alias("mean"))
    expected = told(plain)

    def refused(*_):
        raise AssertionError("all scansions are made")

    monkeypatch.setattr(parse, "scored", refused)
    assert told(parse.score_range(encoded, meter)) == expected
    assert parse_queries.QUERIES["weighted_score"](spark, SF).count() > 0
