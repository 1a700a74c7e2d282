"""Texts, stanzas, lines, sentences and words as tables: going up and down between them, spans, flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Number columns of the token table by entity, from the outside in.
LEVELS = {"stanza": "para_num", "line": "line_num", "sent": "sent_num", "sentpart": "sentpart_num", "linepart": "linepart_num"}


def entities(tokens: DataFrame, level: str) -> DataFrame:
    """One row for each stanza, line, ...: text_id, num, first_word, last_word, n_words (with a letter), n_tokens, stanza, txt.

    A line's stanza is the one its first token stands in.
    """
    num = LEVELS[level]
    return tokens.groupBy("text_id", F.col(num).alias("num")).agg(
        F.min("word_num").alias("first_word"),
        F.max("word_num").alias("last_word"),
        F.count(F.when(F.col("is_punc") == 0, 1)).alias("n_words"),
        F.count("*").alias("n_tokens"),
        F.min("para_num").alias("stanza"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "word_txt"))), lambda x: x["word_txt"]), "")).alias("txt"),
    )


def nth(tokens: DataFrame, level: str, k: int) -> DataFrame:
    """The tokens of the k-th stanza, line, ... of every text."""
    return tokens.where(F.col(LEVELS[level]) == k)


def limited(tokens: DataFrame, lines: int) -> DataFrame:
    """The tokens of each text's first lines."""
    return tokens.where(F.col("line_num") <= lines)


def within(tokens: DataFrame, inner: str, outer: str) -> DataFrame:
    """text_id, outer_num, inner_num, whole: which inner entities share tokens with which outer ones, and whether they lie inside.

    Entities of both levels meet in the tokens they share, so nothing is joined.
    """
    pairs = tokens.groupBy("text_id", F.col(LEVELS[outer]).alias("outer_num"), F.col(LEVELS[inner]).alias("inner_num")).agg(F.count("*").alias("n"))
    parts = Window.partitionBy("text_id", "inner_num")
    return pairs.select("text_id", "outer_num", "inner_num", (F.count("*").over(parts) == 1).alias("whole"))


def forms(sylls: DataFrame, first: bool = True) -> DataFrame:
    """text_id, word_num, form_idx, sylls: the first pronunciation of every word, or all of them."""
    rows = sylls.where("form_idx >= 0")
    rows = rows.where("form_idx = 0") if first else rows
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syll_idx", "syll_ipa"))), lambda x: x["syll_ipa"]), ".")
    return rows.groupBy("text_id", "word_num", "form_idx").agg(put.alias("sylls"))


def median_sylls(sylls: DataFrame) -> DataFrame:
    """text_id, word_num, median: the rounded median number of syllables over a word's pronunciations."""
    sizes = sylls.where("form_idx >= 0").groupBy("text_id", "word_num", "form_idx").agg(F.count("*").alias("n"))
    return sizes.groupBy("text_id", "word_num").agg(F.bround(F.percentile("n", 0.5)).cast("int").alias("median"))


def flat(sylls: DataFrame, segments: DataFrame) -> DataFrame:
    """Syllables of first forms with one row for each letter and its segment's features (null where it is none)."""
    rows = sylls.where("form_idx = 0").select("text_id", "word_num", "syll_idx", F.posexplode(F.split("syll_text", "")).alias("phon_idx", "ipa"))
    return rows.join(F.broadcast(segments), "ipa", "left")


def indexed(rows: DataFrame, columns: list[str], fill: int = 0) -> DataFrame:
    """Missing numbers of the index columns filled, and the rows in their order."""
    return rows.na.fill(fill, columns).orderBy(*columns)


def unique(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, by `order`, of each distinct combination."""
    w = Window.partitionBy(*columns).orderBy(order)
    return rows.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")
