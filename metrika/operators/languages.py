"""Language detection by profiles of letter trigrams, learned from labelled texts.

A profile is a table of the most frequent trigrams of each language with their
smoothed log-probabilities in thousandths, at most GRAMS a language. It meets the
trigrams of the texts by broadcast behind a check of its rows, and sums by text
are made before the shuffle, which carries a row a text and language.
"""

from __future__ import annotations

from collections import Counter
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from metrika.sources.scratch import written

from .tokens import spread

#: Trigrams of a language that its profile keeps, and rows up to which profiles are broadcast.
GRAMS, BROADCAST_ROWS = 3_000, 1_000_000


_GRAM = ArrayType(StructType([StructField("gram", StringType()), StructField("n", LongType())]))


def _count(plain: pa.Array) -> pa.Array:
    found = [None if s is None else list(Counter(map(add, map(add, s, s[1:]), s[2:])).items()) for s in plain.to_pylist()]
    offsets = np.cumsum([0, *(len(x or ()) for x in found)]).astype(np.int32)
    grams, many = pa.array([g for x in found for g, _ in x or ()], pa.string()), pa.array([n for x in found for _, n in x or ()], pa.int64())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([grams, many], names=["gram", "n"]))


# As if not deterministic: else a filter of what it returns would run it a second time below.
_counted = F.arrow_udf(_count, _GRAM).asNondeterministic()


def trigrams(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, gram, n: each text's distinct trigrams of letters in lower case and how often it has them.

    Everything but letters is one space, also in front and at the end. A text's trigrams are counted in its own row,
    so that only distinct ones become rows.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), F.lit(" "))
    return texts.select(*keys, _counted(plain).alias("g")).select(*keys, F.inline_outer("g")).where("gram is not null")


def profiles(labelled: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, gram, weight): round(1000 * ln((n + 1) / (N + 1))) for the GRAMS most frequent of each language, ties by gram.

    Rows without text or language teach nothing.
    """
    known = labelled.where("text is not null and lang is not null")
    # Not by the text: its copies would meet in one part.
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = trigrams(known.select("lang", "text"), "lang").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= GRAMS).join(F.broadcast(whole), "lang")
    return kept.select("lang", "gram", F.round(1000 * F.log((F.col("n") + 1) / (F.col("whole") + 1))).cast("int").alias("weight"))


def detected(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_id, text) and profiles -> (text_id, lang): the language of the highest sum of weights, ties to the first by name.

    A trigram that a profile lacks counts as one of a language's unseen ones,
    1000 * ln(1 / (N + 1)) being the same for every language up to the size of
    its sample; the least weight of all profiles less 1000 is taken for all, so
    only what the profiles hold has to be summed. Texts that share no trigram
    with any profile, null and empty texts have a null language. Repeated
    text_ids count as one text.
    """
    known = written(known, "profiles")  # three things read it; each would learn it again
    least = known.agg(F.min("weight")).first()[0]
    known = known.select("lang", "gram", (F.col("weight") - F.lit(least or 0) + 1_000).alias("gain"))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    grams = trigrams(spread(texts, "text_id"), "text_id")
    sums = grams.join(known, "gram").groupBy("text_id", "lang").agg(F.sum(F.col("gain") * F.col("n")).alias("score"))
    best = sums.groupBy("text_id").agg(F.min_by("lang", F.struct((-F.col("score")).alias("s"), "lang")).alias("lang"))
    return texts.select("text_id").distinct().join(best, "text_id", "left")
