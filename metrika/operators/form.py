"""Poem-level analysis: meter type, line-length templates, sonnets, summaries."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import let

TERNARY = 0.175
# Names of lines by their number of beats.
BEATS = {1: "Monometer", 2: "Dimeter", 3: "Trimeter", 4: "Tetrameter", 5: "Pentameter", 6: "Hexameter", 7: "Heptameter", 8: "Octameter"}


def meter_type(best: DataFrame, ambiguity: str | None = None) -> DataFrame:
    """Best parses (text_id, positions, meter) -> foot, head and type of each text, with the frequencies that decide.

    Ternary if over 17.5 % of the positions are ww; the head is initial if over
    half (ternary) or under half (binary) of the fourth syllables are strong.
    `ambiguity` names a column of parse counts for the geometric mean.
    """
    parts = F.split("positions", r"\|")
    many = lambda kind: F.size(F.filter(parts, lambda p: p == kind))
    fourth = F.substring("meter", 4, 1)
    aggregates = [
        F.count("*").alias("n_lines"),
        F.sum(F.size(parts)).alias("n_positions"),
        *(F.sum(many(k)).alias(f"n_{k}") for k in ("w", "s", "ww", "ss")),
        F.sum((F.length("meter") >= 4).cast("int")).alias("n_fourth"),
        F.sum((fourth == "s").cast("int")).alias("n_fourth_s"),
    ]
    if ambiguity:
        aggregates.append(F.round(F.exp(F.avg(F.log(ambiguity))), 6).alias("ambiguity"))
    rows = best.groupBy("text_id").agg(*aggregates)
    share = F.when(F.col("n_fourth") > 0, F.col("n_fourth_s") / F.col("n_fourth")).otherwise(0.0)
    foot = F.when(F.col("n_ww") / F.col("n_positions") > TERNARY, "ternary").otherwise("binary")
    rows = rows.withColumn("foot", foot)
    initial = F.when(F.col("foot") == "ternary", share > 0.5).otherwise(share < 0.5)
    rows = rows.withColumn("head", F.when(initial, "initial").otherwise("final"))
    kind = (
        F.when((F.col("foot") == "ternary") & (F.col("head") == "final"), "anapestic")
        .when(F.col("foot") == "ternary", "dactylic")
        .when(F.col("head") == "initial", "trochaic")
        .otherwise("iambic")
    )
    return rows.withColumn("type", kind)


def best_template(lengths: list[int], beat: bool) -> tuple[tuple[int, ...] | None, int | None]:
    """The repeating template of line lengths that fits best, and its difference.

    Templates of 1 to 10 positions that divide the number of lines, each position
    within one of its median; differences count twice for beats, odd syllable
    counts cost 5 each, a variable template 1; ties go to the shorter, then to
    the first in order.
    """
    best, diff = None, None
    n = len(lengths)
    for k in range(1, min(n, 10) + 1):
        if n % k:
            continue
        table = np.array(lengths, np.int64).reshape(-1, k)
        middle = np.sort(table, axis=0)
        half = middle.shape[0] // 2
        median = middle[half] if middle.shape[0] % 2 else ((middle[half - 1] + middle[half]) / 2).astype(np.int64)
        options = median[:, None] + np.array([-1, 0, 1])[None, :]
        cost = np.abs(table[:, :, None] - options[None, :, :]).sum(axis=0) * (2 if beat else 1)
        if not beat:
            cost = cost + 5 * (options % 2 != 0)
        total = np.zeros(1, np.int64)
        for p in range(k):
            total = (total[:, None] + cost[p][None, :]).ravel()
        if k > 1:
            total = total + 1
            for value in set(options[0]).intersection(*map(set, options[1:])):
                total[int(sum(int(value - options[p, 0]) * 3 ** (k - 1 - p) for p in range(k)))] = np.iinfo(np.int64).max // 2
        at = int(total.argmin())
        if diff is None or total[at] < diff:
            diff = int(total[at])
            picks = np.unravel_index(at, (3,) * k)
            best = tuple(int(options[p, picks[p]]) for p in range(k))
    return best, diff


def line_scheme(lengths: DataFrame, beat: bool) -> DataFrame:
    """(text_id, line_num, length) -> text_id, scheme ('4-3'), diff: an Arrow function per text over its line lengths."""
    texts = lengths.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("line_num", "length"))).alias("r"))

    @F.pandas_udf("scheme string, diff long")
    def found(rows: pd.Series) -> pd.DataFrame:
        out = [best_template(list(r), beat) for r in rows]
        return pd.DataFrame({"scheme": ["-".join(map(str, b)) if b else None for b, _ in out], "diff": [d for _, d in out]})

    return texts.select("text_id", found(F.transform("r", lambda x: x["length"].cast("int"))).alias("f")).select("text_id", "f.scheme", "f.diff")


def scheme_type(scheme: Column) -> Column:
    size = F.size(F.split(scheme, "-"))
    return F.when(size == 1, "Invariable").when(size == 2, "Alternating").otherwise("Complex")


def scheme_repr(scheme: Column, beat: bool = False) -> Column:
    """A readable label: the beat's name, or 'Alternating (4-3)'."""
    names = F.create_map(*itertools.chain.from_iterable((F.lit(str(k)), F.lit(v)) for k, v in BEATS.items()))
    kind = scheme_type(scheme)

    def label(parts: Column) -> Column:
        named = F.transform(parts, lambda p: F.coalesce(F.element_at(names, p), p)) if beat else parts
        shown = F.when(kind == "Complex", parts).otherwise(named)
        return F.when(kind == "Invariable", F.element_at(shown, 1)).otherwise(F.concat(kind, F.lit(" ("), F.lower(F.array_join(shown, "-")), F.lit(")")))

    return let(F.split(scheme, "-"), label)


def median_cut(values: Column) -> Column:
    """The median of an array, cut to a whole number."""

    def middle(s: Column) -> Column:
        low = F.floor((F.size(s) + 1) / 2).cast("int")
        high = F.floor(F.size(s) / 2).cast("int") + 1
        return F.floor((F.element_at(s, low) + F.element_at(s, high)) / 2).cast("int")

    return let(F.array_sort(values), middle)


def sonnets(lengths: DataFrame, matches: DataFrame) -> DataFrame:
    """(text_id, line_num, length) and best schemes -> text_id, n_lines, median_sylls, is_sonnet, is_shakespearean_sonnet."""
    texts = lengths.groupBy("text_id").agg(F.count("*").alias("n_lines"), F.collect_list("length").alias("l"))
    texts = texts.select("text_id", "n_lines", median_cut(F.col("l")).alias("median_sylls"))
    name = F.lower(F.coalesce("form", F.lit("")))
    rows = texts.join(matches.where("rank = 1").select("text_id", "form"), "text_id", "left")
    sonnet = (F.col("n_lines") == 14) & F.col("median_sylls").between(9, 11) & name.contains("sonnet")
    return rows.select(
        "text_id", "n_lines", "median_sylls", sonnet.alias("is_sonnet"),
        (sonnet & name.contains("shakespeare")).alias("is_shakespearean_sonnet"),
    )
