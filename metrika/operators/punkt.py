"""Sentences by unsupervised statistics of full stops (Kiss and Strunk, 2006), learned from the texts as aggregations.

Every text is reduced to its pairs of neighbouring tokens, and the pairs to
counts; what follows works on counts alone:

* abbreviations: types whose full stops are no accident, by a log-likelihood
  ratio scaled by length, inner stops and uses without a stop;
* sentence starters: types that stand after sure sentence ends more often than
  by chance;
* collocations: pairs around a stop that belong together;
* upper and lower case of each type within and at the beginning of sentences.

A stop is judged by its pair of types, so the verdicts are a table of the pairs
that do not end a sentence, which meets the texts' pieces in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.functions import text as T
from metrika.sources.scratch import dealt, written

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.'’-]*[!?]*"
NUMBER = "##"
#: Thresholds of the published method: abbreviation, starter, collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
# Abbreviations that hold whatever the texts say.
KNOWN = ["dr", "mr", "mrs", "ms", "prof", "st", "jr", "sr", "vs", "e.g", "i.e", "cf", "no", "vol", "z.b", "d.h", "sra", "mme", "mlle"]
#: Verdicts up to so many rows are joined by broadcast.
FEW = 1_000_000


def token_type(token: Column) -> Column:
    """Lower-cased without the stops at its end; all numbers are one type."""
    core = F.regexp_replace(token, r"[.!?]+$", "")
    return F.when(core.rlike(r"^\p{N}[\p{N}.-]*$"), NUMBER).otherwise(F.lower(core))


def _case(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{Lu}"), "U").when(token.rlike(r"^\p{Ll}"), "L").otherwise("N")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, dot, stop, b, case, n): counts of neighbouring tokens; dot and stop say how a ends, b is null after the last token."""
    found = F.regexp_extract_all(T.normalize_dashes(F.col("text")), F.lit(TOKEN), F.lit(0))
    pairs = F.arrays_zip(found.alias("a"), F.slice(found, 2, 1 << 30).alias("b"))
    rows = texts.where("text is not null").select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    return (
        rows.select(
            token_type(F.col("a")).alias("a"),
            F.col("a").rlike(r"\.$").alias("dot"),
            F.col("a").rlike("[!?]$").alias("stop"),
            token_type(F.col("b")).alias("b"),
            F.when(F.col("b").isNotNull(), _case(F.col("b"))).alias("case"),
        )
        .groupBy("a", "dot", "stop", "b", "case")
        .agg(F.count("*").alias("n"))
    )


def learned(texts: DataFrame) -> DataFrame:
    """`pair_counts`, written: what is learned reads the counts many times, the texts once."""
    return written(pair_counts(texts), "pairs")


def _log_times(k: Column, p: Column) -> Column:
    """k * ln(p), nothing for no trials."""
    return F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(p))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    return _log_times(k, p) + _log_times(n - k, 1 - p)


def association(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair that occurs `ab` times, its parts `a` and `b` times, among n tokens."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    apart = _likelihood(ab, a, p) + _likelihood(b - ab, n - a, p)
    return 2 * (_likelihood(ab, a, p1) + _likelihood(b - ab, n - a, p2) - apart)


def type_counts(pairs: DataFrame) -> DataFrame:
    """(type, n, n_dot, score): every type's tokens, those with a stop, and the likelihood of being an abbreviation (null for numbers)."""
    types = pairs.groupBy(F.col("a").alias("type")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("n_dot"))
    total = pairs.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots"))
    chance = F.least(F.greatest(F.col("dots") / F.col("tokens"), F.lit(1e-9)), F.lit(1 - 1e-9))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = 2 * (_likelihood(F.col("n_dot"), F.col("n"), F.lit(0.99)) - _likelihood(F.col("n_dot"), F.col("n"), chance))
    inner = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.exp(-(F.col("n") - F.col("n_dot")) * F.log(letters))
    return types.crossJoin(F.broadcast(total)).select(
        "type", "n", "n_dot", F.when((F.col("type") != NUMBER) & (letters > 0), score).alias("score")
    )


def abbreviations(pairs: DataFrame, known: list[str] = KNOWN) -> DataFrame:
    """(type): learned abbreviations and the known ones that occur."""
    return type_counts(pairs).where((F.col("n_dot") > 0) & ((F.col("score") >= ABBREVIATION) | F.col("type").isin(known))).select("type")


def _marked(pairs: DataFrame, known: list[str]) -> DataFrame:
    """The pairs with `abbr`, whether a with its stop is an abbreviation, and `ends`, whether it surely ends a sentence."""
    short = abbreviations(pairs, known).select(F.col("type").alias("a"), F.lit(True).alias("short"))
    abbr = F.coalesce(F.col("short"), F.lit(False)) & F.col("dot")
    return pairs.join(short, "a", "left").withColumn("abbr", abbr).withColumn("ends", F.col("stop") | (F.col("dot") & ~F.col("abbr"))).drop("short")


def starters(pairs: DataFrame, known: list[str] = KNOWN) -> DataFrame:
    """(type, n, n_begin, score): types that begin sentences more often than by chance."""
    marked = _marked(pairs, known).where("b is not null")
    begun = marked.groupBy(F.col("b").alias("type")).agg(F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("n_begin"))
    total = pairs.agg(F.sum("n").alias("tokens"))
    ends = marked.agg(F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("breaks"))
    rows = begun.where("n_begin > 0").join(type_counts(pairs).select("type", "n"), "type").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(ends))
    rows = rows.withColumn("score", association(F.col("breaks"), F.col("n"), F.col("n_begin"), F.col("tokens")))
    more = F.col("tokens") * F.col("n_begin") > F.col("n") * F.col("breaks")
    return rows.where((F.col("score") >= STARTER) & more).select("type", "n", "n_begin", "score")


def _stopped(marked: DataFrame) -> DataFrame:
    """The pairs around a stop that may not end a sentence: after an abbreviation, an initial or a number."""
    initial = F.col("a").rlike(r"^\p{L}$")
    return marked.where(F.col("dot") & F.col("b").isNotNull() & (F.col("abbr") | initial | (F.col("a") == NUMBER))).withColumn("initial", initial)


def collocations(pairs: DataFrame, known: list[str] = KNOWN) -> DataFrame:
    """(a, b, n, score): pairs around a stop that belong together, b no sentence starter."""
    both = _stopped(_marked(pairs, known)).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    types = type_counts(pairs)
    rows = (
        both.join(types.select(F.col("type").alias("a"), F.col("n").alias("n_a")), "a")
        .join(types.select(F.col("type").alias("b"), F.col("n").alias("n_b")), "b")
        .join(starters(pairs, known).select(F.col("type").alias("b")), "b", "left_anti")
        .crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("tokens"))))
    )
    rows = rows.withColumn("score", association(F.col("n_a"), F.col("n_b"), F.col("n"), F.col("tokens")))
    return rows.where((F.col("score") >= COLLOCATION) & (F.col("tokens") * F.col("n") > F.col("n_a") * F.col("n_b"))).select("a", "b", "n", "score")


def cases(pairs: DataFrame, known: list[str] = KNOWN) -> DataFrame:
    """(b, lower, upper, lower_begin, upper_inside): how often each type is written how, after sure ends and after no stop at all."""
    counted = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    low, up = F.col("case") == "L", F.col("case") == "U"
    return _marked(pairs, known).where("b is not null").groupBy("b").agg(
        counted(low).alias("lower"), counted(up).alias("upper"), counted(low & F.col("ends")).alias("lower_begin"),
        counted(up & ~F.col("dot") & ~F.col("stop")).alias("upper_inside"),
    )


def held(pairs: DataFrame, known: list[str] = KNOWN) -> DataFrame:
    """(a, b, case): pairs whose stop does not end a sentence."""
    rows = _stopped(_marked(pairs, known)).join(cases(pairs, known), "b")
    rows = rows.join(starters(pairs, known).select(F.col("type").alias("b"), F.lit(True).alias("starter")), "b", "left")
    rows = rows.join(collocations(pairs, known).select("a", "b", F.lit(True).alias("together")), ["a", "b"], "left")
    up, low = F.col("case") == "U", F.col("case") == "L"
    begins = up & (F.col("lower") > 0) & (F.col("upper_inside") == 0)
    inside = low & ((F.col("upper") > 0) | (F.col("lower_begin") == 0))
    after_short = ~(begins | (up & F.col("starter").isNotNull()))
    after_one = F.col("abbr") | inside | (~begins & F.col("initial") & up & (F.col("lower") == 0))
    hold = F.col("together").isNotNull() | F.when(F.col("abbr") & ~F.col("initial"), after_short).otherwise(after_one)
    return rows.where(hold).select("a", "b", "case").distinct()


def sentences(texts: DataFrame, text_id: str = "doc_id", learn_from: DataFrame | None = None, known: list[str] = KNOWN) -> DataFrame:
    """(text_id, sent_num, sentence); white space between sentences stays in front of the later one.

    Texts are cut after `.`, `!` and `?` (and closing quotes and brackets) before
    white space; pieces whose stop `held` keeps are joined again. Statistics come
    from `learn_from`, or from the texts themselves. Null texts have no sentence,
    an empty one has one empty sentence; rows that repeat an id and a text count
    once. Verdicts are broadcast only while a count finds them few.
    """
    verdicts = written(held(learned(texts if learn_from is None else learn_from), known).withColumn("hold", F.lit(True)), "verdicts")
    few = verdicts.limit(FEW + 1).count() <= FEW
    plain = T.normalize_dashes(F.replace("text", F.lit("\u0001"), F.lit("")))
    marked = F.regexp_replace(plain, "([.!?]+[\"'”’)\\]]*)(\\s+)", "$1\u0001$2")
    rows = texts.where("text is not null").select(F.col(text_id).alias("text_id"), F.xxhash64("text").alias("hash"), "text", F.split(marked, "\u0001").alias("p"))
    pairs = F.arrays_zip(F.col("p").alias("piece"), F.slice("p", 2, 1 << 30).alias("next"))
    rows = rows.dropDuplicates(["text_id", "text"]).select("text_id", "hash", F.posexplode(pairs).alias("k", "x"))
    last = F.try_element_at(F.regexp_extract_all(F.col("x.piece"), F.lit(TOKEN), F.lit(0)), F.lit(-1))
    first = F.regexp_extract("x.next", TOKEN, 0)
    ending = F.regexp_replace("x.piece", "[\"'”’)\\]]+$", "")
    dotted = last.rlike(r"\.$") & F.endswith(ending, last)
    rows = rows.select("text_id", "hash", "k", F.col("x.piece").alias("piece"), F.when(dotted, token_type(last)).alias("a"), token_type(first).alias("b"), _case(first).alias("case"))
    rows = rows.join(F.broadcast(verdicts) if few else dealt(verdicts), ["a", "b", "case"], "left")
    pieces = F.array_sort(F.collect_list(F.struct("k", "piece", F.coalesce("hold", F.lit(False)).alias("hold"))))
    # Pieces of one text: what is held goes on in the next one.
    whole = F.array_join(F.transform(pieces, lambda x: F.concat(x["piece"], F.when(x["hold"], "").otherwise("\u0001"))), "")
    joined = F.split(F.regexp_replace(whole, "\u0001$", ""), "\u0001")
    out = rows.groupBy("text_id", "hash").agg(joined.alias("s"))
    return out.select("text_id", F.posexplode("s").alias("k", "sentence")).select("text_id", (F.col("k") + 1).alias("sent_num"), "sentence")
