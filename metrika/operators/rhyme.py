"""Rhyme: rimes of line ends, nearest neighbours, rhyme groups and named rhyme schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrika.functions import ortho, segments
from metrika.sources.scratch import dealt, discard, written

from .units import let

# The named rhyme schemes in catalogue order.
SCHEMES = [
    ("Couplet", "aa"), ("Alternating A", "abab"), ("Alternating B", "abcb"), ("Aternating C", "ababa"),
    ("Alternating D", "ababb"), ("Alternating E", "ababab"), ("Sestet A", "aabccb"), ("Sestet B", "ababcc"),
    ("Triplet", "aaa"), ("4-Rhyme", "aaaa"), ("Sonnet, Petrarchan A", "abba abba cdecde"),
    ("Sonnet, Petrarchan B", "abba abba cdcdcd"), ("Sonnet, Petrarchan C", "abba abba ccdccd"),
    ("Sonnet, Petrarchan D", "abba abba cdcdee"), ("Sonnet, Petrarchan E", "abba abba cddece"),
    ("Sonnet, Shakespearean", "abab cdcd efefgg"), ("Sonnet, Spenserian", "abab bcbc cdcdee"),
    ("Sonnet A", "abab cdcd eefeff"), ("Sonnet B", "abab cdcd effegg"), ("Sonnet C", "abab abab cdcdcd"),
    ("Sonnet D", "abab abab cdcdee"), ("Sonnet E", "abab cbcd cdedee"), ("Sonnet F", "abba abba cbbcbc"),
    ("Sonnet G", "abba acca ddeffe"), ("Sonnet H", "abba cddc efefef"), ("Sonnet I", "abba cddc effegg"),
    ("Sonnet J", "abba cddc efgefg"), ("Sonnet J", "abbabacd cddeee"), ("Sonnet C", "ababacdc edefef"),
    ("Sonnet D", "ababbcdc ceceff"), ("Ottava Rima", "abababcc"), ("Rhyme Royal", "ababbcc"),
    ("Spenserian Stanza", "ababbcbcc"), ("Enclosed Rhyme", "abba"), ("Scottish Stanza", "aaabab"),
    ("Quatrain And Triplet", "ababccc"), ("Octet", "aaab cccb"), ("Monk'S Tale Stanza", "ababbcbc"),
]
MAX_DISTANCE, WINDOW = 0.35, 4


def rime_of_word(word: Column) -> Column:
    """From the last syllable's vowel on; with a stressed syllable before an unstressed last one, from that one's vowel."""

    def made(chunks: Column) -> Column:
        n = F.size(chunks)
        last, before = F.get(chunks, n - 1), F.get(chunks, n - 2)
        zero = F.lit(0)
        weak = ~ortho.stressed(word, n, n - 1, zero) & (n > 1)
        two = weak & ortho.stressed(word, n, n - 2, zero)
        return F.when(n == 0, F.lit(None)).when(two, F.concat(ortho.rime(before), last)).otherwise(ortho.rime(last))

    return let(ortho.syllables(word), made)


def line_ends(lines: DataFrame, *others: Column) -> DataFrame:
    """(text_id, line_num, words) -> text_id, line_num, word (the last, lower case), `others`, rime."""
    word = F.lower(F.element_at("words", -1))
    return lines.select("text_id", "line_num", word.alias("word"), *others).withColumn("rime", rime_of_word(F.col("word")))


# Accented letters and their base letters.
ACCENTED, BASE = "àáâãäåæèéêëìíîïòóôõöøœùúûüÿçñß", "aaaaaaaeeeeiiiiooooooouuuuycns"


def spelling_distance(a: Column, b: Column) -> Column:
    """Edit distance of base letters over the longer length: the built-in stand-in for the feature edit distance."""
    a, b = F.translate(a, ACCENTED, BASE), F.translate(b, ACCENTED, BASE)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def distinct_distances(pairs: DataFrame) -> DataFrame:
    """(a, b) -> a, b, dist: the feature edit distance, once for each distinct pair; features are read once for each distinct rime."""
    distinct = pairs.select("a", "b").distinct()
    # Few bytes but much work each: as many parts as a shuffle has.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rimes = distinct.select(F.explode(F.array("a", "b")).alias("r")).where("r is not null").distinct().repartition(parts, "r")
    rimes = rimes.withColumn("v", segments.written_features(F.col("r")))
    for k in ("a", "b"):
        distinct = distinct.join(dealt(rimes.select(F.col("r").alias(k), F.col("v").alias(f"v{k}"))), k, "left")
    dist = F.when(F.col("a") == F.col("b"), 0.0).otherwise(segments.written_distance(F.col("va"), F.col("vb")))
    return distinct.select("a", "b", dist.alias("dist"))


def rime_distances(pairs: DataFrame, max_dist: float | None = MAX_DISTANCE) -> DataFrame:
    """(w1, w2, r1, r2: words and their rimes as segments) -> adds dist, by features.

    Null for equal words and missing rimes, 0 for equal rimes; else the feature
    edit distance of the rimes, null beyond max_dist (0: equal rimes alone; None:
    no limit). Distances are computed once for each distinct pair of rimes.
    """
    rows = pairs.withColumns({"a": F.least("r1", "r2"), "b": F.greatest("r1", "r2")})
    able = (F.col("w1") != F.col("w2")) & F.col("r1").isNotNull() & F.col("r2").isNotNull()
    if max_dist == 0:
        return rows.withColumn("dist", F.when(able & (F.col("r1") == F.col("r2")), 0.0)).drop("a", "b")
    far = distinct_distances(rows.where(able & (F.col("r1") != F.col("r2")))).withColumnRenamed("dist", "far")
    dist = F.when(able & (F.col("r1") == F.col("r2")), 0.0).when(able, F.col("far"))
    out = rows.join(dealt(far), ["a", "b"], "left").withColumn("dist", dist).drop("a", "b", "far")
    return out if max_dist is None else out.withColumn("dist", F.when(F.col("dist") <= max_dist, F.col("dist")))


def neighbours(ends: DataFrame, window: int = WINDOW, by: str = "spelling") -> DataFrame:
    """text_id, i, j, dist of lines at most `window` apart, both ways; equal words and missing rimes give no row.

    Distances by 'spelling' (of base letters) or by 'features' (of segments).
    An equi-join on (text, line): each line is sent to the `window` places after
    it where it is wanted, so no text's lines meet in one task; a pair is made
    once and read both ways.
    """
    sent = ends.where("rime is not null").select(
        "text_id", F.col("line_num").alias("i"), F.col("word").alias("wi"), F.col("rime").alias("ri"),
        F.explode(F.array(*(F.col("line_num") + k for k in range(1, window + 1)))).alias("line_num"),
    )
    after = ends.where("rime is not null").select("text_id", "line_num", "word", "rime")
    both = sent.join(dealt(after), ["text_id", "line_num"]).where("wi <> word").withColumnRenamed("line_num", "j")
    if by == "spelling":
        dist = F.when(F.col("ri") == F.col("rime"), 0.0).otherwise(spelling_distance(F.col("ri"), F.col("rime")))
        met = both.select("text_id", "i", "j", dist.alias("dist"))
    elif by == "features":
        both = both.select("text_id", "i", "j", F.least("ri", "rime").alias("a"), F.greatest("ri", "rime").alias("b"))
        met = both.join(dealt(distinct_distances(both)), ["a", "b"])
    else:
        raise ValueError(f"unknown distance: {by}")
    ways = F.array(F.struct("i", "j", "dist"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return met.select("text_id", F.inline(ways))


def _nearest(ends: DataFrame, max_dist: float, window: int, by: str) -> DataFrame:
    """text_id, i, j, mutual: each line's nearest neighbour (ties to the earlier line), if it links with it."""
    near = neighbours(ends, window, by).groupBy("text_id", "i").agg(F.min(F.struct("dist", "j")).alias("m"))
    near = written(near.select("text_id", "i", "m.dist", "m.j"), "near")
    back = near.select("text_id", F.col("i").alias("j"), F.col("j").alias("back"))
    rows = near.join(dealt(back), ["text_id", "j"], "left").withColumn("mutual", F.coalesce(F.col("back") == F.col("i"), F.lit(False)))
    return rows.where((F.col("dist") <= max_dist) & (F.col("mutual") | (F.col("dist") <= max_dist / 2))).select("text_id", "i", "j", "mutual")


def rhyme_edges(ends: DataFrame, max_dist: float = MAX_DISTANCE, window: int = WINDOW, by: str = "spelling") -> DataFrame:
    """text_id, a, b (a < b): a line and its nearest neighbour, if mutual within max_dist or one-way within half of it."""
    return _nearest(written(ends, "ends"), max_dist, window, by).select("text_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def rhyme_ids(lines: DataFrame, max_dist: float = MAX_DISTANCE, window: int = WINDOW, by: str = "spelling") -> DataFrame:
    """text_id, line_num, rhyme_id for every line: 0 without rhyme, else groups from 1 by first appearance.

    Every line links with one other at most, and such links end in a mutual pair
    or in a line without a link of its own (ties go to the earlier line, so there
    are no longer circles). So a group is where its lines lead to: pointers are
    doubled in joins by line until none moves, whatever the length of a text.
    """
    return rhyme_ids_of(written(line_ends(lines), "ends"), max_dist, window, by)


def rhyme_ids_of(ends: DataFrame, max_dist: float = MAX_DISTANCE, window: int = WINDOW, by: str = "spelling") -> DataFrame:
    """`rhyme_ids` of line ends (text_id, line_num, word, rime), which are read several times and best written before."""
    near = _nearest(ends, max_dist, window, by)
    # The earlier line of a mutual pair points to itself, as does a line that others lead to and that leads nowhere.
    out = near.select("text_id", "i", F.when(F.col("mutual") & (F.col("i") < F.col("j")), F.col("i")).otherwise(F.col("j")).alias("to"))
    at = written(out, "rhymes")
    while True:
        on = at.select("text_id", F.col("i").alias("to"), F.col("to").alias("next"))
        last, at = at, written(
            at.join(dealt(on), ["text_id", "to"], "left").select("text_id", "i", F.coalesce("next", "to").alias("next"), "to"), "rhymes"
        )
        moved = at.where("next <> to").limit(1).count()
        discard(last)
        at = at.select("text_id", "i", F.col("next").alias("to"))
        if not moved:
            break
    members = at.select("text_id", F.col("i").alias("line_num"), F.col("to").alias("end")).unionByName(at.select("text_id", F.col("to").alias("line_num"), F.col("to").alias("end"))).distinct()
    first = members.groupBy("text_id", "end").agg(F.min("line_num").alias("root"))
    first = first.withColumn("rhyme_id", F.row_number().over(Window.partitionBy("text_id").orderBy("root")))
    ids = members.join(dealt(first), ["text_id", "end"]).select("text_id", "line_num", "rhyme_id")
    return ends.select("text_id", "line_num").join(dealt(ids), ["text_id", "line_num"], "left").select(
        "text_id", "line_num", F.coalesce("rhyme_id", F.lit(0)).alias("rhyme_id")
    )


def rhyming_lines(lines: DataFrame) -> DataFrame:
    """text_id, line_num, partner: each line with an exact rhyme earlier in its text (nearest before; equal words don't rhyme)."""
    ends = line_ends(lines).where("rime is not null")
    by_word = Window.partitionBy("text_id", "rime").orderBy("line_num")
    # The nearest earlier line of the rime with another word: the last change of word before this line.
    changed = F.when(F.lag("word").over(by_word) != F.col("word"), F.lag("line_num").over(by_word))
    rows = ends.withColumn("change", changed)
    last = F.last("change", ignorenulls=True).over(by_word.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("partner", last).where("partner is not null").select("text_id", "line_num", "word", "rime", "partner")


def scheme_numbers(scheme: str) -> list[int]:
    """Letters as numbers, letters that occur once as 0."""
    letters = scheme.replace(" ", "")
    return ["abcdefghijklmnopqrstuvwxyz".index(c) + 1 if letters.count(c) > 1 else 0 for c in letters]


def scheme_letters(ids: Column) -> Column:
    """Numbers as letters, 0 as '-'."""
    alphabet = "-abcdefghijklmnopqrstuvwxyz"
    letter = lambda k: F.when(k < len(alphabet), F.substring(F.lit(alphabet), (k + 1).cast("int"), F.lit(1))).otherwise(k.cast("string"))
    return F.array_join(F.transform(ids, letter), "")


def _edges(numbers: list[int]) -> list[tuple[int, int]]:
    """Pairs i < j (from 1) of one letter."""
    return [(i + 1, j + 1) for i, x in enumerate(numbers) for j in range(i + 1, len(numbers)) if x and x == numbers[j]]


def scheme_scores(ids: DataFrame) -> DataFrame:
    """(text_id, line_num, rhyme_id) -> text_id, ord, form, scheme, score for all named schemes.

    Rhyme ids are cut into windows of the scheme's length; a window scores the
    Jaccard similarity of its edges (pairs of lines that rhyme) with the scheme's,
    a text the mean, less one for a last window that is too short. Only windows
    with an edge score, so the work goes by pairs of rhyming lines that are near
    enough to share a window; they meet by an equi-join on the line.
    """
    spark = ids.sparkSession
    rows = []
    for k, (name, scheme) in enumerate(SCHEMES):
        pairs = _edges(scheme_numbers(scheme))
        size = len(scheme_numbers(scheme))
        rows.append((k, name, scheme, size, [1000 * i + j for i, j in pairs], [sum(j <= c for _, j in pairs) for c in range(size + 1)]))
    table = F.broadcast(spark.createDataFrame(rows, "ord int, form string, scheme string, size int, codes array<int>, upto array<int>"))
    longest = max(r[3] for r in rows)
    text = Window.partitionBy("text_id")
    lines = F.count("*").over(text).cast("int")
    placed = written(ids.select("text_id", "rhyme_id", (F.row_number().over(text.orderBy("line_num")) - 1).alias("at"), lines.alias("lines")), "placed")
    rhymed = placed.where("rhyme_id <> 0").select("text_id", "rhyme_id", "at", "lines")
    sent = rhymed.select("text_id", "rhyme_id", "lines", F.col("at").alias("i"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + longest - 1)).alias("at"))
    pairs = sent.join(dealt(rhymed.drop("lines")), ["text_id", "rhyme_id", "at"]).select("text_id", "lines", "i", F.col("at").alias("j"))
    sizes = F.broadcast(spark.createDataFrame([(n,) for n in sorted({r[3] for r in rows})], "size int"))
    in_window = pairs.crossJoin(sizes).where(F.floor(F.col("i") / F.col("size")) == F.floor(F.col("j") / F.col("size"))).select(
        "text_id", "lines", "size", F.floor(F.col("i") / F.col("size")).cast("int").alias("w"), ((F.col("i") % F.col("size") + 1) * 1000 + F.col("j") % F.col("size") + 1).alias("code")
    )
    # A window's pairs meet once, then each scheme of its size is held against them.
    per = in_window.groupBy("text_id", "lines", "size", "w").agg(F.collect_list("code").alias("mine")).join(table.select("size", "ord", "codes", "upto"), "size")
    both = F.size(F.filter("mine", lambda c: F.array_contains("codes", c)))
    wanted = F.get("upto", F.least(F.col("size"), F.col("lines") - F.col("w") * F.col("size")).cast("int"))
    hit = per.groupBy("text_id", "ord").agg(F.sum(both / (F.size("mine") + wanted - both)).alias("hit"))
    hits = hit.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "hit"))).alias("hits"))
    full = placed.where("at = 0").select("text_id", "lines").join(dealt(hits), "text_id", "left").crossJoin(table)
    windows = F.ceil(F.col("lines") / F.col("size"))
    short = (F.col("lines") % F.col("size") != 0).cast("int")
    score = F.coalesce(F.try_element_at("hits", "ord"), F.lit(0.0)) / windows - short
    return full.select("text_id", "ord", "form", "scheme", score.alias("score"))


def scheme_match(ids: DataFrame, top: int = 1) -> DataFrame:
    """The `top` best schemes of each text: by score, then the longer name, then catalogue order."""
    score = F.round("score", 9)
    order = Window.partitionBy("text_id").orderBy(F.desc(score), F.desc(F.length("form")), "ord")
    return (
        scheme_scores(ids).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("text_id", "rank", "form", "scheme", F.round("score", 6).alias("accuracy"))
    )
