"""Queries over IPA segments, distances and the rule-based languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrika.functions import finnish, segments
from metrika.functions import phonology as P
from metrika.operators import rhyme, tokens

from . import sql as S
from .analysis_queries import ENDS, IDS
from .text_queries import docs

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return added


_SEG = f"seg(ipa, {', '.join(P.FEATURES)}) AS (VALUES " + ", ".join(
    f"({S.quoted(k)}, {', '.join(map(str, v))})" for k, v in sorted(P.inventory().items())
) + ")"


@query(
    f"""WITH {_SEG} SELECT ipa, CAST(CASE WHEN syl > 0 AND hi > 0 THEN 8 WHEN syl > 0 THEN 9 WHEN cons < 0 AND (hi > 0 OR son > 0) THEN 7 WHEN cons < 0 THEN 1
    WHEN son > 0 AND nas > 0 THEN 5 WHEN son > 0 THEN 6 WHEN cont > 0 AND voi > 0 THEN 4 WHEN cont > 0 THEN 3 WHEN voi > 0 THEN 2 ELSE 1 END AS INTEGER) AS sonority FROM seg"""
)
def segment_sonority(spark, sf_dir):
    """Sonority of every segment."""
    c = F.col
    return P.segments_table(spark).select("ipa", P.sonority(c("syl"), c("hi"), c("cons"), c("son"), c("nas"), c("cont"), c("voi")).alias("sonority"))


@query(f"WITH {_SEG} SELECT ipa, syl = 1 AND hi = 1 AS high_vowel, cons = 1 AND voi = -1 AND cor = 1 AS voiceless_coronal, nas = 1 AS nasal FROM seg")
def segment_match(spark, sf_dir):
    """Segments matched against feature masks."""
    return P.segments_table(spark).select(
        "ipa",
        P.matches({"syl": 1, "hi": 1}).alias("high_vowel"),
        P.matches({"cons": 1, "voi": -1, "cor": 1}).alias("voiceless_coronal"),
        P.matches({"nas": 1}).alias("nasal"),
    )


_SUM = " + ".join(f"abs(a.{f} - b.{f})" for f in P.FEATURES)
_NE = " + ".join(f"CASE WHEN a.{f} <> b.{f} THEN 1 ELSE 0 END" for f in P.FEATURES)
_NAMES = ", ".join(f"CASE WHEN a.{f} <> b.{f} THEN '{f}' END" for f in P.FEATURES)


@query(
    f"""WITH {_SEG} SELECT a.ipa AS a, b.ipa AS b, CAST({_SUM} AS INTEGER) AS distance, round(({_SUM}) / {len(P.FEATURES)}.0, 6) AS norm_distance,
    CAST({_NE} AS INTEGER) AS hamming, ({_NE}) = 1 AS contrast, concat_ws(' ', {_NAMES}) AS differing FROM seg a JOIN seg b ON a.ipa < b.ipa"""
)
def segment_distances(spark, sf_dir):
    """Distances and contrasts of all pairs of segments."""
    return P.segment_distances(P.segments_table(spark))


_FROM = "".join(c for k, chars in P.CLASSES.items() for c in chars)
_TO = "".join(k for k, chars in P.CLASSES.items() for _ in chars)


@query(
    f"""WITH {S.PARTS}, w AS (SELECT DISTINCT lower(unnest(words)) AS word FROM units), c AS (SELECT word, translate(word, '{_FROM}aeiouy', '{_TO}VVVVVV') AS cls FROM w)
    SELECT cls, count(*) AS n_words, CAST(max(length(word)) AS INTEGER) AS longest FROM c GROUP BY cls"""
)
def collapsed_words(spark, sf_dir):
    """Distinct words by their collapsed sound classes."""
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).select(F.lower("w").alias("word")).distinct()
    cls = F.translate("word", _FROM + "aeiouy", _TO + "VVVVVV")
    return words.groupBy(cls.alias("cls")).agg(F.count("*").alias("n_words"), F.max(F.length("word")).alias("longest"))


@query(
    f"""WITH {_SEG}, {S.PARTS}, w AS (SELECT DISTINCT lower(unnest(words)) AS word FROM units), l AS (SELECT word, unnest(string_split(word, '')) AS ipa FROM w)
    SELECT word AS word_id, round(avg(hi), 6) AS hi, round(avg(lo), 6) AS lo, round(avg(back), 6) AS back, round(avg("round"), 6) AS "round", round(avg(tense), 6) AS tense,
    round(avg("long"), 6) AS "long", round(avg(son), 6) AS son, round(avg(cons), 6) AS cons, round(avg(nas), 6) AS nas, round(avg(voi), 6) AS voi FROM l JOIN seg USING (ipa) GROUP BY word"""
)
def feature_profiles(spark, sf_dir):
    """Mean features of distinct words, letters read as segments."""
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).select(F.lower("w").alias("word_id")).distinct()
    return P.mean_profile(words.withColumn("segments", F.split("word_id", "")), P.segments_table(spark), P.RIME_FEATURES)


@query()
def finnish_syllables(spark, sf_dir):
    """Distinct words read by the Finnish rules."""
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).select(F.lower("w").alias("token")).distinct()
    return finnish.annotated(words)


def _chars(last: int) -> str:
    pairs = ", ".join(f"{S.quoted(k)}: {S.quoted(v)}" for k, v in segments.decompositions(last).items())
    return "MAP {" + pairs + "}"


# Which marks after a base change what sonority depends on.
_HI = "[˞ʷʲᶣˠ̴]"
_STRESS, _PHONE = segments.STRESS.replace("'", "''"), segments.PHONE.replace("'", "''")
_PLAIN = f"regexp_replace(seg, '^[{_STRESS}]', '')"
PHONES = f"""{_SEG}, {S.PARTS},
w AS (SELECT DISTINCT lower(unnest(words)) AS ipa FROM units),
d AS (SELECT ipa, list_aggregate(list_transform(string_split(ipa, ''), lambda c: COALESCE(chars[c], c)), 'string_agg', '') AS nfd FROM w, (SELECT {_chars(0x24F)} AS chars)),
found AS (SELECT ipa, nfd, regexp_extract_all(nfd, '{_PHONE}') AS segs FROM d),
ph AS (SELECT ipa, unnest(segs) AS seg, CAST(unnest(range(0, len(segs))) AS INTEGER) AS i, len(segs) AS n FROM found),
based AS (SELECT *, regexp_extract({_PLAIN}, '{segments.SEGMENT}', 2) AS base, regexp_extract({_PLAIN}, '{segments.SEGMENT}', 3) AS marks FROM ph),
feat AS (SELECT based.ipa, based.seg, i, n, CASE WHEN regexp_matches(marks, '̩[^̯]*$') THEN 1 WHEN contains(marks, '̯') THEN -1 ELSE syl END AS syl,
  CASE WHEN regexp_matches(marks, '{_HI}') THEN 1 ELSE hi END AS hi, cons, son, CASE WHEN regexp_matches(marks, '[̃ⁿ]') THEN 1 ELSE nas END AS nas, cont,
  CASE WHEN contains(marks, '̥') THEN -1 ELSE voi END AS voi, cor FROM based JOIN seg ON seg.ipa = based.base),
level AS (SELECT *, CASE WHEN syl > 0 THEN CASE WHEN hi < 0 THEN 9 ELSE 8 END WHEN cons < 0 THEN 7 WHEN son > 0 THEN CASE WHEN nas < 0 THEN 6 ELSE 5 END
  WHEN cont > 0 THEN CASE WHEN voi > 0 THEN 4 ELSE 3 END WHEN voi > 0 THEN 2 ELSE 1 END AS son_level FROM feat)"""


@query(
    f"""WITH {PHONES} SELECT found.ipa, COALESCE(string_agg({_PLAIN}, ' ' ORDER BY i), '') AS segments, count(seg) AS n_segments,
    regexp_replace(min(nfd), '{_PHONE}', '', 'g') = '' AS known, COALESCE(string_agg(CAST(son_level AS VARCHAR), '' ORDER BY i), '') AS sonority,
    count(*) FILTER (syl > 0 AND hi > 0) AS high_vowels, count(*) FILTER (cons > 0 AND voi < 0 AND cor > 0) AS voiceless_coronals
    FROM found LEFT JOIN level l ON l.ipa = found.ipa GROUP BY found.ipa"""
)
def word_segments(spark, sf_dir):
    """Distinct words cut into segments with their marks: sonority by segment, feature masks matched, whether segments cover the word."""
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).select(F.lower("w").alias("ipa")).distinct()
    rows = words.withColumn("s", segments.segments(F.col("ipa"))).withColumn("f", F.transform("s", segments.features))
    has = lambda x, k: F.element_at(x, segments.FEATURES.index(k) + 1)
    count = lambda test: F.size(F.filter("f", test)).cast("long")
    return rows.select(
        "ipa", F.array_join("s", " ").alias("segments"), F.size("s").cast("long").alias("n_segments"), segments.is_known(F.col("ipa")).alias("known"),
        F.array_join(F.transform("f", lambda x: segments.sonority(x).cast("string")), "").alias("sonority"),
        count(lambda x: (has(x, "syl") > 0) & (has(x, "hi") > 0)).alias("high_vowels"),
        count(lambda x: (has(x, "cons") > 0) & (has(x, "voi") < 0) & (has(x, "cor") > 0)).alias("voiceless_coronals"),
    )


@query(
    f"""WITH {PHONES}, lev AS (SELECT *, CASE WHEN son_level >= 8 THEN 9 WHEN son_level <= 4 THEN 4 ELSE son_level END AS s FROM level),
    side AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS q, CASE WHEN i = 1 THEN last_value(s) OVER (PARTITION BY ipa ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      ELSE lag(s, 2) OVER w END AS pp FROM lev WINDOW w AS (PARTITION BY ipa ORDER BY i)),
    bound AS (SELECT *, i = 0 OR NOT (p < s OR (p > s AND (i = n - 1 OR s >= COALESCE(q, 10))) OR (pp = p AND p = s)) AS b FROM side),
    piece AS (SELECT ipa, g, string_agg(seg, '' ORDER BY i) AS t FROM (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY ipa ORDER BY i) AS g FROM bound) GROUP BY ipa, g),
    vow AS (SELECT *, regexp_matches(t, '{segments.VOWELS}') AS v FROM piece),
    grouped AS (SELECT ipa, g, t, COALESCE(sum(CASE WHEN v THEN 1 ELSE 0 END) OVER (PARTITION BY ipa ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
      sum(CASE WHEN v THEN 1 ELSE 0 END) OVER (PARTITION BY ipa) AS vowels FROM vow),
    joined AS (SELECT ipa, least(k, vowels - 1) AS k, string_agg(t, '' ORDER BY g) AS t FROM grouped WHERE vowels > 0 GROUP BY ALL),
    dressed AS (SELECT ipa, k, CASE WHEN regexp_matches(t, '[ˌ`]') THEN '`' WHEN regexp_matches(t, '[ˈ'']') THEN '''' ELSE '' END || regexp_replace(t, '[{_STRESS}]', '', 'g') AS t FROM joined)
    SELECT w.ipa, COALESCE(string_agg(t, '.' ORDER BY k), '') AS sylls FROM w LEFT JOIN dressed USING (ipa) GROUP BY w.ipa"""
)
def ipa_syllables(spark, sf_dir):
    """Distinct words, letters read as IPA, syllabified by sonority."""
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).select(F.lower("w").alias("ipa")).distinct()
    return words.select("ipa", F.array_join(segments.syllables(F.col("ipa")), ".").alias("sylls"))


def far_sql(pairs: str) -> str:
    """CTEs: far(a, b, dist), the feature edit distance of the distinct pairs (a, b) of the relation `pairs`, by dynamic programming on lists."""
    vector = lambda t, f: f"CASE WHEN {f == 'nas'} AND regexp_matches(regexp_extract({t}, '{segments.SEGMENT}', 3), '[̃ⁿ]') THEN 1 ELSE \"{f}\" END"
    return f"""one AS (SELECT DISTINCT unnest([a, b]) AS r FROM {pairs}),
    nf AS (SELECT r, regexp_extract_all(list_aggregate(list_transform(string_split(r, ''), lambda c: COALESCE(chars[c], c)), 'string_agg', ''), '{segments.SEGMENT}') AS segs FROM one, (SELECT {_chars(0x24F)} AS chars)),
    ex AS (SELECT r, unnest(segs) AS t, unnest(range(0, len(segs))) AS i FROM nf),
    fv AS (SELECT r, list([{', '.join(f'CAST({vector("t", f)} AS DOUBLE)' for f in P.FEATURES)}] ORDER BY i) AS v FROM ex JOIN seg ON seg.ipa = regexp_extract(t, '{segments.SEGMENT}', 2) GROUP BY r),
    far AS (SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 0.0 WHEN x.v IS NULL OR y.v IS NULL THEN 1.0 ELSE list_reduce(x.v,
      lambda row, s: list_reduce(list_transform(range(1, len(y.v) + 1), lambda j: [CAST(j AS DOUBLE)]), lambda new, e: list_append(new,
        least(row[CAST(e[1] AS INTEGER) + 1] + 1, new[CAST(e[1] AS INTEGER)] + 1,
          row[CAST(e[1] AS INTEGER)] + list_sum(list_transform(range(1, {len(P.FEATURES) + 1}), lambda k: abs(s[k] - y.v[CAST(e[1] AS INTEGER)][k]))) / {len(segments.FEATURES)})), [row[1] + 1]),
      list_transform(range(0, len(y.v) + 1), lambda j: CAST(j AS DOUBLE)))[len(y.v) + 1] / greatest(len(x.v), len(y.v)) END AS dist
      FROM (SELECT DISTINCT a, b FROM {pairs}) p LEFT JOIN fv x ON x.r = p.a LEFT JOIN fv y ON y.r = p.b)"""


_NEIGHBOURS = f"""{ENDS.removeprefix('WITH ')}, good AS (SELECT * FROM ends WHERE rime IS NOT NULL), {_SEG}"""


@query(
    f"""WITH {_NEIGHBOURS}, prs AS (SELECT a.rime AS a, b.rime AS b FROM good a JOIN good b ON a.text_id = b.text_id AND b.line_num = a.line_num + 1),
    {far_sql('prs')} SELECT a, b, round(dist, 6) AS dist FROM far"""
)
def feature_edit_distance(spark, sf_dir):
    """Feature edit distances of the distinct rimes that neighbouring lines end in."""
    ends = rhyme.line_ends(tokens.line_ends(docs(spark, sf_dir))).where("rime is not null")
    after = ends.select("text_id", (F.col("line_num") - 1).alias("line_num"), F.col("rime").alias("b"))
    pairs = ends.select("text_id", "line_num", F.col("rime").alias("a")).join(after, ["text_id", "line_num"])
    return rhyme.distinct_distances(pairs).withColumn("dist", F.round("dist", 6))


@query(
    f"""WITH RECURSIVE {_NEIGHBOURS},
    met AS (SELECT a.text_id, a.line_num AS i, b.line_num AS j, least(a.rime, b.rime) AS a, greatest(a.rime, b.rime) AS b FROM good a
      JOIN good b ON a.text_id = b.text_id AND b.line_num BETWEEN a.line_num - 4 AND a.line_num + 4 AND a.line_num <> b.line_num AND a.word <> b.word),
    {far_sql('met')}, pairs AS (SELECT text_id, i, j, dist FROM met JOIN far USING (a, b)), {IDS[IDS.index('near AS ('):]} SELECT * FROM ids"""
)
def rhyme_ids_by_features(spark, sf_dir):
    """Rhyme groups by feature edit distance of rimes."""
    return rhyme.rhyme_ids(tokens.line_ends(docs(spark, sf_dir)), by="features")
