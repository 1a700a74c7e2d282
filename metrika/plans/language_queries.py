"""Queries of mojibake repair, language profiles and tree statistics, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrika.functions import mojibake
from metrika.operators import languages, trees

from . import analysis_queries as A
from .text_queries import docs

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def added(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return added


_HEX = "regexp_extract_all(hex({b}), '..')"
_LATIN = "array_to_string(list_transform({h}, lambda x: chr(CAST(('0x' || x) AS INTEGER))), '')"
_SPECIAL, _PLAIN = "".join(mojibake.CP1252.values()), "".join(f"chr({b}) || " for b in mojibake.CP1252) + "''"
_READ = f"decode(unhex(array_to_string(list_transform(string_split(translate(r, '{_SPECIAL}', {_PLAIN}), ''), lambda c: printf('%02x', ord(c))), '')))"


def _misread(text: str) -> str:
    return _LATIN.format(h=_HEX.format(b=f"encode({text})"))


def _pass(source: str) -> str:
    return f"""(SELECT doc_id, CASE WHEN len(m) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(c) + 1), lambda i: c[i] || COALESCE(m[i], '')), '') END AS text
    FROM (SELECT doc_id, text, string_split_regex(text, '{mojibake.RUN}') AS c, list_transform(regexp_extract_all(text, '{mojibake.RUN}'), lambda r: {_READ}) AS m FROM {source}))"""


@query(
    f"""WITH once AS (SELECT doc_id, text AS clean, CASE WHEN doc_id % 3 = 2 THEN text ELSE {_misread('text')} END AS text FROM documents),
    bad AS (SELECT doc_id, clean, CASE WHEN doc_id % 3 = 1 THEN {_misread('text')} ELSE text END AS text FROM once),
    good AS {_pass(_pass(_pass('bad')))}
    SELECT doc_id, bad.text <> clean AS misread, good.text = clean AS mended, CAST(length(bad.text) - length(good.text) AS INTEGER) AS fewer, md5(good.text) AS digest FROM bad JOIN good USING (doc_id)"""
)
def mojibake_repair(spark, sf_dir):
    """Documents whose UTF-8 was read as Latin-1 once (ids 0 modulo 3), twice (1) or never (2), repaired and held against the originals."""
    misread: Column = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").alias("clean"), F.when(F.col("doc_id") % 3 == 2, F.col("text")).otherwise(misread).alias("text"))
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 3 == 1, misread).otherwise(F.col("text")))
    rows = rows.withColumn("good", mojibake.repaired(F.col("text")))
    return rows.select(
        "doc_id", (F.col("text") != F.col("clean")).alias("misread"), (F.col("good") == F.col("clean")).alias("mended"),
        (F.length("text") - F.length("good")).cast("int").alias("fewer"), F.md5("good").alias("digest"),
    )


@query(
    f"""WITH plain AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS p FROM documents WHERE text IS NOT NULL),
    grams AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(p) - 1), lambda k: substr(p, k, 3))) AS gram FROM plain WHERE length(p) > 2),
    counts AS (SELECT lang, gram, count(*) AS n FROM grams WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r, sum(n) OVER (PARTITION BY lang) AS whole FROM counts),
    profile AS (SELECT lang, gram, CAST(round(1000 * ln((n + 1) / (whole + 1))) AS INTEGER) AS weight FROM ranked WHERE r <= {languages.GRAMS}),
    sums AS (SELECT doc_id, p.lang, sum(weight - (SELECT min(weight) FROM profile) + 1000) AS score FROM grams g JOIN profile p USING (gram) GROUP BY ALL),
    best AS (SELECT doc_id, arg_min(lang, r) AS found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM sums) GROUP BY doc_id)
    SELECT doc_id, found, doc_id % 5 = 0 AS held_out FROM documents LEFT JOIN best USING (doc_id)"""
)
def language_profiles(spark, sf_dir):
    """The language of every document by trigram profiles of the documents whose id 5 does not divide."""
    rows = docs(spark, sf_dir)
    known = languages.profiles(rows.where(F.col("doc_id") % 5 != 0))
    found = languages.detected(rows.select(F.col("doc_id").alias("text_id"), "text"), known)
    return found.select(F.col("text_id").alias("doc_id"), F.col("lang").alias("found"), (F.col("text_id") % 5 == 0).alias("held_out"))


_LEXICAL = "CASE WHEN xpos IN ('CC', 'PRP$', 'TO', 'UH', 'DT') THEN -1.0 WHEN xpos = 'IN' THEN -0.5 ELSE 0.0 END"
_THREE = (
    A._TREE.replace(
        "nod AS (",
        f"""lex AS (SELECT *, {_LEXICAL} AS lexical, word_num % 3 = 0 AS mono FROM deps),
    three AS (SELECT {{'t': text_id, 'm': m}} AS text_id, sent_num, word_num, head, pos, xpos,
      CASE WHEN lexical <> -0.5 THEN lexical WHEN m = 'm2b' OR (m = 'm2a' AND mono) THEN -1.0 ELSE 0.0 END AS own FROM lex, (SELECT unnest(['m1', 'm2a', 'm2b']) AS m)),
    nod AS (""",
        1,
    )
    .replace("0.0 AS lstress FROM deps", "0.0 AS lstress FROM three", 1)
)
_AT = _THREE.index("SELECT text_id, sent_num, 1000000 + word_num")
_THREE = _THREE[:_AT] + "SELECT text_id, sent_num, 1000000 + word_num, word_num, xpos, word_num, own FROM three)" + _THREE[_THREE.index(",\nup(") :]


@query(
    f"""WITH RECURSIVE {_THREE},
    wide AS (SELECT text_id.t AS text_id, sent_num, word_num, max(CASE WHEN text_id.m = 'm1' THEN total END) AS m1, max(CASE WHEN text_id.m = 'm2a' THEN total END) AS m2a,
      max(CASE WHEN text_id.m = 'm2b' THEN total END) AS m2b FROM done GROUP BY ALL),
    al AS (SELECT *, CAST(m1 + m2a + m2b AS DOUBLE) / 3 AS mean FROM wide JOIN lex USING (text_id, sent_num, word_num))
    SELECT text_id, sent_num, CAST(word_num AS INTEGER) AS word_num, CAST(row_number() OVER o AS INTEGER) AS word_index, round(row_number() OVER o / count(*) OVER w, 6) AS relative_index,
      CASE WHEN lexical = 0 THEN 'yes' WHEN lexical = -0.5 THEN 'ambig' ELSE 'no' END AS lexstress, CAST(m1 AS DOUBLE) AS m1, CAST(m2a AS DOUBLE) AS m2a, CAST(m2b AS DOUBLE) AS m2b, round(mean, 6) AS mean,
      {', '.join(f"round(CAST({m} - min({m}) OVER w AS DOUBLE) / nullif(CAST(max({m}) OVER w - min({m}) OVER w AS DOUBLE), 0), 6) AS norm_{m}" for m in ('m1', 'm2a', 'm2b', 'mean'))},
      count(*) FILTER (lexical = -0.5) OVER w AS ambig_words, count(*) FILTER (lexical = -0.5 AND mono) OVER w AS ambig_monosyll,
      string_agg(printf('%.2f', mean), ' ') OVER (PARTITION BY text_id, sent_num ORDER BY word_num ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS contour
    FROM al WINDOW w AS (PARTITION BY text_id, sent_num), o AS (PARTITION BY text_id, sent_num ORDER BY word_num)"""
)
def tree_statistics(spark, sf_dir):
    """every word's stress in the derived trees under three disambiguations, normalised, with counts and contours."""
    syllables = F.when(F.col("word_num") % 3 == 0, 1).otherwise(2)
    rows = trees.statistics(A.tree_nodes(spark, sf_dir).withColumn("n_syll", syllables))
    for c in ("relative_index", "mean", "norm_m1", "norm_m2a", "norm_m2b", "norm_mean"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows
