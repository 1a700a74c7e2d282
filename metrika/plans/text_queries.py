"""Queries over tokens, syllables and sources, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrika.functions import ortho
from metrika.functions import text as T
from metrika.operators import scansion, stats, sylls, tokens, trees

from . import sql as S

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle if there is one."""

    def added(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return added


_BLANK = "[ \\n\u0085\u00a0\u1680\u2000-\u200a\x01]"
_STRIP = "regexp_replace(tok, '^[\\s\u0085\u00a0\u1680\u2000-\u200a]+', '')"
TOKENS = f"""{S.SOURCE},
arr AS (SELECT text_id, regexp_extract_all(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_'' -—–\\n]', chr(1), 'g'), '{_BLANK}*(?:[\\p{{L}}\\p{{N}}_'']+|[!-—–])') AS a FROM src),
tok AS (SELECT text_id, replace(unnest(a), chr(1), '') AS tok, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS word_num FROM arr),
marked AS (SELECT text_id, word_num, tok AS word_txt, CASE WHEN regexp_matches(tok, '\\p{{L}}') THEN 0 ELSE 1 END AS is_punc,
  length(tok) - length(replace(tok, chr(10), '')) AS breaks, regexp_replace(tok, '^\\s+', '') AS core,
  CASE WHEN regexp_matches(tok, '[,:;–—()\\[\\].!?"]') THEN 1 ELSE 0 END AS sep FROM tok),
lagged AS (SELECT *, lag(core) OVER w AS c1, lag(core, 2) OVER w AS c2 FROM marked WINDOW w AS (PARTITION BY text_id ORDER BY word_num)),
begun AS (SELECT *, CASE WHEN word_txt <> core AND (COALESCE(c1 IN ('.', '!', '?'), false)
  OR (COALESCE(c1 IN ('"', '''', ')', ']'), false) AND COALESCE(c2 IN ('.', '!', '?'), false))) THEN 1 ELSE 0 END AS beg FROM lagged),
tokens AS (SELECT text_id, word_num, word_txt, is_punc,
  CAST(1 + sum(CASE WHEN breaks > 1 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS para_num,
  CAST(1 + sum(CASE WHEN breaks > 0 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS line_num,
  CAST(1 + sum(beg) OVER w AS INTEGER) AS sent_num,
  CAST(1 + sum(sep) OVER w - sep AS INTEGER) AS sentpart_num,
  CAST(1 + sum(sep) OVER w - sep + sum(CASE WHEN breaks > 0 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS linepart_num
  FROM begun WINDOW w AS (PARTITION BY text_id ORDER BY word_num ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {TOKENS} SELECT * FROM tokens")
def token_table(spark, sf_dir):
    """Tokens with all counters."""
    return tokens.tokens(docs(spark, sf_dir))


@query(
    f"""WITH {TOKENS} SELECT text_id, count(*) AS n_tokens, CAST(sum(is_punc) AS BIGINT) AS n_punc, max(line_num) AS n_lines,
    max(para_num) AS n_stanzas, max(sent_num) AS n_sents, max(linepart_num) AS n_lineparts FROM tokens GROUP BY text_id"""
)
def text_counts(spark, sf_dir):
    """Counts of every unit by text."""
    return tokens.tokens(docs(spark, sf_dir)).groupBy("text_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum("is_punc").alias("n_punc"),
        F.max("line_num").alias("n_lines"),
        F.max("para_num").alias("n_stanzas"),
        F.max("sent_num").alias("n_sents"),
        F.max("linepart_num").alias("n_lineparts"),
    )


@query(f"SELECT doc_id, {S.clean('text')} AS clean_text FROM documents")
def clean_text(spark, sf_dir):
    """Cleaned texts."""
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


@query(
    f"""WITH {S.PARTS} SELECT text_id, line_num, linepart, list_aggregate(words, 'string_agg', ' ') AS words FROM units"""
)
def parse_units(spark, sf_dir):
    """1.1 groupings: line parts with their words."""
    return tokens.line_parts(docs(spark, sf_dir)).withColumn("words", F.array_join("words", " "))


@query(
    """WITH cut AS (SELECT doc_id AS text_id, string_split(regexp_replace(text, '([.!?]["'')]?)(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM documents)
    SELECT text_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS sent_num, unnest(l) AS sentence FROM cut"""
)
def sentence_split(spark, sf_dir):
    """Rule-based sentences."""
    return tokens.sentences(docs(spark, sf_dir))


@query(
    """WITH cut AS (SELECT doc_id AS text_id, string_split(regexp_replace(text, '((?:--|[:;–—]|[.!?]))(\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents)
    SELECT text_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS clause_num, unnest(l) AS clause FROM cut"""
)
def pause_split(spark, sf_dir):
    """clauses between pauses."""
    return docs(spark, sf_dir).select(F.col("doc_id").alias("text_id"), F.posexplode(trees.pause_split(F.col("text"))).alias("k", "clause")).select(
        "text_id", (F.col("k") + 1).alias("clause_num"), "clause"
    )


@query(
    """SELECT conv_id AS text_id, CAST(turn + 1 AS BIGINT) AS line_num, CAST(len(string_split_regex(trim(text), '\\s+')) AS INTEGER) AS n_words,
    CAST(row_number() OVER w AS INTEGER) AS num, CAST(lag(turn) OVER w AS BIGINT) AS prev_turn, CAST(lead(turn) OVER w AS BIGINT) AS next_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def lines_stanzas(spark, sf_dir):
    """X2, 1.1: conversations as stanzas, turns as lines, with their neighbours."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("text_id"), "turn", F.size(F.split(F.trim("text"), r"\s+")).alias("n_words")
    )
    rows = stats.siblings(rows, ["text_id"], ["turn"])
    ahead = F.when(F.col("prev_num").isNotNull(), F.col("turn") - 1)
    return rows.select(
        "text_id", (F.col("turn") + 1).alias("line_num"), "n_words", "num", ahead.alias("prev_turn"),
        F.when(F.col("next_num").isNotNull(), F.col("turn") + 1).alias("next_turn"),
    )


@query(
    """SELECT lang, count(*) AS n_texts, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))) AS BIGINT) AS n_lines
    FROM documents GROUP BY lang"""
)
def corpus_listing(spark, sf_dir):
    """Texts and non-blank lines by language."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_texts"), F.sum(lines).alias("n_lines"))


def _hits(lang: str) -> str:
    return f"len(list_filter(w, lambda x: x IN {S.in_list(T.STOP_WORDS[lang])}))"


@query(
    f"""WITH a AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents),
    h AS (SELECT doc_id, {', '.join(f'{_hits(k)} AS h_{k}' for k in sorted(T.STOP_WORDS))} FROM a),
    b AS (SELECT *, greatest({', '.join(f'h_{k}' for k in sorted(T.STOP_WORDS))}) AS top FROM h)
    SELECT doc_id, CASE WHEN top = 0 THEN NULL {' '.join(f"WHEN h_{k} = top THEN '{k}'" for k in sorted(T.STOP_WORDS))} END AS detected FROM b"""
)
def detect_language(spark, sf_dir):
    """Stop-word language detection."""
    return docs(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("detected"))


def _sylls_sql() -> str:
    return f"""{TOKENS},
low AS (SELECT *, lower(regexp_replace(regexp_replace(word_txt, '^\\s+|\\s+$', '', 'g'), '\\s+', '-', 'g')) AS word FROM tokens),
chunked AS (SELECT *, {S.CHUNKS('word')} AS ch FROM low),
formed AS (SELECT *, len(ch) AS wn, CASE WHEN is_punc = 1 OR len(ch) = 0 THEN 0 WHEN len(ch) = 1 AND word IN {S.in_list(ortho.AMBIGUOUS_WORDS)} THEN 2 ELSE 1 END AS num_forms FROM chunked),
variants AS (SELECT *, unnest(CASE WHEN num_forms = 0 THEN [-1] ELSE range(0, num_forms) END) AS form_idx FROM formed),
spread AS (SELECT *, unnest(CASE WHEN num_forms = 0 THEN [-1] ELSE range(0, wn) END) AS syll_idx FROM variants),
stress AS (SELECT *, CASE WHEN num_forms = 0 THEN '' ELSE ch[syll_idx + 1] END AS syll_text,
  CASE WHEN num_forms = 0 THEN false WHEN wn = 1 THEN CASE WHEN word IN {S.in_list(ortho.FUNCTION_WORDS)} THEN false WHEN word IN {S.in_list(ortho.AMBIGUOUS_WORDS)} THEN form_idx = 1 ELSE true END
  ELSE syll_idx % 2 = 0 AND (syll_idx = 0 OR syll_idx < wn - 1) END AS is_stressed FROM spread),
beside AS (SELECT *, lag(is_stressed) OVER w AS b, lead(is_stressed) OVER w AS a FROM stress WINDOW w AS (PARTITION BY text_id, word_num, form_idx ORDER BY syll_idx)),
sylls AS (SELECT text_id, word_num, word_txt, is_punc, para_num, line_num, sent_num, sentpart_num, linepart_num,
  CAST(form_idx AS INTEGER) AS form_idx, CAST(num_forms AS INTEGER) AS num_forms, CAST(syll_idx AS INTEGER) AS syll_idx,
  CASE WHEN is_stressed THEN '''' || syll_text ELSE syll_text END AS syll_ipa, syll_text, is_stressed,
  num_forms > 0 AND {S.HEAVY('syll_text')} AS is_heavy,
  wn > 1 AND is_stressed AND (COALESCE(NOT b, false) OR COALESCE(NOT a, false)) AS is_strong,
  num_forms > 0 AND wn > 1 AND NOT is_stressed AND (COALESCE(b, false) OR COALESCE(a, false)) AS is_weak,
  num_forms > 0 AND wn = 1 AND NOT is_stressed AS is_functionword FROM beside)"""


@query(f"WITH {_sylls_sql()} SELECT * FROM sylls")
def syllable_table(spark, sf_dir):
    """The syllable table of all documents, all variants."""
    return sylls.syllables_of(docs(spark, sf_dir))


@query(
    f"""WITH {_sylls_sql()} SELECT line_num, count(*) AS n_sylls, count(*) FILTER (is_stressed) AS n_stressed, count(*) FILTER (is_heavy) AS n_heavy,
    count(*) FILTER (is_functionword) AS n_function, text_id FROM sylls WHERE form_idx = 0 AND is_punc = 0 GROUP BY text_id, line_num"""
)
def sylls_per_line(spark, sf_dir):
    """Canonical syllables and their features by line."""
    return sylls.per_line(tokens.tokens(docs(spark, sf_dir)))


LEXICON = [("the", "the"), ("of", "of"), ("and", "'and"), ("and", "and"), ("that", "'that"), ("that", "that"), ("with", "with")]


@query(
    f"""WITH {S.PARTS}, lex(token, ipa) AS (VALUES {', '.join(f"({S.quoted(a)}, {S.quoted(b)})" for a, b in LEXICON)}),
    forms AS (SELECT token, CAST(row_number() OVER (PARTITION BY token ORDER BY length(regexp_replace(ipa, '[^''`]', '', 'g')), length(ipa), ipa) - 1 AS INTEGER) AS form_idx, ipa FROM lex),
    w AS (SELECT lower(unnest(words)) AS token FROM units)
    SELECT w.token, COALESCE(form_idx, -1) AS form_idx, COALESCE(ipa, '') AS ipa, count(*) AS n FROM w LEFT JOIN forms USING (token) GROUP BY ALL"""
)
def lexicon_join(spark, sf_dir):
    """Distinct tokens against a pronunciation lexicon, variants ordered by stress and length."""
    lines = spark.createDataFrame([(f"{a}\t{b}",) for a, b in LEXICON], "value string")
    lex = sylls.lexicon_from_lines(lines)
    words = tokens.line_parts(docs(spark, sf_dir)).select(F.explode("words").alias("w")).groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("n"))
    return words.join(F.broadcast(lex), "token", "left").select(
        "token", F.coalesce("form_idx", F.lit(-1)).alias("form_idx"), F.coalesce(F.array_join("sylls", "."), F.lit("")).alias("ipa"), "n"
    )


@query(f"WITH RECURSIVE {S.scansions().lstrip()} SELECT * FROM scan")
def scansion_catalogue(spark, sf_dir):
    """All scansions of 1 to 18 syllables in enumeration order, with masks."""
    return scansion.scansions(spark)


@query(
    f"""WITH RECURSIVE {S.scansions().lstrip()} SELECT n, scan_ord, substr(repeat('ws', n), 1, n) AS iambic,
    list_aggregate(regexp_extract_all(meter, 'w+|s+'), 'string_agg', '|') AS runs, CAST(len(regexp_extract_all(meter, 'w+|s+')) AS INTEGER) AS n_runs FROM scan"""
)
def split_scansion(spark, sf_dir):
    """+- strings split into runs, and the default iambic scansion."""
    rows = scansion.scansions(spark).withColumn("pm", F.translate("meter", "ws", "-+"))
    runs = scansion.split_scansion(F.col("pm"))
    return rows.select("n", "scan_ord", scansion.iambic(F.col("n")).alias("iambic"), F.array_join(runs, "|").alias("runs"), F.size(runs).alias("n_runs"))


@query(
    """WITH x AS (SELECT d.n_chars AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id)),
    r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x)
    SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
    round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r"""
)
def auc_roc(spark, sf_dir):
    """Mann-Whitney AUC of document length for quality."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.auc(rows, "n_chars", "quality")


THRESHOLDS = [500.0, 1000.0, 2000.0, 4000.0, 8000.0]


@query(
    f"""WITH x AS (SELECT d.n_chars AS s, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)), t(threshold) AS (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in THRESHOLDS)}),
    c AS (SELECT threshold, count(*) FILTER (s <= threshold AND y = 1) AS tp, count(*) FILTER (s <= threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM x, t GROUP BY threshold)
    SELECT threshold, CASE WHEN p > 0 THEN round(tp / p, 6) ELSE 0.0 END AS tpr, CASE WHEN n > 0 THEN round(fp / n, 6) ELSE 0.0 END AS fpr,
    CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fp + p > 0 THEN round(2 * tp / (tp + fp + p), 6) ELSE 0.0 END AS f1 FROM c"""
)
def roc_sweep(spark, sf_dir):
    """ROC and F1 over thresholds."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.roc(rows, "n_chars", "toxic", THRESHOLDS)


@query(
    """SELECT CAST(CASE WHEN n_chars < 0 THEN 0 WHEN n_chars >= 10000 THEN 21 ELSE floor(n_chars / 500.0) + 1 END AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY 1"""
)
def length_histogram(spark, sf_dir):
    """Histogram of text lengths."""
    return stats.histogram(docs(spark, sf_dir), "n_chars", 0, 10_000, 20)


@query(
    """SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75 FROM documents GROUP BY lang"""
)
def length_quantiles(spark, sf_dir):
    """Quantiles of text lengths by language."""
    return stats.quantiles(docs(spark, sf_dir), ["lang"], "n_chars")


@query(
    """SELECT doc_id, substr(sha256(concat_ws(chr(31), lang, text)), 1, 16) AS key FROM documents"""
)
def stable_keys(spark, sf_dir):
    """Stable text keys."""
    return docs(spark, sf_dir).select("doc_id", T.stable_hash(F.col("lang"), F.col("text")).alias("key"))
