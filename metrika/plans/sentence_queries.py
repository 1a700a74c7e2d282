"""Queries of the learned sentence statistics, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrika.operators import punkt

from .text_queries import docs
from .sql import in_list

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def added(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return added


_TYPE = "CASE WHEN regexp_matches({c}, '^\\p{{N}}[\\p{{N}}.-]*$') THEN '##' ELSE lower({c}) END"
_TYPE_OF = lambda t: _TYPE.format(c=f"regexp_replace({t}, '[.!?]+$', '')")
_CASE_OF = lambda t: f"CASE WHEN regexp_matches({t}, '^\\p{{Lu}}') THEN 'U' WHEN regexp_matches({t}, '^\\p{{Ll}}') THEN 'L' ELSE 'N' END"
_TOKEN = punkt.TOKEN.replace("'", "''")
_X = lambda k, p: f"CASE WHEN {k} = 0 THEN 0.0 ELSE ({k}) * ln({p}) END"
_L = lambda k, n, p: f"({_X(k, p)} + {_X(f'({n} - {k})', f'(1 - {p})')})"


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    p, p1, p2 = f"(CAST({b} AS DOUBLE) / {n})", f"(CAST({ab} AS DOUBLE) / {a})", f"(CAST({b} - {ab} AS DOUBLE) / ({n} - {a}))"
    return f"2 * ({_L(ab, a, p1)} + {_L(f'({b} - {ab})', f'({n} - {a})', p2)} - {_L(ab, a, p)} - {_L(f'({b} - {ab})', f'({n} - {a})', p)})"


STATS = f"""tok AS (SELECT text_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i FROM (
  SELECT doc_id AS text_id, regexp_extract_all(regexp_replace(text, '-{{2,}}', '—', 'g'), '{_TOKEN}') AS a FROM documents WHERE text IS NOT NULL)),
prs AS (SELECT {_TYPE_OF('t')} AS a, t LIKE '%.' AS dot, regexp_matches(t, '[!?]$') AS stop,
  lead({_TYPE_OF('t')}) OVER w AS b, lead({_CASE_OF('t')}) OVER w AS "case" FROM tok WINDOW w AS (PARTITION BY text_id ORDER BY i)),
tot AS (SELECT count(*) AS tokens, count(*) FILTER (dot) AS dots FROM prs),
typ AS (SELECT *, length(replace(type, '.', '')) AS letters FROM (SELECT a AS type, count(*) AS n, count(*) FILTER (dot) AS n_dot FROM prs GROUP BY a)),
types AS (SELECT type, n, n_dot, CASE WHEN type <> '##' AND letters > 0 THEN
  2 * ({_L('n_dot', 'n', '0.99')} - {_L('n_dot', 'n', 'least(greatest(CAST(dots AS DOUBLE) / tokens, 1e-9), 1 - 1e-9)')})
  * exp(-letters) * (length(type) - letters + 1) * exp(-(n - n_dot) * ln(letters)) END AS score FROM typ, tot),
short AS (SELECT type FROM types WHERE n_dot > 0 AND (score >= 0.3 OR type IN {in_list(punkt.KNOWN)})),
marked AS (SELECT *, stop OR (dot AND NOT abbr) AS ends FROM (SELECT prs.*, dot AND EXISTS (SELECT 1 FROM short WHERE short.type = prs.a) AS abbr FROM prs)),
starters AS (SELECT * FROM (SELECT type, n, n_begin, {_ratio('breaks', 'n', 'n_begin', 'tokens')} AS score, tokens * n_begin > n * breaks AS more FROM (
  SELECT b AS type, count(*) FILTER (ends) AS n_begin FROM marked WHERE b IS NOT NULL GROUP BY b) JOIN types USING (type), tot,
  (SELECT count(*) FILTER (ends) AS breaks FROM marked WHERE b IS NOT NULL) WHERE n_begin > 0) WHERE score >= 30 AND more),
stopped AS (SELECT *, regexp_matches(a, '^\\p{{L}}$') AS initial FROM marked WHERE dot AND b IS NOT NULL AND (abbr OR regexp_matches(a, '^\\p{{L}}$') OR a = '##')),
collocations AS (SELECT a, b, n, score FROM (SELECT s.a, s.b, s.n, {_ratio('ta.n', 'tb.n', 's.n', 'tokens')} AS score, tokens * s.n > ta.n * tb.n AS more
  FROM (SELECT a, b, count(*) AS n FROM stopped GROUP BY ALL HAVING count(*) > 1) s JOIN types ta ON ta.type = a JOIN types tb ON tb.type = b, tot
  WHERE b NOT IN (SELECT type FROM starters)) WHERE score >= 7.88 AND more)"""


@query(f"WITH {STATS} SELECT type, n, n_dot, round(score, 4) + 0.0 AS score FROM types WHERE n_dot > 0")
def punkt_types(spark, sf_dir):
    """Every type with a full stop, its counts and its likelihood of being an abbreviation."""
    found = punkt.type_counts(punkt.pair_counts(docs(spark, sf_dir))).where("n_dot > 0")
    return found.withColumn("score", F.round("score", 4) + 0.0)


@query(f"WITH {STATS} SELECT type, n, n_begin, round(score, 4) + 0.0 AS score FROM starters")
def punkt_starters(spark, sf_dir):
    """Sentence starters."""
    return punkt.starters(punkt.learned(docs(spark, sf_dir))).withColumn("score", F.round("score", 4) + 0.0)


@query(f"WITH {STATS} SELECT a, b, n, round(score, 4) + 0.0 AS score FROM collocations")
def punkt_collocations(spark, sf_dir):
    """Pairs of types around a full stop that belong together."""
    return punkt.collocations(punkt.learned(docs(spark, sf_dir))).withColumn("score", F.round("score", 4) + 0.0)


@query(
    f"""WITH {STATS},
cas AS (SELECT b, count(*) FILTER ("case" = 'L') AS lower_n, count(*) FILTER ("case" = 'U') AS upper_n, count(*) FILTER ("case" = 'L' AND ends) AS lower_begin,
  count(*) FILTER ("case" = 'U' AND NOT dot AND NOT stop) AS upper_inside FROM marked WHERE b IS NOT NULL GROUP BY b),
judged AS (SELECT DISTINCT a, b, "case", CASE WHEN EXISTS (SELECT 1 FROM collocations c WHERE c.a = s.a AND c.b = s.b) THEN true
    WHEN abbr AND NOT initial THEN NOT ("case" = 'U' AND (lower_n > 0 AND upper_inside = 0 OR EXISTS (SELECT 1 FROM starters t WHERE t.type = s.b)))
    ELSE abbr OR ("case" = 'L' AND (upper_n > 0 OR lower_begin = 0))
      OR (initial AND "case" = 'U' AND lower_n = 0) END AS hold FROM stopped s JOIN cas USING (b)),
pieces AS (SELECT text_id, unnest(p) AS piece, unnest(range(0, len(p))) AS k FROM (SELECT doc_id AS text_id,
  string_split(regexp_replace(regexp_replace(replace(text, chr(1), ''), '-{{2,}}', '—', 'g'), '([.!?]+["''”’)\\]]*)(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
ends AS (SELECT *, regexp_extract_all(piece, '{_TOKEN}')[-1] AS last, regexp_extract(lead(piece) OVER (PARTITION BY text_id ORDER BY k), '{_TOKEN}') AS first FROM pieces),
keyed AS (SELECT text_id, k, piece, CASE WHEN last LIKE '%.' AND ends_with(regexp_replace(piece, '["''”’)\\]]+$', ''), last) THEN {_TYPE_OF('last')} END AS a,
  {_TYPE_OF('first')} AS b, {_CASE_OF('first')} AS "case" FROM ends),
cut AS (SELECT text_id, k, piece, COALESCE(hold, false) AS hold FROM keyed LEFT JOIN judged USING (a, b, "case")),
grouped AS (SELECT text_id, k, piece, COALESCE(sum(CASE WHEN hold THEN 0 ELSE 1 END) OVER (PARTITION BY text_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM cut)
SELECT text_id, CAST(g + 1 AS INTEGER) AS sent_num, string_agg(piece, '' ORDER BY k) AS sentence FROM grouped GROUP BY text_id, g"""
)
def punkt_sentences(spark, sf_dir):
    """Sentences, stops judged by the statistics of all texts."""
    return punkt.sentences(docs(spark, sf_dir))
