"""Queries through the text-to-parse interface: modes, export, products of parts, bulk runs, phrasal constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrika.functions import ortho
from metrika.operators import constraints as C
from metrika.operators import parse, products, texts, tokens, trees, units
from metrika.sources import scratch

from . import sql as S
from .analysis_queries import _DEPS, dependency_rows
from .parse_queries import _DOMINATED, _LESS, _VECTORS
from .text_queries import docs, table

QUERIES, ORACLES = {}, {}
NAMES = S.DEFAULT
UNIT = "text_id, line_num, linepart"


def query(oracle: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return added


_SAME = " AND ".join(f"s.{k} = u.{k}" for k in [*S.KEY.split(", "), *NAMES])
#: Each unit's undominated parses, the two variants competing.
LISTS = f"""{_VECTORS},
every AS (SELECT s.* FROM scored s JOIN unb u ON {_SAME}),
mine AS MATERIALIZED (SELECT {UNIT}, variant, n, {', '.join(NAMES)}, score, scansions FROM enc JOIN unb USING ({S.KEY})),
pool AS MATERIALIZED (SELECT a.* FROM mine a WHERE NOT EXISTS (SELECT 1 FROM mine b WHERE a.text_id = b.text_id AND a.line_num = b.line_num AND a.linepart = b.linepart
  AND a.variant <> b.variant AND {_DOMINATED} AND ({_LESS})))"""


@query(
    S.scored()
    + f""", {LISTS}, l AS (SELECT p.text_id, p.line_num, p.linepart, p.variant, r.scan_ord, r.score, r.positions FROM pool p
      JOIN enc e ON e.text_id = p.text_id AND e.line_num = p.line_num AND e.linepart = p.linepart AND e.variant = p.variant
      JOIN every r ON {' AND '.join(f'r.{k} = e.{k}' for k in S.KEY.split(', '))} AND {' AND '.join(f'r.{k} = p.{k}' for k in NAMES)})
    SELECT *, CAST(row_number() OVER (PARTITION BY {UNIT} ORDER BY score, variant, scan_ord) AS INTEGER) AS parse_rank FROM l"""
)
def unbounded_parses(spark, sf_dir):
    """1.2, 1.6, B5-B8: all undominated parses of every line part, variants bounded against each other, ranked."""
    return texts.parse_texts(docs(spark, sf_dir), mode="unbounded").select(
        "text_id", "line_num", "linepart", "variant", "scan_ord", "score", "positions", "parse_rank"
    )


_SUMS = ", ".join(f"CAST(sum({k} * scansions) AS BIGINT) AS {k}_u" for k in NAMES)


@query(
    S.best()
    + f""", {LISTS}, u AS (SELECT {UNIT}, max(n) AS n, CAST(sum(scansions) AS BIGINT) AS many, sum(score * scansions) AS score_u, {_SUMS} FROM pool GROUP BY ALL),
    v AS (SELECT best.*, {S.counts(NAMES)} FROM best)
    SELECT v.text_id, v.line_num, count(*) AS n_parts, CAST(sum(v.n) AS BIGINT) AS n_sylls, round(sum(v.score), 6) AS score, CAST(sum({' + '.join(f'v.{k}' for k in NAMES)}) AS BIGINT) AS num_viols,
    CASE WHEN product(many) < 1125899906842624 THEN CAST(product(many) AS BIGINT) END AS num_parses, round(sum(score_u), 6) AS score_unbounded, CAST(sum(u.n * many) AS BIGINT) AS num_sylls_unbounded,
    {', '.join(f'CAST(sum({k}_u) AS BIGINT) AS {k}_unbounded' for k in NAMES)}, string_agg(translate(v.meter, 'ws', '-+'), ' | ' ORDER BY v.linepart) AS meter_str
    FROM v JOIN u USING ({UNIT}) GROUP BY v.text_id, v.line_num"""
)
def export_unbounded(spark, sf_dir):
    """Lines with sums over the best and over all undominated parses, and the product of the parts' ambiguity."""
    return texts.export_lines(tokens.line_parts(docs(spark, sf_dir)))


@query(
    S.scored()
    + f""", {LISTS}, side AS (SELECT {UNIT}, {', '.join(NAMES)}, CAST(sum(scansions) AS BIGINT) AS many FROM pool GROUP BY ALL),
    pair AS (SELECT a.text_id, a.line_num, a.linepart, {', '.join(f'a.{k} + b.{k} AS {k}' for k in NAMES)}, CAST(sum(a.many * b.many) AS BIGINT) AS many
      FROM side a JOIN side b ON a.text_id = b.text_id AND a.line_num = b.line_num AND b.linepart = a.linepart + 1 GROUP BY ALL),
    kept AS (SELECT a.* FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b WHERE a.text_id = b.text_id AND a.line_num = b.line_num AND a.linepart = b.linepart AND {_DOMINATED} AND ({_LESS}))),
    won AS (SELECT {UNIT}, CAST(sum(many) AS BIGINT) AS n_kept FROM kept GROUP BY ALL),
    top AS (SELECT * FROM (SELECT {UNIT}, CAST({' + '.join(NAMES)} AS DOUBLE) AS best_score, {', '.join(NAMES)}, row_number() OVER (PARTITION BY {UNIT} ORDER BY {' + '.join(NAMES)}, {', '.join(NAMES)}) AS rn FROM kept) WHERE rn = 1),
    tot AS (SELECT {UNIT}, CAST(sum(many) AS BIGINT) AS n_product FROM pair GROUP BY ALL)
    SELECT text_id, line_num, linepart, n_product, n_kept, best_score, {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in NAMES)} FROM tot JOIN won USING ({UNIT}) JOIN top USING ({UNIT})"""
)
def combine_parses(spark, sf_dir):
    """Neighbouring parts parsed as one: the product of their parse lists, bounded and ranked again."""
    return texts.combined_neighbours(units.neighbours_of(docs(spark, sf_dir)))


def _merged(k: int, last: int) -> str:
    """SQL of round k: pairs of neighbouring fronts added, dominated sums dropped; the odd one waits."""
    u = "text_id, line_num, linepart"
    return f"""
m{k} AS (SELECT a.text_id, a.line_num, a.linepart, a.seq // 2 AS seq, {', '.join(f'a.{x} + b.{x} AS {x}' for x in NAMES)}, sum(a.many * b.many) AS many
  FROM f{k - 1} a JOIN f{k - 1} b ON a.text_id = b.text_id AND a.line_num = b.line_num AND a.linepart = b.linepart AND a.seq % 2 = 0 AND b.seq = a.seq + 1 GROUP BY ALL),
f{k} AS (SELECT a.* FROM m{k} a WHERE NOT EXISTS (SELECT 1 FROM m{k} b WHERE a.text_id = b.text_id AND a.line_num = b.line_num AND a.linepart = b.linepart AND a.seq = b.seq AND {_DOMINATED} AND ({_LESS}))
  UNION ALL SELECT {u}, seq // 2 AS seq, {', '.join(NAMES)}, many FROM f{k - 1} JOIN (SELECT {u}, max(seq) AS top FROM f{k - 1} GROUP BY ALL) USING ({u}) WHERE seq = top AND seq % 2 = 0)"""


#: Long parts cut at clause openers, the pieces numbered as line parts of their own (part * 1000 + piece).
_CLAUSES = S.PARTS.removesuffix("units AS (SELECT * FROM parts WHERE len(words) > 0)") + f"""long AS (SELECT * FROM parts WHERE len(words) > 0 AND (
  SELECT sum(len(regexp_extract_all(lower(w), '{ortho.CHUNK}'))) FROM (SELECT unnest(words) AS w)) > 18),
lw AS (SELECT text_id, line_num, linepart, unnest(words) AS w, unnest(range(0, len(words))) AS k FROM long),
op AS (SELECT *, sum(CASE WHEN k > 0 AND lower(w) IN {S.in_list(products.OPENERS)} THEN 1 ELSE 0 END) OVER (PARTITION BY text_id, line_num, linepart ORDER BY k) + 1 AS piece FROM lw),
units AS (SELECT text_id, line_num, CAST(linepart * 1000 + piece AS BIGINT) AS linepart, list(w ORDER BY k) AS words FROM op GROUP BY ALL)"""


@query(
    S.scored().replace(S.PARTS, _CLAUSES)
    + f""", {LISTS}, side AS (SELECT {UNIT}, {', '.join(NAMES)}, CAST(sum(scansions) AS DOUBLE) AS many FROM pool GROUP BY ALL),
    sz AS (SELECT {UNIT}, sum(many) AS size FROM side GROUP BY ALL),
    ns AS (SELECT text_id, line_num, linepart, max(n) AS n FROM enc GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY text_id, line_num, linepart // 1000 ORDER BY linepart) - 1 AS seq FROM sz JOIN ns USING (text_id, line_num, linepart)),
    tot AS (SELECT text_id, line_num, CAST(linepart // 1000 AS INTEGER) AS linepart, CAST(count(*) AS INTEGER) AS n_pieces, CAST(sum(n) AS INTEGER) AS n, product(size) AS n_product FROM numbered GROUP BY ALL),
    f0 AS (SELECT text_id, line_num, linepart // 1000 AS linepart, seq, {', '.join(f'CAST({k} AS BIGINT) AS {k}' for k in NAMES)}, many FROM side JOIN (SELECT text_id, line_num, linepart, seq FROM numbered) USING (text_id, line_num, linepart)),"""
    + ",".join(_merged(k, 7) for k in range(1, 8))
    + f""",
    won AS (SELECT text_id, line_num, linepart, sum(many) AS n_kept FROM f7 GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, CAST({' + '.join(NAMES)} AS DOUBLE) AS best_score, row_number() OVER (PARTITION BY text_id, line_num, linepart ORDER BY {' + '.join(NAMES)}, {', '.join(NAMES)}) AS rn FROM f7) WHERE rn = 1)
    SELECT text_id, line_num, linepart, n_pieces, n, n_product, n_kept, best_score, {', '.join(f'CAST(top.{k} AS INTEGER) AS {k}' for k in NAMES)}
    FROM tot JOIN won USING (text_id, line_num, linepart) JOIN top USING (text_id, line_num, linepart)"""
)
def clause_products(spark, sf_dir):
    """Line parts of more than 18 syllables cut before clause openers; the pieces' parses multiplied, bounded and ranked again."""
    parts = tokens.line_parts(docs(spark, sf_dir))
    chunks = F.size(F.regexp_extract_all(F.lower(F.array_join("words", " ")), F.lit(ortho.CHUNK), F.lit(0)))
    return products.combined(products.clause_pieces(parts.where(chunks > 18)))


@query(
    """WITH s AS (SELECT doc_id, CASE WHEN length(trim(text)) = 0 OR text IS NULL THEN 'empty' WHEN NOT regexp_matches(text, '\\p{L}') THEN 'no words' ELSE 'ok' END AS status,
      doc_id IN (SELECT doc_id FROM labels) AS early FROM documents)
    SELECT 1 AS run, count(*) FILTER (early AND status = 'ok') AS n_done, CAST(0 AS BIGINT) AS n_skipped, count(*) FILTER (early AND status <> 'ok') AS n_failed FROM s
    UNION ALL SELECT 2, count(*) FILTER (NOT early AND status = 'ok'), count(*) FILTER (early), count(*) FILTER (NOT early AND status <> 'ok') FROM s"""
)
def bulk_parse(spark, sf_dir):
    """A bulk run over the labelled texts, then one over all that resumes; what each has done, skipped and refused."""
    path = scratch.new_path(spark, "bulk")
    rows = docs(spark, sf_dir).select("doc_id", "text")
    first = rows.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    found = [(k, *texts.parse_corpus(part, path).values()) for k, part in enumerate((first, rows), 1)]
    scratch.delete(spark, path)
    return spark.createDataFrame(found, "run int, n_done long, n_skipped long, n_failed long")


# ---- phrasal and line constraints, over parts of six words of each conversation turn ----

PHRASAL = parse.Meter(weights=dict.fromkeys([*C.DEFAULT, "w_prom", "s_demoted"], 1.0))
_PHRASAL = ["w_prom", "s_demoted"]


def phrasal_units(spark, sf_dir):
    """Six words at a time of every turn, with their phrasal stress."""
    deps = dependency_rows(spark, sf_dir)
    stress = trees.phrasal_stress(deps).select("text_id", "sent_num", "word_num", "phrasal_stress")
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("text_id"), F.col("turn").cast("int").alias("sent_num"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word_num", "w")
    )
    rows = words.join(stress, ["text_id", "sent_num", "word_num"]).groupBy("text_id", F.col("sent_num").alias("line_num"), F.floor(F.col("word_num") / 6).cast("int").alias("linepart"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("word_num", "w", "phrasal_stress"))).alias("x"))
    return rows.select(
        "text_id", "line_num", "linepart", F.transform("x", lambda x: x["w"]).alias("words"), F.transform("x", lambda x: x["phrasal_stress"]).alias("phrasal_stress")
    )


_STRESS = """walk(text_id, sent_num, word_num, depth) AS (SELECT text_id, sent_num, word_num, 0 FROM deps WHERE head = -1
  UNION ALL SELECT d.text_id, d.sent_num, d.word_num, w.depth + 1 FROM deps d JOIN walk w ON d.text_id = w.text_id AND d.sent_num = w.sent_num AND d.head = w.word_num),
near_words AS (SELECT d.*, depth, count(*) OVER g AS sib, count(*) FILTER (xpos = 'NN') OVER g AS nn, min(CASE WHEN xpos = 'NN' THEN word_num END) OVER g AS f,
  count(*) FILTER (pos IN ('NOUN', 'VERB')) OVER g AS cn, max(CASE WHEN pos IN ('NOUN', 'VERB') THEN word_num END) OVER g AS l
  FROM deps d JOIN walk USING (text_id, sent_num, word_num) WINDOW g AS (PARTITION BY text_id, sent_num, head)),
ps AS (SELECT text_id, sent_num, word_num, -depth + CASE WHEN head < 0 OR sib < 2 THEN 0 WHEN nn >= 2 THEN CASE WHEN word_num = f THEN 1 ELSE 0 END WHEN cn >= 2 THEN CASE WHEN word_num = l THEN 1 ELSE 0 END ELSE 0 END AS p FROM near_words),
units AS (SELECT text_id, sent_num AS line_num, word_num // 6 AS linepart, list(w ORDER BY word_num) AS words FROM wd GROUP BY ALL),
marks_of AS (SELECT text_id, sent_num AS line_num, word_num // 6 AS linepart, max(CASE WHEN p <> 0 THEN 1 ELSE 0 END) AS has FROM ps GROUP BY ALL)"""
_PH_KEY = f"{S.KEY}, ph_hi, ph_lo"
_PH_VIOL = S.VIOLATIONS | {"w_prom": f"ph_hi & {S.W_}", "s_demoted": "ph_lo & s"}
_PH_COUNTS = ", ".join(f"CAST(bit_count({_PH_VIOL[k]}) AS INTEGER) AS {k}" for k in [*NAMES, *_PHRASAL])
_PH_ENC = f"""{_DEPS}, {S.encoded(18, _STRESS)},
bits AS (SELECT z.text_id, z.line_num, z.linepart, CAST(sum(CASE WHEN has = 1 AND p >= -1 THEN ((CAST(1 AS BIGINT) << CAST(wn AS INTEGER)) - 1) << CAST(off AS INTEGER) ELSE 0 END) AS BIGINT) AS ph_hi,
  CAST(sum(CASE WHEN has = 1 AND p <= -2 THEN ((CAST(1 AS BIGINT) << CAST(wn AS INTEGER)) - 1) << CAST(off AS INTEGER) ELSE 0 END) AS BIGINT) AS ph_lo
  FROM sized z JOIN ps ON ps.text_id = z.text_id AND ps.sent_num = z.line_num AND ps.word_num = z.linepart * 6 + z.wi - 1
  JOIN marks_of ON marks_of.text_id = z.text_id AND marks_of.line_num = z.line_num AND marks_of.linepart = z.linepart WHERE z.n BETWEEN 2 AND 18 GROUP BY ALL),
phe AS (SELECT * FROM enc JOIN bits USING (text_id, line_num, linepart))"""


@query(
    f"""WITH RECURSIVE {_PH_ENC},{S.scansions()}, sig AS (SELECT DISTINCT {_PH_KEY} FROM phe),
    scored AS (SELECT *, CAST({' + '.join([*NAMES, *_PHRASAL])} AS DOUBLE) AS score FROM (SELECT sig.*, scan_ord, meter, {_PH_COUNTS} FROM sig JOIN scan USING (n))),
    persig AS (SELECT {_PH_KEY}, min(score * 100000 + scan_ord) AS code FROM scored GROUP BY ALL),
    pick AS (SELECT phe.*, floor(code / 100000) AS score, CAST(code - 100000 * floor(code / 100000) AS INTEGER) AS scan_ord FROM phe JOIN persig USING ({_PH_KEY})),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {UNIT} ORDER BY score, variant) AS rn FROM pick) WHERE rn = 1)
    SELECT b.text_id, CAST(b.line_num AS INTEGER) AS line_num, CAST(b.linepart AS INTEGER) AS linepart, b.variant, b.ph_hi, b.ph_lo, b.score, s.meter, s.w_prom, s.s_demoted
    FROM best b JOIN scored s ON {' AND '.join(f's.{k} = b.{k}' for k in _PH_KEY.split(', '))} AND s.scan_ord = b.scan_ord"""
)
def phrasal_parse(spark, sf_dir):
    """F11, 2.8: best parses under w_prom and s_demoted beside the default constraints, fed by phrasal stress."""
    encoded = units.encoded(units.with_phrasal(phrasal_units(spark, sf_dir)).drop("phrasal_stress"))
    rows = parse.best(encoded, PHRASAL)
    return rows.select("text_id", "line_num", "linepart", "variant", "ph_hi", "ph_lo", "score", "meter", *C.counts(tuple(_PHRASAL)))


@query(
    S.best() + f""" SELECT {UNIT}, CASE WHEN n_strong <> 5 THEN 1 ELSE 0 END AS pentameter, CASE WHEN meter LIKE 'ws%' THEN 0 ELSE 1 END AS iambic FROM best"""
)
def line_constraints(spark, sf_dir):
    """2.8: the line-scope constraints (five peaks, an iambic beginning) on every best parse."""
    rows = parse.best_of(tokens.line_parts(docs(spark, sf_dir)))
    return rows.select("text_id", "line_num", "linepart", *C.counts(("pentameter", "iambic")))


@query(
    S.scored(S.DEFAULT)
    + f""", w0 AS (SELECT {S.KEY}, 2.0 * w_peak + w_stress + 0.5 * s_unstress AS z, unb.* EXCLUDE ({S.KEY}) FROM unb)
    SELECT {S.KEY}, round(min(CAST(z AS DOUBLE)), 6) AS least FROM w0 GROUP BY {S.KEY}""".replace(", w0 AS", f", {_VECTORS}, w0 AS", 1)
)
def zero_weights(spark, sf_dir):
    """B2: the least score of every rhythm where half of the constraints have the weight 0."""
    meter = parse.Meter(weights=dict(zip(C.DEFAULT, (2.0, 1.0, 0.5, 0.0, 0.0, 0.0), strict=True)))
    from .parse_queries import encoded

    return parse.undominated(encoded(spark, sf_dir), meter).groupBy(*meter.key).agg(F.round(F.min("score"), 6).alias("least"))
