"""Queries over rhymes, forms, syntax, corpora and phonology, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from metrika.functions import ortho
from metrika.operators import form, parse, rhyme, tokens, trees, units
from metrika.sources import corpus
from metrika.sources.scratch import dealt, written

from . import sql as S
from .parse_queries import encoded
from .text_queries import docs, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return added


ENDS = f"""{S.LINE_UNITS},
lastw AS (SELECT text_id, line_num, lower(words[len(words)]) AS word FROM units),
chs AS (SELECT *, {S.CHUNKS('word')} AS ch FROM lastw),
ends AS (SELECT text_id, line_num, word, CASE WHEN len(ch) = 0 THEN NULL
  WHEN len(ch) > 1 AND NOT ((len(ch) - 1) % 2 = 0 AND len(ch) - 1 < len(ch) - 1) AND (len(ch) = 2 OR (len(ch) - 2) % 2 = 0)
    THEN {S.RIME('ch[len(ch) - 1]')} || ch[len(ch)]
  ELSE {S.RIME('ch[len(ch)]')} END AS rime FROM chs)"""


def lines(spark, sf_dir):
    return tokens.whole_lines(docs(spark, sf_dir))


def ends(spark, sf_dir):
    return tokens.line_ends(docs(spark, sf_dir))


@query(f"WITH {ENDS} SELECT * FROM ends")
def rime(spark, sf_dir):
    """The rime of every line's last word."""
    return rhyme.line_ends(ends(spark, sf_dir))


@query(
    f"""WITH {ENDS}, good AS (SELECT * FROM ends WHERE rime IS NOT NULL),
    prev AS (SELECT a.text_id, a.line_num, a.word, a.rime, max(b.line_num) AS partner FROM good a JOIN good b
      ON a.text_id = b.text_id AND a.rime = b.rime AND b.line_num < a.line_num AND a.word <> b.word GROUP BY ALL)
    SELECT * FROM prev"""
)
def rhyming_lines_exact(spark, sf_dir):
    """Lines with an exact rhyme before them in their text, and the nearest."""
    return rhyme.rhyming_lines(ends(spark, sf_dir))


EDGES = f"""{ENDS}, good AS (SELECT * FROM ends WHERE rime IS NOT NULL),
pairs AS (SELECT a.text_id, a.line_num AS i, b.line_num AS j,
  CASE WHEN a.rime = b.rime THEN 0.0 ELSE levenshtein(translate(a.rime, '{rhyme.ACCENTED}', '{rhyme.BASE}'), translate(b.rime, '{rhyme.ACCENTED}', '{rhyme.BASE}')) / CAST(greatest(length(a.rime), length(b.rime)) AS DOUBLE) END AS dist
  FROM good a JOIN good b ON a.text_id = b.text_id AND b.line_num BETWEEN a.line_num - 4 AND a.line_num + 4 AND a.line_num <> b.line_num AND a.word <> b.word),
near AS (SELECT text_id, i, dist, j FROM (SELECT *, row_number() OVER (PARTITION BY text_id, i ORDER BY dist, j) AS rn FROM pairs) WHERE rn = 1),
edges AS (SELECT DISTINCT n.text_id, least(n.i, n.j) AS a, greatest(n.i, n.j) AS b FROM near n LEFT JOIN near m ON m.text_id = n.text_id AND m.i = n.j
  WHERE n.dist <= 0.35 AND (COALESCE(m.j = n.i, false) OR n.dist <= 0.175))"""


@query(f"WITH {EDGES} SELECT * FROM edges")
def rhyme_edges(spark, sf_dir):
    """Rhyme links between nearest neighbours within four lines (spelling distance)."""
    return rhyme.rhyme_edges(rhyme.line_ends(ends(spark, sf_dir)))


IDS = f"""{EDGES.replace('WITH ', '')},
both_ways AS (SELECT text_id, a AS x, b AS y FROM edges UNION ALL SELECT text_id, b, a FROM edges),
reach(text_id, x, y) AS (SELECT text_id, x, x FROM both_ways UNION SELECT r.text_id, r.x, b.y FROM reach r JOIN both_ways b ON r.text_id = b.text_id AND r.y = b.x),
roots AS (SELECT text_id, x AS line_num, min(y) AS root FROM reach GROUP BY ALL),
ids AS (SELECT e.text_id, e.line_num, CAST(CASE WHEN root IS NULL THEN 0 ELSE rid END AS INTEGER) AS rhyme_id FROM ends e
  LEFT JOIN (SELECT *, dense_rank() OVER (PARTITION BY text_id ORDER BY root) AS rid FROM roots) r USING (text_id, line_num))"""


@query(f"WITH RECURSIVE {IDS} SELECT * FROM ids")
def rhyme_ids(spark, sf_dir):
    """Rhyme groups by line, numbered by first appearance."""
    return rhyme.rhyme_ids(ends(spark, sf_dir))


_SCHEMES = ", ".join(
    f"({k}, {S.quoted(name)}, {S.quoted(scheme)}, {rhyme.scheme_numbers(scheme)})" for k, (name, scheme) in enumerate(rhyme.SCHEMES)
)
SCORES = f"""{IDS},
sch(ord, form, scheme, target) AS (VALUES {_SCHEMES}),
seq AS (SELECT text_id, rhyme_id, row_number() OVER (PARTITION BY text_id ORDER BY line_num) - 1 AS k FROM ids),
win AS (SELECT text_id, ord, len(target) AS z, k // len(target) AS w, k % len(target) + 1 AS p, rhyme_id, target[k % len(target) + 1] AS t FROM seq, sch),
size AS (SELECT text_id, ord, w, count(*) AS c, max(z) AS z FROM win GROUP BY ALL),
edge AS (SELECT a.text_id, a.ord, a.w, count(*) FILTER (a.rhyme_id = b.rhyme_id AND a.rhyme_id <> 0 AND a.t = b.t AND a.t <> 0) AS both_n,
  count(*) FILTER ((a.rhyme_id = b.rhyme_id AND a.rhyme_id <> 0) OR (a.t = b.t AND a.t <> 0)) AS any_n
  FROM win a JOIN win b ON a.text_id = b.text_id AND a.ord = b.ord AND a.w = b.w AND a.p < b.p GROUP BY ALL),
score AS (SELECT s.text_id, s.ord, avg(CASE WHEN COALESCE(any_n, 0) = 0 THEN 0.0 ELSE both_n / CAST(any_n AS DOUBLE) END) - sum(CASE WHEN c < z THEN 1 ELSE 0 END) AS score
  FROM size s LEFT JOIN edge USING (text_id, ord, w) GROUP BY ALL),
ranked AS (SELECT text_id, form, scheme, score, CAST(row_number() OVER (PARTITION BY text_id ORDER BY round(score, 9) DESC, length(form) DESC, ord) AS INTEGER) AS rank FROM score JOIN sch USING (ord))"""


@query(f"WITH RECURSIVE {SCORES} SELECT text_id, rank, form, scheme, round(score, 6) AS accuracy FROM ranked WHERE rank <= 5")
def scheme_match(spark, sf_dir):
    """The five named rhyme schemes that fit each text best."""
    return rhyme.scheme_match(rhyme.rhyme_ids(ends(spark, sf_dir)), top=5)


LENGTHS = f"""lw AS (SELECT text_id, line_num, unnest(words) AS w FROM units),
ls AS (SELECT text_id, line_num, CAST(sum(len({S.CHUNKS('w')})) AS INTEGER) AS length FROM lw GROUP BY ALL)"""


def line_lengths(spark, sf_dir):
    """Canonical syllables of every line."""
    return lines(spark, sf_dir).select("text_id", "line_num", _length())


def _length():
    return F.aggregate("words", F.lit(0), lambda a, w: a + F.size(ortho.syllables(w))).alias("length")


def rhymed_lengths(spark, sf_dir):
    """Line ends with the lines' lengths, all read from the texts once."""
    return written(rhyme.line_ends(lines(spark, sf_dir), _length()), "ends")


@query(
    f"""WITH RECURSIVE {SCORES}, {LENGTHS.replace('units', '(SELECT text_id, line_num, words FROM units)')},
    per AS (SELECT text_id, count(*) AS n_lines, CAST(floor(median(length)) AS INTEGER) AS median_sylls FROM ls GROUP BY text_id)
    SELECT p.text_id, n_lines, median_sylls, n_lines = 14 AND median_sylls BETWEEN 9 AND 11 AND contains(lower(form), 'sonnet') AS is_sonnet,
    n_lines = 14 AND median_sylls BETWEEN 9 AND 11 AND contains(lower(form), 'sonnet') AND contains(lower(form), 'shakespeare') AS is_shakespearean_sonnet
    FROM per p JOIN ranked r ON p.text_id = r.text_id AND r.rank = 1"""
)
def is_sonnet(spark, sf_dir):
    """Sonnet predicates."""
    rows = rhymed_lengths(spark, sf_dir)
    return form.sonnets(rows.select("text_id", "line_num", "length"), rhyme.scheme_match(rhyme.rhyme_ids_of(rows)))


def _template_sql(lengths: str, beat: bool) -> str:
    odd = "0" if beat else "CASE WHEN o % 2 <> 0 THEN 5 ELSE 0 END"
    return f"""seq AS (SELECT text_id, length, row_number() OVER (PARTITION BY text_id ORDER BY line_num) - 1 AS i, count(*) OVER (PARTITION BY text_id) AS n FROM {lengths}),
ks AS (SELECT DISTINCT text_id, n, k FROM seq, range(1, 11) AS r(k) WHERE n % k = 0),
med AS (SELECT s.text_id, k, s.i % k AS p, CAST(floor(median(length)) AS INTEGER) AS m FROM seq s JOIN ks USING (text_id) GROUP BY ALL),
opt AS (SELECT med.*, m + d AS o, d FROM med, (VALUES (-1), (0), (1)) AS v(d)),
cost AS (SELECT opt.text_id, opt.k, opt.p, opt.o, opt.d, CAST(sum(abs(length - opt.o)) AS BIGINT) * {2 if beat else 1} + max({odd}) AS c
  FROM opt JOIN seq s ON s.text_id = opt.text_id AND s.i % opt.k = opt.p GROUP BY ALL),
grow(text_id, k, p, scheme, code, lo, hi, c) AS (
  SELECT text_id, k, p, CAST(o AS VARCHAR), CAST(d + 1 AS VARCHAR), o, o, c FROM cost WHERE p = 0
  UNION ALL SELECT g.text_id, g.k, n.p, g.scheme || '-' || n.o, g.code || (n.d + 1), least(g.lo, n.o), greatest(g.hi, n.o), g.c + n.c
  FROM grow g JOIN cost n ON n.text_id = g.text_id AND n.k = g.k AND n.p = g.p + 1),
done AS (SELECT text_id, k, scheme, code, c + CASE WHEN k > 1 THEN 1 ELSE 0 END AS diff FROM grow WHERE p = k - 1 AND (k = 1 OR lo <> hi)),
tpl AS (SELECT text_id, scheme, CAST(diff AS BIGINT) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY diff, k, code) AS rn FROM done) WHERE rn = 1)"""


@query(
    f"""WITH RECURSIVE {S.LINE_UNITS}, {LENGTHS}, {_template_sql('ls', False)}
    SELECT text_id, scheme, diff, CASE len(string_split(replace(scheme, '--', '-'), '-')) WHEN 1 THEN 'Invariable' WHEN 2 THEN 'Alternating' ELSE 'Complex' END AS kind FROM tpl"""
)
def syllable_scheme(spark, sf_dir):
    """The template of line lengths in syllables."""
    return form.line_scheme(line_lengths(spark, sf_dir), beat=False).withColumn("kind", form.scheme_type(F.replace("scheme", F.lit("--"), F.lit("-"))))


def feet_lengths(spark, sf_dir):
    """Feet of every line: those of its parsed parts."""
    best = parse.with_properties(parse.best_of(tokens.line_parts(docs(spark, sf_dir))))
    return best.groupBy("text_id", "line_num").agg(F.sum(F.size(F.split("feet", " "))).cast("int").alias("length"))


@query(
    S.best()
    + f""", {S.PROPERTIES}, fl AS (SELECT text_id, line_num, CAST(sum(len(fa)) AS INTEGER) AS length FROM typed GROUP BY ALL), {_template_sql('fl', True)} SELECT * FROM tpl"""
)
def line_scheme(spark, sf_dir):
    """The template of line lengths in feet."""
    return form.line_scheme(feet_lengths(spark, sf_dir), beat=True)


@query(
    S.best()
    + """, c AS (SELECT text_id, count(*) AS n_lines, CAST(sum(n_pos) AS BIGINT) AS n_positions,
    """
    + ", ".join(f"CAST(sum(len(list_filter(string_split(positions, '|'), lambda p: p = '{k}'))) AS BIGINT) AS n_{k}" for k in ("w", "s", "ww", "ss"))
    + """, count(*) FILTER (n >= 4) AS n_fourth, count(*) FILTER (substr(meter, 4, 1) = 's') AS n_fourth_s FROM best GROUP BY text_id),
    f AS (SELECT *, CASE WHEN n_ww / CAST(n_positions AS DOUBLE) > 0.175 THEN 'ternary' ELSE 'binary' END AS foot, CASE WHEN n_fourth > 0 THEN n_fourth_s / CAST(n_fourth AS DOUBLE) ELSE 0.0 END AS sh FROM c),
    h AS (SELECT *, CASE WHEN (foot = 'ternary' AND sh > 0.5) OR (foot = 'binary' AND sh < 0.5) THEN 'initial' ELSE 'final' END AS head FROM f)
    SELECT text_id, n_lines, n_positions, n_w, n_s, n_ww, n_ss, n_fourth, n_fourth_s, foot, head,
    CASE WHEN foot = 'ternary' AND head = 'final' THEN 'anapestic' WHEN foot = 'ternary' THEN 'dactylic' WHEN head = 'initial' THEN 'trochaic' ELSE 'iambic' END AS type FROM h"""
)
def meter_type(spark, sf_dir):
    """The meter type of each text."""
    return form.meter_type(parse.best_of(tokens.line_parts(docs(spark, sf_dir))))


@query(
    f"""WITH RECURSIVE {IDS}, {LENGTHS.replace('units', '(SELECT text_id, line_num, words FROM units)')}
    SELECT i.text_id, i.line_num, e.word AS last_word, e.rime, l.length AS n_sylls, i.rhyme_id,
    CASE WHEN i.rhyme_id < 27 THEN substr('-abcdefghijklmnopqrstuvwxyz', i.rhyme_id + 1, 1) ELSE CAST(i.rhyme_id AS VARCHAR) END AS letter
    FROM ids i JOIN ends e USING (text_id, line_num) JOIN ls l USING (text_id, line_num)"""
)
def summary_rows(spark, sf_dir):
    """The rows of a text's summary."""
    found = rhymed_lengths(spark, sf_dir)
    rows = rhyme.rhyme_ids_of(found).join(dealt(found), ["text_id", "line_num"])
    letter = rhyme.scheme_letters(F.array("rhyme_id"))
    return rows.select("text_id", "line_num", F.col("word").alias("last_word"), "rime", F.col("length").alias("n_sylls"), "rhyme_id", letter.alias("letter"))


# ---- syntax over a dependency table derived from words: each word depends on the next longer one ----

_DEPS = """wd AS (SELECT conv_id AS text_id, CAST(turn AS INTEGER) AS sent_num, unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w, CAST(unnest(range(0, len(regexp_extract_all(text, '[\\p{L}]+')))) AS INTEGER) AS word_num FROM conversations),
deps AS (SELECT text_id, sent_num, word_num, CASE WHEN word_num = 0 THEN -1 ELSE word_num // 2 - CASE WHEN word_num % 2 = 0 THEN 1 ELSE 0 END END AS head,
  CASE WHEN length(w) > 6 THEN 'NOUN' WHEN length(w) > 4 THEN 'VERB' ELSE 'ADP' END AS pos, CASE WHEN length(w) > 6 THEN 'NN' WHEN length(w) > 4 THEN 'VB' ELSE 'IN' END AS xpos FROM wd)"""


def heap_head(k: Column) -> Column:
    """The head of word k in a heap-shaped tree, -1 for the first."""
    return F.when(k == 0, -1).otherwise(F.floor(k / 2).cast("int") - F.when(k % 2 == 0, 1).otherwise(0))


def dependency_rows(spark, sf_dir):
    """A dependency table with heap-shaped trees over the words of all conversation turns: deterministic stand-in for a parser's output."""
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("text_id"), F.col("turn").cast("int").alias("sent_num"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word_num", "w"),
    )
    size = F.length("w")
    return words.select(
        "text_id", "sent_num", "word_num", heap_head(F.col("word_num")).alias("head"),
        F.when(size > 6, "NOUN").when(size > 4, "VERB").otherwise("ADP").alias("pos"),
        F.when(size > 6, "NN").when(size > 4, "VB").otherwise("IN").alias("xpos"),
    )


@query(
    f"""WITH RECURSIVE {_DEPS}, walk(text_id, sent_num, word_num, depth) AS (SELECT text_id, sent_num, word_num, 0 FROM deps WHERE head = -1
      UNION ALL SELECT d.text_id, d.sent_num, d.word_num, w.depth + 1 FROM deps d JOIN walk w ON d.text_id = w.text_id AND d.sent_num = w.sent_num AND d.head = w.word_num),
    j AS (SELECT d.*, depth, count(*) OVER g AS sib, count(*) FILTER (xpos IN ('NN', 'NNS', 'NNP', 'NNPS')) OVER g AS nn, min(CASE WHEN xpos IN ('NN', 'NNS', 'NNP', 'NNPS') THEN word_num END) OVER g AS f,
      count(*) FILTER (pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN')) OVER g AS cn, max(CASE WHEN pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') THEN word_num END) OVER g AS l
      FROM deps d JOIN walk USING (text_id, sent_num, word_num) WINDOW g AS (PARTITION BY text_id, sent_num, head))
    SELECT text_id, sent_num, word_num, CAST(-depth + CASE WHEN head < 0 OR sib < 2 THEN 0 WHEN nn >= 2 THEN CASE WHEN word_num = f THEN 1 ELSE 0 END WHEN cn >= 2 THEN CASE WHEN word_num = l THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS phrasal_stress FROM j"""
)
def phrasal_stress(spark, sf_dir):
    """phrasal stress from dependency depth, compound and nuclear stress rules (one row a sentence)."""
    return trees.phrasal_stress(dependency_rows(spark, sf_dir)).select("text_id", "sent_num", "word_num", "phrasal_stress")


@query(
    f"""WITH RECURSIVE {_DEPS}, lx AS (SELECT text_id, sent_num, word_num, CASE WHEN xpos = 'IN' THEN -0.5 ELSE 0.0 END AS lexstress, length(w) AS z FROM deps JOIN wd USING (text_id, sent_num, word_num)),
    p AS (SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b FROM lx WINDOW w AS (PARTITION BY text_id, sent_num ORDER BY word_num)),
    q AS (SELECT *, (COALESCE(z > a, false) AND COALESCE(z >= b, true)) OR (COALESCE(z > b, false) AND COALESCE(z >= a, true)) AS peak,
      (COALESCE(z < a, false) AND COALESCE(z <= b, true)) OR (COALESCE(z < b, false) AND COALESCE(z <= a, true)) AS valley FROM p)
    SELECT text_id, sent_num, word_num, CAST(lexstress AS DOUBLE) AS lexstress, CAST(CASE WHEN lexstress = -0.5 THEN 0.0 ELSE lexstress END AS DOUBLE) AS most, CAST(CASE WHEN lexstress = -0.5 THEN -1.0 ELSE lexstress END AS DOUBLE) AS least, peak, valley,
    CAST(CASE WHEN peak THEN 1 WHEN valley THEN -1 ELSE 0 END AS INTEGER) AS strength FROM q"""
)
def lexical_stress(spark, sf_dir):
    """Lexical stress of words, its two disambiguations, and peaks and valleys of word length."""
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("text_id"), F.col("turn").cast("int").alias("sent_num"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word_num", "w"),
    )
    size = F.length("w")
    tag = F.when(size > 6, "NN").when(size > 4, "VB").otherwise("IN")
    rows = words.withColumn("z", size).withColumn("lexstress", trees.lexical_stress(tag, F.lit("")))
    rows = trees.prominence(rows, "z", ["text_id", "sent_num"], "word_num")
    return rows.select(
        "text_id", "sent_num", "word_num", "lexstress", trees.disambiguated(F.col("lexstress"), "max").alias("most"),
        trees.disambiguated(F.col("lexstress"), "min").alias("least"), "peak", "valley", "strength",
    )


_TREE = f"""{_DEPS},
nod AS (SELECT text_id, sent_num, word_num AS node, head AS parent, CASE WHEN pos = 'NOUN' THEN 'NP' ELSE 'VP' END AS label, CAST(NULL AS INTEGER) AS word_num, 0.0 AS lstress FROM deps
  UNION ALL SELECT text_id, sent_num, 1000000 + word_num, word_num, xpos, word_num, CASE WHEN xpos IN {S.in_list(trees.UNSTRESSED_TAGS)} THEN -1.0 WHEN xpos IN {S.in_list(trees.AMBIGUOUS_TAGS)} THEN -0.5 ELSE 0.0 END FROM deps),
up(text_id, sent_num, node) AS (SELECT text_id, sent_num, node FROM nod WHERE word_num IS NOT NULL AND lstress > -1
  UNION SELECT n.text_id, n.sent_num, n.parent FROM up JOIN nod n USING (text_id, sent_num, node)),
kids AS (SELECT n.*, EXISTS (SELECT 1 FROM up u WHERE u.text_id = n.text_id AND u.sent_num = n.sent_num AND u.node = n.node) AS has, p.label AS above,
  label_noun FROM (SELECT *, label LIKE 'NN%' AS label_noun FROM nod) n JOIN (SELECT text_id, sent_num, node AS parent, label FROM nod) p USING (text_id, sent_num, parent)),
fam AS (SELECT text_id, sent_num, parent, count(*) AS size, max(above) AS above, max(node) AS final, max(CASE WHEN has THEN node END) AS able, COALESCE(max(CASE WHEN NOT label_noun THEN node END), -1) AS other FROM kids GROUP BY ALL),
tail AS (SELECT f.*, (SELECT count(*) FROM kids k WHERE k.text_id = f.text_id AND k.sent_num = f.sent_num AND k.parent = f.parent AND k.node > f.other) AS nouns,
  (SELECT min(node) FROM kids k WHERE k.text_id = f.text_id AND k.sent_num = f.sent_num AND k.parent = f.parent AND k.node > f.other) AS noun FROM fam f),
los AS (SELECT k.text_id, k.sent_num, k.node, CASE WHEN size > 1 AND k.node <> CASE WHEN t.above = 'NP' AND nouns > 1 THEN noun ELSE COALESCE(able, final) END THEN -1 ELSE 0 END AS loss
  FROM kids k JOIN tail t USING (text_id, sent_num, parent)),
climb(text_id, sent_num, word_num, lstress, own, node_at, total) AS (SELECT n.text_id, n.sent_num, n.word_num, n.lstress, COALESCE(loss, 0), n.parent, n.lstress + COALESCE(loss, 0)
    FROM nod n LEFT JOIN los USING (text_id, sent_num, node) WHERE n.word_num IS NOT NULL
  UNION ALL SELECT c.text_id, c.sent_num, c.word_num, c.lstress, c.own, n.parent, c.total + COALESCE(l.loss, 0) FROM climb c JOIN nod n ON n.text_id = c.text_id AND n.sent_num = c.sent_num AND n.node = c.node_at
    LEFT JOIN los l ON l.text_id = n.text_id AND l.sent_num = n.sent_num AND l.node = n.node),
done AS (SELECT c.* FROM climb c WHERE NOT EXISTS (SELECT 1 FROM nod n WHERE n.text_id = c.text_id AND n.sent_num = c.sent_num AND n.node = c.node_at))"""


def tree_nodes(spark, sf_dir):
    """Constituency nodes of the derived trees."""
    deps = dependency_rows(spark, sf_dir)
    leaf = F.lit(1_000_000) + F.col("word_num")
    phrases = deps.select(
        "text_id", "sent_num", F.col("word_num").alias("node"), F.col("head").alias("parent"),
        F.when(F.col("pos") == "NOUN", "NP").otherwise("VP").alias("label"), F.lit(None).cast("int").alias("word_num"), F.lit(0.0).alias("lstress"),
    )
    leaves = deps.select(
        "text_id", "sent_num", leaf.alias("node"), F.col("word_num").alias("parent"), F.col("xpos").alias("label"), "word_num",
        trees.lexical_stress(F.col("xpos"), F.lit("")).alias("lstress"),
    )
    return phrases.unionByName(leaves)


@query(
    f"""WITH RECURSIVE {_TREE} SELECT text_id, sent_num, CAST(word_num AS INTEGER) AS word_num, CAST(lstress AS DOUBLE) AS lstress, CAST(own AS DOUBLE) AS pstress, CAST(total AS DOUBLE) AS total,
    CAST(total - min(total) OVER w + 1 AS DOUBLE) AS grid, CAST(row_number() OVER (PARTITION BY text_id, sent_num ORDER BY word_num) AS INTEGER) AS grid_i,
    round(CASE WHEN max(total) OVER w > min(total) OVER w THEN CAST(total - min(total) OVER w AS DOUBLE) / CAST(max(total) OVER w - min(total) OVER w AS DOUBLE) ELSE 0.0 END, 6) AS norm_total,
    round(CAST(row_number() OVER (PARTITION BY text_id, sent_num ORDER BY word_num) AS DOUBLE) / count(*) OVER w, 6) AS relative_index FROM done WINDOW w AS (PARTITION BY text_id, sent_num)"""
)
def tree_stress(spark, sf_dir):
    """stress over the derived trees, as sentence grids with normalised totals."""
    words = trees.normalized(trees.sentence_grid(trees.tree_stress(tree_nodes(spark, sf_dir))), "total")
    return words.select("text_id", "sent_num", "word_num", "lstress", "pstress", "total", "grid", "grid_i", "norm_total", "relative_index")


@query(
    """SELECT CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN NOT regexp_matches(text, '\\p{L}') THEN 'no words' ELSE 'ok' END AS status, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"""
)
def error_isolation(spark, sf_dir):
    """Items not yet done (those with a label are), with a status for each instead of an error."""
    items = docs(spark, sf_dir)
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id"))
    left = corpus.pending(corpus.items(items, "doc_id"), done)
    return corpus.with_status(left).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """SELECT role, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n FROM (SELECT conv_id, turn, role, text FROM conversations) GROUP BY role"""
)
def text_round_trip(spark, sf_dir):
    """Texts written as a compressed data set with its metadata and read back."""
    return corpus.round_trip(table(spark, sf_dir, "conversations")).groupBy("role").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM pages) SELECT page_id, length(trim(t)) AS n_chars, CAST(len(string_split(trim(t), ' ')) AS INTEGER) AS n_words FROM h"""
)
def html_text(spark, sf_dir):
    """E7 read backward: markup removed from pages before analysis."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.size(F.split(text, " ")).alias("n_words"))


@query(
    f"""WITH {S.encoded()}, k AS (SELECT text_id, line_num, linepart, CAST(max(n) AS INTEGER) AS n, count(*) FILTER (wn = 1 AND lw IN {S.in_list(ortho.AMBIGUOUS_WORDS)}) AS k FROM sized GROUP BY ALL)
    SELECT text_id, line_num, linepart, n, CAST(power(2, k) AS BIGINT) AS n_variants, CAST(power(2, k) AS BIGINT) AS n_rhythms FROM k WHERE n BETWEEN 2 AND 18"""
)
def product_variants(spark, sf_dir):
    """1.6#4: every combination of word forms, with the number of distinct rhythms a unit can take; tests list them one by one."""
    rows = units.product_variants(tokens.line_parts(docs(spark, sf_dir)))
    return rows.groupBy("text_id", "line_num", "linepart", "n").agg(F.count("*").alias("n_variants"), F.countDistinct("st").alias("n_rhythms"))


@query(
    f"""WITH RECURSIVE {S.best().removeprefix('WITH RECURSIVE ')}, u AS (SELECT DISTINCT text_id, line_num, linepart, score, n FROM best),
    nxt AS (SELECT text_id, line_num, linepart, score, n, lead(linepart) OVER w AS np, lead(score) OVER w AS ns, lead(n) OVER w AS nn FROM u WINDOW w AS (PARTITION BY text_id, line_num ORDER BY linepart))
    SELECT text_id, line_num, linepart, score + ns AS pair_score, n + nn AS pair_sylls FROM nxt WHERE np IS NOT NULL"""
)
def combine_neighbours(spark, sf_dir):
    """The best scores of neighbouring parts added up (combine_parses has the product of J10)."""
    w = Window.partitionBy("text_id", "line_num").orderBy("linepart")
    rows = parse.best_of(tokens.line_parts(docs(spark, sf_dir))).select(
        "text_id", "line_num", "linepart", (F.col("score") + F.lead("score").over(w)).alias("pair_score"), (F.col("n") + F.lead("n").over(w)).alias("pair_sylls")
    )
    return rows.where("pair_score is not null")
