"""DuckDB SQL of the engine's tables, built up in common table expressions for the oracles.

The oracles work on relations (one row per line, word, syllable), not on the
engine's in-row arrays and folds.
"""

from __future__ import annotations

from metrika.functions import ortho
from metrika.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def clean(column: str) -> str:
    out = column
    for old, new in T.REPLACEMENTS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return f"translate({out}, '‘’“”', '''''\"\"')"


V = ortho.VOWELS
CHUNKS = lambda w: f"regexp_extract_all(lower({w}), '{ortho.CHUNK}')"
HEAVY = lambda c: f"regexp_matches({c}, '[^{V}]$|[{V}][{V}]')"
RIME = lambda c: f"regexp_extract({c}, '[{V}].*$')"

SOURCE = f"""src AS (SELECT doc_id AS text_id, regexp_replace({clean('text')}, '-{{2,}}', '—', 'g') AS t FROM documents)"""
LINES = SOURCE + r""",
lines AS (SELECT text_id, unnest(l) AS line_txt, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_num
  FROM (SELECT text_id, string_split_regex(t, '\s*\n\s*') AS l FROM src))"""
PARTS = LINES + r""",
cut AS (SELECT text_id, line_num, unnest(p) AS part_txt, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS linepart
  FROM (SELECT text_id, line_num, string_split_regex(line_txt, '[,:;–—()\[\].!?"]') AS p FROM lines)),
parts AS (SELECT text_id, line_num, linepart, list_filter(regexp_extract_all(part_txt, '[\p{L}\p{N}_'']+'), lambda w: regexp_matches(w, '\p{L}')) AS words
  FROM cut),
units AS (SELECT * FROM parts WHERE len(words) > 0)"""
LINE_UNITS = LINES + r""",
units AS (SELECT text_id, line_num, 1 AS linepart, words FROM (
  SELECT text_id, line_num, list_filter(regexp_extract_all(line_txt, '[\p{L}\p{N}_'']+'), lambda w: regexp_matches(w, '\p{L}')) AS words
  FROM lines) WHERE len(words) > 0)"""


def encoded(longest: int = 18, units: str = PARTS) -> str:
    """enc: text_id, line_num, linepart, variant, n and masks."""
    return units + f""",
word AS (SELECT text_id, line_num, linepart, wi, w, {CHUNKS('w')} AS ch
  FROM (SELECT text_id, line_num, linepart, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS wi FROM units)),
sized AS (SELECT *, len(ch) AS wn, lower(w) AS lw,
  COALESCE(sum(len(ch)) OVER (PARTITION BY text_id, line_num, linepart ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  sum(len(ch)) OVER (PARTITION BY text_id, line_num, linepart) AS n,
  max(CASE WHEN len(ch) = 1 AND lower(w) IN {in_list(ortho.AMBIGUOUS_WORDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY text_id, line_num, linepart) AS amb
  FROM word),
short AS (SELECT *, unnest(range(0, amb + 1)) AS variant FROM sized WHERE n BETWEEN 2 AND {longest}),
syl AS (SELECT text_id, line_num, linepart, variant, CAST(n AS INTEGER) AS n, wn, lw, off, unnest(ch) AS c, unnest(range(0, wn)) AS i FROM short WHERE wn > 0),
flags AS (SELECT *, CAST(off + i AS INTEGER) AS pos, {HEAVY('c')} AS heavy,
  CASE WHEN wn = 1 THEN CASE WHEN lw IN {in_list(ortho.FUNCTION_WORDS)} THEN false
                             WHEN lw IN {in_list(ortho.AMBIGUOUS_WORDS)} THEN variant = 1 ELSE true END
       ELSE i % 2 = 0 AND (i = 0 OR i < wn - 1) END AS stressed FROM syl),
near AS (SELECT *, lag(stressed) OVER (PARTITION BY text_id, line_num, linepart, variant, off ORDER BY i) AS before,
  lead(stressed) OVER (PARTITION BY text_id, line_num, linepart, variant, off ORDER BY i) AS after FROM flags),
marks AS (SELECT *, wn > 1 AND stressed AND (COALESCE(NOT before, false) OR COALESCE(NOT after, false)) AS strong,
  wn > 1 AND NOT stressed AND (COALESCE(before, false) OR COALESCE(after, false)) AS weak,
  wn = 1 AND NOT stressed AS func FROM near),
enc AS (SELECT text_id, line_num, linepart, CAST(variant AS INTEGER) AS variant, n,
  CAST(sum(CASE WHEN stressed THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS st,
  CAST(sum(CASE WHEN heavy THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS he,
  CAST(sum(CASE WHEN strong THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS sg,
  CAST(sum(CASE WHEN weak THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS wk,
  CAST(sum(CASE WHEN func THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN i = 0 THEN CAST(1 AS BIGINT) << pos ELSE 0 END) AS BIGINT) AS wb
  FROM marks GROUP BY text_id, line_num, linepart, variant, n)"""


def scansions(longest: int = 18) -> str:
    """scan: the catalogue, by recursion over positions of at most two syllables."""
    return f"""
gen(n, kind, idx, pre, positions, meter, s, cont, n_pos, n_strong) AS (
  SELECT z, k, i, '', p, p, sm, cm, 1, ns FROM (VALUES (1, 'w', '0', 'w', 0, 0, 0), (2, 'w', '1', 'ww', 0, 2, 0), (1, 's', '2', 's', 1, 0, 1), (2, 's', '3', 'ss', 3, 2, 1)) AS t(z, k, i, p, sm, cm, ns)
  UNION ALL
  SELECT g.n + t.z, t.k, t.i, g.pre || '1' || g.idx, g.positions || '|' || t.p, g.meter || t.p,
    g.s + (CAST(t.sm AS BIGINT) << g.n), g.cont + (CAST(t.cm AS BIGINT) << g.n), g.n_pos + 1, g.n_strong + t.ns
  FROM gen g JOIN (VALUES (1, 'w', '0', 'w', 0, 0, 0), (2, 'w', '1', 'ww', 0, 2, 0), (1, 's', '2', 's', 1, 0, 1), (2, 's', '3', 'ss', 3, 2, 1)) AS t(z, k, i, p, sm, cm, ns)
    ON g.kind <> t.k AND g.n + t.z <= {longest}),
scan AS (SELECT CAST(n AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY n ORDER BY pre || '0' || idx) - 1 AS INTEGER) AS scan_ord,
  positions, meter, CAST(s AS BIGINT) AS s, CAST(cont AS BIGINT) AS cont, CAST(0 AS BIGINT) AS big, CAST(n_pos AS INTEGER) AS n_pos, CAST(n_strong AS INTEGER) AS n_strong FROM gen)"""


F_, U_, W_ = "((CAST(1 AS BIGINT) << n) - 1)", "(((CAST(1 AS BIGINT) << n) - 1) & ~st)", "(((CAST(1 AS BIGINT) << n) - 1) & ~s)"
VIOLATIONS = {
    "w_stress": f"st & {W_}",
    "s_unstress": f"{U_} & s",
    "w_peak": f"sg & {W_}",
    "s_trough": "wk & s",
    "unres_within": f"cont & ({F_} & -2) & ~wb & ((he | {U_}) << 1) & {F_}",
    "unres_across": f"cont & wb & (s | ({F_} & ~(fn & (fn << 1))))",
    "foot_size": "big",
    "clash": f"st & (st << 1) & ({W_} | ({W_} << 1)) & {F_}",
    "lapse": f"{U_} & ({U_} << 1) & (s | (s << 1)) & ({F_} & -2)",
    "w_heavy": f"he & {W_}",
    "s_light": f"({F_} & ~he) & s",
    "s_func": "fn & s",
    "word_foot": "wb & cont",
}
#: By zone: the first two syllables and the rest.
ZONED = {f"{k}{z}": f"({v}) & {m}" for k, v in VIOLATIONS.items() for z, m in (("_init", 3), ("_rest", -4))}
DEFAULT = ["w_peak", "w_stress", "s_unstress", "unres_across", "unres_within", "foot_size"]
KEY = "n, fn, he, sg, st, wb"


def counts(names: list[str]) -> str:
    return ", ".join(f"CAST(bit_count({(VIOLATIONS | ZONED)[k]}) AS INTEGER) AS {k}" for k in names)


def scored(names: list[str] | None = None, longest: int = 18, key: str = KEY) -> str:
    """WITH ... scored: signature x scansion with counts and score."""
    names = names or DEFAULT
    return f"""WITH RECURSIVE {encoded(longest)},{scansions(longest)},
sig AS (SELECT DISTINCT {key} FROM enc),
scored AS (SELECT *, CAST({' + '.join(names)} AS DOUBLE) AS score FROM (
  SELECT sig.*, scan_ord, positions, meter, s, cont, {counts(names)} FROM sig JOIN scan USING (n)))"""


def best(longest: int = 18) -> str:
    """WITH ... best: the best parse of every unit."""
    return scored(None, longest) + f""",
persig AS (SELECT {KEY}, min(score * 100000 + scan_ord) AS code FROM scored GROUP BY ALL),
pick AS (SELECT enc.*, floor(code / 100000) AS score, CAST(code - 100000 * floor(code / 100000) AS INTEGER) AS scan_ord FROM enc JOIN persig USING ({KEY})),
best AS (SELECT p.*, scan.positions, scan.meter, scan.s, scan.cont, scan.big, scan.n_pos, scan.n_strong FROM (
  SELECT *, row_number() OVER (PARTITION BY text_id, line_num, linepart ORDER BY score, variant) AS rn FROM pick) p
  JOIN scan USING (n, scan_ord) WHERE rn = 1)"""


PROPERTIES = """props AS (SELECT *, string_split(positions, '|') AS pa FROM best),
feet AS (SELECT *, CASE WHEN len(pa) = 1 THEN pa ELSE list_transform(range(1, CAST(floor(len(pa) / 2) AS INTEGER) + 1), lambda i: pa[2 * i - 1] || pa[2 * i]) END AS fa FROM props),
nary AS (SELECT *, CAST(floor(list_aggregate(list_transform(fa, lambda f: length(f)), 'median')) AS INTEGER) AS nary_feet FROM feet),
rising AS (SELECT *, CASE WHEN length(meter) >= 4 AND nary_feet = 3 THEN substr(meter, 4, 1) <> 's'
  WHEN length(meter) >= 4 AND nary_feet = 2 THEN substr(meter, 4, 1) = 's' ELSE substr(meter, 1, 1) = 'w' END AS is_rising FROM nary),
typed AS (SELECT *, CASE WHEN nary_feet = 2 AND is_rising THEN 'iambic' WHEN nary_feet = 2 THEN 'trochaic'
  WHEN nary_feet = 3 AND is_rising THEN 'anapestic' WHEN nary_feet = 3 THEN 'dactylic' ELSE '' END AS foot_type FROM rising)"""
