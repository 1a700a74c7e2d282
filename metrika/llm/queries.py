"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_tools, decontam, embedding_dedup, langid, minhash, pii, quality, sentencepiece_trie, sharding, spelling, topk_nra, toxicity, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The key of PII surrogates: the setting spark.metrika.pii.key, or one that only suits test tables."""
    return spark.conf.get("spark.metrika.pii.key", "not secret: for test tables")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside the held-out fold."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool calls read out of all conversations, linked, ordered, validated and serialised."""
    linked = chat_tools.link_tool_calls(*chat_tools.calls_of_conversations(_table(spark, sf_dir, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every 50th vector."""
    return topk_nra.top_k(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return sharding.sharded(_table(spark, sf_dir, "documents"), 40)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, similarity of 0.8 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=80).drop("n_links", "text_hash")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets: doc_id, text, n_mentions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogated(docs, surrogate_key(spark), counts=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item it holds, if any."""
    return decontam.flagged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces as a count and a digest, and whether decoding gives the text back."""
    encoded = sentencepiece_trie.encode(_table(spark, sf_dir, "documents"), check=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "exact"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of all documents."""
    return quality.rated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned outside the held-out fold."""
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors by cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with the more frequent spellings next to them."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector in 16 parts of 64 entries."""
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_tool_calls": op2_tool_calls,
    "op3_topk": op3_topk,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_spelling": op12_spelling,
    "op13_vector_codes": op13_vector_codes,
}

def _assigned(k: int) -> str:
    """SQL: every part with the nearest entry of codebooks b<k> and its squared distance."""
    far = "list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))"
    return f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, any_value(x.c) AS c, min({{'d': CAST({far} AS BIGINT), 'e': b.e}}) AS m FROM part x JOIN b{k} b USING (p) GROUP BY x.vec_id, x.label, x.p)"


def _moved(k: int) -> str:
    """SQL: codebooks b<k>, the entries of the round before moved to the floors of their parts' means."""
    return f"""u{k} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM (SELECT p, m.e AS e, unnest(c) AS x, unnest(range(0, len(c))) AS i FROM a{k - 1}) GROUP BY p, e, i) GROUP BY p, e),
b{k} AS (SELECT b.p, b.e, COALESCE(u{k}.c, b.c) AS c FROM b{k - 1} b LEFT JOIN u{k} ON u{k}.p = b.p AND u{k}.e = b.e)"""


ORACLES: dict[str, str] = {
    "op2_tool_calls": """
WITH t AS (SELECT conv_id, turn, role, text, COALESCE(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, said, 'c' || conv_id || '-' || turn AS call_id, CASE WHEN length(said) < 200 THEN 'brief' ELSE 'reply' END AS tool,
  length(said) AS chars, len(string_split(said, chr(10))) AS lines, count(*) OVER (PARTITION BY conv_id, turn) AS copies,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(text) AS output FROM t WHERE role = 'user' AND turn > 0 GROUP BY ALL),
known AS (SELECT DISTINCT conv_id, turn + 2 AS turn, 1 AS yes FROM t WHERE role = 'assistant'),
j AS (SELECT c.*, COALESCE(n_results, 0) AS n_results, output, yes FROM c LEFT JOIN r USING (conv_id, turn) LEFT JOIN known USING (conv_id, turn))
SELECT conv_id, call_id, turn AS seq, CAST(position AS BIGINT) AS position, CAST(n_results AS BIGINT) AS n_results,
  CASE WHEN copies > 1 THEN 'duplicate' WHEN n_results = 0 THEN 'missing' WHEN n_results > 1 THEN 'ambiguous' ELSE 'linked' END AS link,
  array_to_string(list_filter([CASE WHEN turn >= 3 AND yes IS NULL THEN 'depends_on: unknown c' || conv_id || '-' || (turn - 2) END, CASE WHEN lines > 20 THEN 'lines: out of bounds' END,
    CASE WHEN chars < 1 THEN 'n_chars: out of bounds' END, CASE WHEN chars < 1 THEN 'text: out of bounds' END], lambda x: x IS NOT NULL), '; ') AS errors,
  '{"arguments":{"at":{"conv":' || conv_id || ',"turn":' || turn || '},"lines":' || lines || ',"n_chars":' || chars || ',"text":' || CAST(to_json(said) AS VARCHAR)
    || '},"id":"' || call_id || '","position":' || position || ',"result":' || COALESCE(CAST(to_json(output) AS VARCHAR), 'null') || ',"tool":"' || tool || '"}' AS json
FROM j""",
    "op3_topk": """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_minhash": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(a) >= 4 THEN list_transform(range(1, len(a) - 2), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3])
      WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS s FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
side AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT x, x FROM side UNION SELECT r.x, s.y FROM reach r JOIN side s ON r.y = s.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, COALESCE(size.n, 0) AS n_shingles, COALESCE(component_id, d.doc_id) AS component_id, COALESCE(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.x = d.doc_id""",
    "op7_decontamination": """
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL),
iw AS (SELECT min(item_id) AS item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS a FROM benchmark WHERE text IS NOT NULL GROUP BY text),
dl AS (SELECT doc_id, CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END AS l FROM dw),
il AS (SELECT item_id, CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END AS l FROM iw),
ds AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM dl),
ish AS (SELECT item_id, m, s, count(*) AS n FROM (SELECT item_id, len(l) AS m, unnest(l) AS s FROM il) GROUP BY ALL),
start AS (SELECT DISTINCT doc_id, item_id, m, pos FROM ds JOIN ish USING (s)),
win AS (SELECT t.doc_id, t.item_id, t.m, t.pos, d.s, count(*) AS n FROM start t JOIN ds d ON d.doc_id = t.doc_id AND d.pos >= t.pos AND d.pos < t.pos + t.m GROUP BY ALL),
bag AS (SELECT w.doc_id, w.item_id, w.m, w.pos, sum(w.n) AS len, sum(least(w.n, COALESCE(i.n, 0))) AS both_n
  FROM win w LEFT JOIN ish i ON i.item_id = w.item_id AND i.s = w.s GROUP BY ALL),
hit AS (SELECT doc_id, item_id, round(max(both_n / CAST(len + m - both_n AS DOUBLE)), 6) AS similarity FROM bag WHERE both_n / CAST(len + m - both_n AS DOUBLE) >= 0.8 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS n_items FROM hit)
SELECT d.doc_id, r.doc_id IS NOT NULL AS contaminated, COALESCE(r.n_items, 0) AS n_items, r.item_id, r.similarity FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.rn = 1""",
    "op11_embedding_dedup": """
WITH RECURSIVE s AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT x, x FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, COALESCE(n, 0) AS n_links, COALESCE(component_id, e.vec_id) AS component_id, COALESCE(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON least.x = e.vec_id LEFT JOIN degree ON degree.x = e.vec_id""",
    "op13_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS c FROM (SELECT *, unnest(range(0, 16)) AS p FROM kept)),
b0 AS (SELECT p, e, c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_assigned(0)}, {_moved(1)}, {_assigned(1)}, {_moved(2)}, {_assigned(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book""",
}
