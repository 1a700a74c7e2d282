"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

1. Every text becomes the set of its distinct n-word shingles (hashed to 64
   bits); equal sets collapse to one representative, so exact copies never meet.
2. A set's signature holds 40 minima of 11 bits, five to a 64-bit word. Eight
   words split a signature distance of at most 15 by pigeonhole: some word of
   two such signatures has at most one differing position. Every word is
   enumerated with each of its five positions left out, so all pairs within the
   distance, and many beyond, share one of 40 keys. At a similarity of 0.8 a pair
   shares a key with probability 0.99998 (above 0.8 more); nothing later drops it
   but exact conditions.
3. In each bucket all members are first compared with the smallest one (a star,
   not all pairs), on full sets. Buckets that then still hold several components
   go on: members outside the smallest member's component meet the whole bucket,
   salted into parts of bounded size, under two exact bounds on what the sets can
   share; what remains is compared on full sets. No pair is capped or sampled.
4. Connected components give each document its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, components, dealt, discard, fresh, mixed, salts, shingle_sets, written

WORDS, LANES, LANE_BITS, VALUE_BITS = 8, 5, 12, 11
POSITIONS = WORDS * LANES
#: Sets up to so many representatives are sought by a broadcast of their ids (8 bytes each).
BROADCAST_IDS = 1_000_000
PART = 2_000

_odd = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, POSITIONS), dtype=np.uint64)
_MUL, _ADD = _odd[0] * np.uint64(2) + np.uint64(1), _odd[1]
_SHIFT = (np.arange(LANES, dtype=np.uint64) * np.uint64(LANE_BITS))[None, :]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Eight int64 words of five 11-bit minima for a non-empty set of 64-bit hashes."""
    least = np.full(POSITIONS, np.uint64((1 << 64) - 1))
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096, None] * _MUL + _ADD
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    value = mixed(least) >> np.uint64(64 - VALUE_BITS)
    return (value.reshape(WORDS, LANES) << _SHIFT).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in chunks(texts):
                size, digest, words = [], [], []
                for s in shingle_sets(part, n):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    words.append(signature(s) if len(s) else np.zeros(WORDS, np.int64))
                table = np.array(words, np.int64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), batch.column(2).slice(first, len(part)), pa.array(size, pa.int64()), pa.array(digest, pa.binary())]
                    + [pa.array(table[:, k]) for k in range(WORDS)],
                    names=["doc_id", "text_hash", "n_shingles", "digest", *(f"s{k}" for k in range(WORDS))],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in chunks(texts):
                found = shingle_sets(part, n)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                flat = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["rep", "shingles"],
                )

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text_hash, n_shingles, component_id, kept, n_links).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their
    sets of distinct n-word shingles (see `shingle_sets`). `component_id` is the
    smallest doc_id reachable, `kept` marks the document that carries it, and
    `n_links` counts the links that were confirmed for the document's set (a
    spanning choice within buckets, copies of one set counting as none).
    `text_hash` is the xxhash64 of the row's text.

    Null and empty texts, and those of white space, have an empty set, no link
    and component_id = doc_id. Rows that repeat a doc_id count as one document
    with several texts: each row gets the component of its own text. A null
    doc_id takes no part in links and comes back with a null component and kept
    false. Other columns of `docs` are not read.
    """
    bounded_batches(docs.sparkSession)
    signed = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash(F.col("text")).alias("text_hash")
        ).mapInArrow(
            _signed(n), "doc_id long, text_hash long, n_shingles long, digest binary, " + ", ".join(f"s{k} long" for k in range(WORDS))
        ),
        "signed",
    )
    alike = signed.where("digest is not null and doc_id is not null")
    reps = written(
        alike.groupBy("digest").agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("size"),
            *(F.first(f"s{k}").alias(f"s{k}") for k in range(WORDS)),
        ),
        "reps",
    )
    # Two texts of one doc_id may both be smallest of their sets; `rep` is then shared, which joins them as one document.
    word = F.explode(F.array(*(F.struct(F.lit(k).alias("w"), F.col(f"s{k}").alias("v")) for k in range(WORDS))))
    masks = [~(((1 << LANE_BITS) - 1) << (LANE_BITS * k)) for k in range(LANES)]
    lane = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), F.lit(m).alias("m")) for k, m in enumerate(masks))))
    keyed = (
        reps.select("rep", "size", word.alias("x"))
        .select("rep", "size", "x", lane.alias("y"))
        .select(F.xxhash64("x.w", "y.l", F.col("x.v").bitwiseAND(F.col("y.m"))).alias("key"), "rep", "size")
    )
    buckets = (
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1 and lead is not null")
    )
    members = written(keyed.join(dealt(buckets), "key").select("key", "rep", "size", "lead", "n"), "members")

    star = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    sizes = reps.select("rep", "size").distinct()
    links = _confirmed(_close(star, sizes, percent), texts, n, percent)
    label = components(links.select("a", "b"))

    # Buckets of several components: whoever is not with the smallest member meets the whole bucket.
    placed = members.join(dealt(label.withColumnRenamed("node", "rep")), "rep", "left").withColumn(
        "comp", F.coalesce("component", "rep")
    )
    mixed_buckets = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min(F.struct("rep", "comp")).alias("lead"))
        .where("least <> most")
        .select("key", F.col("lead.comp").alias("main"))
    )
    opened = written(placed.join(dealt(mixed_buckets), "key").select("key", "rep", "size", "comp", "main", "n"), "open")
    discard(members)
    found = _rarest(written(opened.select("rep").distinct(), "ids"), texts, reps, n, percent)
    rarest = found.join(dealt(sizes), "rep").where(F.col("shared") * 100 >= F.col("size") * percent)
    parts = opened.drop("size").join(dealt(rarest), "rep").withColumn("parts", salts(F.col("n"), PART))
    left = parts.where("comp <> main").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    right = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = left.alias("a"), right.alias("b")
    near = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.salt") == F.col("b.salt"))
        & (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep")))
        & ((100 + percent) * F.least("a.shared", "b.shared") >= percent * (F.col("a.size") + F.col("b.size")))
        & _may_share(percent)
    )
    rest = a.join(dealt(b), near).select(
        F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")
    ).distinct()
    more = _confirmed(rest, texts, n, percent)
    all_links = links.unionByName(more)
    discard(opened, found)
    # The components found before are stars, which the further links join.
    known = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = components(known.unionByName(more.select("a", "b")))

    degree = (
        all_links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    )
    of_set = reps.select("digest", "rep")
    out = (
        signed.select("doc_id", "text_hash", "n_shingles", "digest")
        .join(dealt(of_set), "digest", "left")
        .join(dealt(label.withColumnRenamed("node", "rep")), "rep", "left")
        .join(dealt(degree), "rep", "left")
    )
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component", "rep", "doc_id")
    )
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def _close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets' sizes allow the similarity."""
    size = reps.groupBy("rep").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    joined = pairs.join(dealt(size.toDF("a", "la", "ha")), "a").join(dealt(size.toDF("b", "lb", "hb")), "b")
    return joined.where(
        f"100 * least(ha, hb) >= {percent} * greatest(la, lb)"
    ).select("a", "b")


def _of(ids: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(rep, shingles) of the wanted ids, broadcast only while a count finds them few."""
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else dealt(ids), "rep", "left_semi")
    return wanted.mapInArrow(_sets(n), "rep long, shingles array<long>")


def _rarest(ids: DataFrame, texts: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """(rep, shared, rare): how many shingles stand in another of these sets, and the rarest ones.

    A pair that links has at least need = percent / (100 + percent) * (sum of
    sizes) shingles in common, so (1) each has as many that are not its own
    alone, and (2) with the shingles of all sets ordered by rarity, the first
    size - need + 1 of either hold a common one. Both lose no link and settle the
    members of a large group of edited copies without a pair on full sets. Ids
    that stand for several sets are never settled here (rare is null).
    """
    loose = written(_of(ids, texts, n).select("rep", F.explode("shingles").alias("s")).distinct(), "loose")
    often = loose.groupBy("s").agg(F.count("*").alias("df"))
    ranked = (
        loose.join(dealt(often), "s")
        .groupBy("rep")
        .agg(F.count(F.when(F.col("df") > 1, 1)).alias("known"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    )
    size = reps.groupBy("rep").agg(F.max("size").alias("size"), F.count("*").alias("sets"))
    prefix = F.slice("r", F.lit(1), (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int"))
    one = F.col("sets") == 1
    out = ranked.join(dealt(size), "rep").select(
        "rep",
        F.when(one, F.col("known")).otherwise(F.lit(1 << 40)).alias("shared"),
        F.when(one, F.transform(prefix, lambda x: F.hash(x["s"]))).alias("rare"),
    )
    out = written(out, "rare")
    discard(loose)
    return out


def _may_share(percent: int) -> Column:
    """Rows a and b have a common shingle among the rarest that the pair's sizes allow."""
    need = F.ceil((F.col("a.size") + F.col("b.size")) * percent / (100 + percent) - 1e-9)
    first = lambda x: F.slice(f"{x}.rare", F.lit(1), F.greatest(F.lit(1), F.col(f"{x}.size") - need + 1).cast("int"))
    return F.coalesce(F.arrays_overlap(first("a"), first("b")), F.lit(True))


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) pairs of representatives that hold on full sets, written.

    The sets of the documents in question are made once from their texts. Their
    ids are broadcast only while they are few (a count decides); else the texts
    are joined by id. A representative with many partners is dealt into parts.
    """
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
    sets = written(_of(ids, texts, n), "sets")
    partners = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", salts(F.col("n"), 200)).drop("n")
    left = (
        sets.join(dealt(partners), sets.rep == partners.a)
        .select("a", F.col("shingles").alias("left"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    )
    salted = pairs.join(dealt(partners), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = salted.join(dealt(sets.withColumnRenamed("rep", "b")), "b").select("a", "salt", "b", F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    whole = F.size("left") + F.size("right") - both
    held = right.join(dealt(left), ["a", "salt"]).where(both * 100 >= whole * percent).select("a", "b").distinct()
    held = written(held, "links")
    discard(pairs, ids, sets)
    return held


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns as they are, of which one of each group of near duplicates stays.

    Groups are those of `near_duplicates`; the texts of the smallest doc_id of a
    group stay. Each row is judged by its own text: of rows that repeat a doc_id
    and a text one stays, while different texts under one doc_id that are kept
    all stay. Documents with a null doc_id take no part and stay. Columns of any
    name pass through.
    """
    id_, hash_ = fresh("id__", docs), fresh("hash__", docs)
    found = near_duplicates(docs, n, percent).where("doc_id is not null").select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), "kept"
    )
    judged = written(found.groupBy(id_, hash_).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "judged")
    gone = judged.where("not kept").select(id_, hash_)
    many = judged.where("kept and rows > 1").select(id_, hash_)
    key = (F.col("doc_id").cast("long") == F.col(id_)) & (_text_hash(F.col("text")) == F.col(hash_))
    hint = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else dealt(ids)
    left = docs.join(hint(gone), key, "left_anti")
    if not many.take(1):
        return left
    many = hint(many)
    return left.join(many, key, "left_anti").unionByName(left.join(many, key, "left_semi").dropDuplicates(["doc_id", "text"]))
