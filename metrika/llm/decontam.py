"""Benchmark decontamination with DataFrame functions only.

A document's windows are as long as a benchmark item. Windows and items get
64-bit SimHash fingerprints over their word shingles; eight 8-bit blocks with up
to two differing bits each (the item side is enumerated, 37 values a block)
find, by pigeonhole, every fingerprint within 23 bits among items of the same
size, and exact weighted-shingle (bag Jaccard) similarity decides.

Fingerprints are only made for windows that can still reach the threshold: a
window of L shingles with similarity t to an item of m needs t(m+L)/(1+t) of its
shingles in the item, and may be taken to begin at one of them, since moving it
there keeps what is shared and drops what is not. That is a lossless filter, not
a sample: every window that could be a hit is fingerprinted.

Items of over LONG shingles, which would overrun the fingerprint's 16-bit
counters, stay whole and need no fingerprint: what each window shares with them
is counted exactly, at a cost in proportion to their matches (`_long_hits`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, fresh, written

RADIUS, BLOCKS = 23, 8
#: Tables up to so many rows and bytes are broadcast after a measurement; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
LANE = 0x0001000100010001
#: Items of more shingles are counted exactly; a fingerprint's counter holds 32,767.
LONG = 30_000


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-word shingles in order; fewer words give one shingle, none an empty array."""

    def made(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        none = F.array().cast("array<long>")
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)

    return let(words, made)


def lanes(shingles: Column) -> Column:
    """Sixteen longs of four 16-bit counters: how many shingles have each hash bit set."""
    zero = F.lit(0).cast("long")
    add = lambda k: lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(LANE))
    return let(
        shingles, lambda s: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(s, zero, add(k)))
    )


def fingerprint(lane: Column, size: Column) -> Column:
    """Bit i is set if more than half of the shingles have it set."""

    def bit(found: Column):
        def added(acc: Column, i: Column) -> Column:
            block = F.element_at(found, (i % 16 + 1).cast("int"))
            count = F.call_function("shiftright", block, (F.floor(i / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))
            one = F.call_function("shiftleft", F.lit(1).cast("long"), i)
            return acc.bitwiseOR(F.when(count * 2 > size, one).otherwise(F.lit(0).cast("long")))

        return added

    return let(lane, lambda found: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit(found)))


def bag(shingles: Column) -> Column:
    """Distinct (shingle, occurrence) hashes: set operations on them count multiplicities."""
    seen = lambda s, h, i: F.size(F.filter(F.slice(s, F.lit(1), i + 1), lambda y: y == h))
    return let(shingles, lambda s: F.transform(s, lambda h, i: F.xxhash64(h, seen(s, h, i))))


def _blocks(fp: Column) -> Column:
    return F.array(
        *(
            F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255)).cast("int").alias("value"))
            for b in range(BLOCKS)
        )
    )


def _within(errors: int) -> list[int]:
    return [x for x in range(256) if x.bit_count() <= errors]


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if broadcastable(df, BROADCAST_ROWS, BROADCAST_BYTES) else df


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> one row per document text and item found in it.

    Columns: doc_id, text_hash (xxhash64 of the text), item_id, similarity (bag
    Jaccard over n-word shingles of the best window), window_start (its first
    word, from 0), window_shingles.

    Null, empty and word-less texts and items match nothing; an item or document
    of fewer than n words is one shingle. Equal items count as the smallest
    item_id. Repeated documents give one row.
    """
    text = F.col("text").cast("string")
    sized = (
        benchmark.where("text is not null")
        .groupBy(text.alias("text"))
        .agg(F.min("item_id").alias("item_id"))
        .select("item_id", shingle_hashes(word_array(F.col("text")), n).alias("shingles"))
        .where("size(shingles) > 0")
        .withColumn("m", F.size("shingles"))
    )
    sized = written(sized, "sized")
    items = sized.where(F.col("m") <= LONG).select(
        "item_id", "shingles", "m", lanes(F.col("shingles")).alias("lane"), bag(F.col("shingles")).alias("bag")
    )
    items = written(items, "items")
    items = items.withColumn("fp", fingerprint(F.col("lane"), F.col("m"))).drop("lane")
    vocabulary = items.select(F.explode("shingles").alias("s"), "item_id", "m").distinct()

    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = texts.select("doc_id", "text_hash", shingle_hashes(word_array(F.col("text")), n).alias("sh"))
    found = own.select("doc_id", "text_hash", F.size("sh").alias("size"), F.posexplode("sh").alias("pos", "s"))
    matched = found.join(_hint(vocabulary), "s").select("doc_id", "text_hash", "size", "item_id", "m", "pos")
    run = matched.groupBy("doc_id", "text_hash", "size", "item_id", "m").agg(
        F.array_sort(F.collect_set("pos")).alias("p")
    )
    length = lambda i: F.least(F.col("m"), F.col("size") - F.element_at("p", i))
    need = lambda i: F.ceil((F.col("m") + length(i)) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    starts = F.filter(
        F.sequence(F.lit(1), F.size("p")),
        lambda i: (i + need(i) - 1 <= F.size("p"))
        & (F.element_at("p", F.least(i + need(i) - 1, F.size("p"))) < F.element_at("p", i) + F.col("m")),
    )
    windows = written(
        run.select("doc_id", "text_hash", "size", "m", "p", F.explode(starts).alias("i"))
        .select("doc_id", "text_hash", "m", F.element_at("p", F.col("i")).alias("start"), length(F.col("i")).alias("len"))
        .distinct(),
        "windows",
    )
    per_doc = windows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("m", "start", "len")).alias("w"))
    per_doc = written(per_doc, "per_doc")
    key = texts["doc_id"].eqNullSafe(per_doc["doc_id"]) & (texts["text_hash"] == per_doc["text_hash"])
    cut = (
        texts.join(_hint(per_doc), key)
        .select(texts["doc_id"], texts["text_hash"], shingle_hashes(word_array(texts["text"]), n).alias("sh"), "w")
        .select("doc_id", "text_hash", "sh", F.explode("w").alias("w"))
        .select("doc_id", "text_hash", "w.m", "w.start", "w.len", F.slice("sh", F.col("w.start") + 1, F.col("w.len")).alias("sh"))
    )
    cut = written(cut.withColumn("lane", lanes(F.col("sh"))).withColumn("bag", bag(F.col("sh"))).drop("sh"), "cut")
    prints = cut.withColumn("fp", fingerprint(F.col("lane"), F.col("len"))).drop("lane")

    errors = F.array(*(F.lit(x) for x in _within(RADIUS // BLOCKS)))
    keys = (
        items.select("item_id", "fp", "m", "bag", F.explode(_blocks(F.col("fp"))).alias("b"))
        .select("item_id", "fp", "m", "bag", "b.block", "b.value", F.explode(errors).alias("e"))
        .select("item_id", F.col("fp").alias("item_fp"), "m", "block", F.col("value").bitwiseXOR(F.col("e")).alias("value"))
    )
    near = (
        prints.select("doc_id", "text_hash", "m", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("b"))
        .select("doc_id", "text_hash", "m", "start", "fp", "b.block", "b.value")
        .join(_hint(keys), ["m", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select("doc_id", "text_hash", "m", "start", "item_id", "item_fp")
        .distinct()
    )
    same = near.alias("n").join(
        prints.alias("p"),
        F.col("n.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("n.text_hash") == F.col("p.text_hash"))
        & (F.col("n.m") == F.col("p.m"))
        & (F.col("n.start") == F.col("p.start")),
    ).select("n.doc_id", "n.text_hash", "n.item_id", "n.m", "n.item_fp", "p.start", "p.len", F.col("p.bag").alias("own_bag"))
    checked = same.join(
        _hint(items.select("item_id", "m", F.col("fp").alias("item_fp"), "bag")), ["item_id", "m", "item_fp"]
    )
    both = F.size(F.array_intersect("own_bag", "bag"))
    sim = both / (F.col("len") + F.col("m") - both)
    judged = checked.select("doc_id", "text_hash", "item_id", "start", "len", sim.alias("similarity"))
    long = sized.where(F.col("m") > LONG)
    if long.take(1):
        judged = judged.unionByName(_long_hits(found, long))
    return (
        judged
        .where(F.col("similarity") >= threshold)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "len")).alias("best"))
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.back")).alias("window_start"),
            F.col("best.len").alias("window_shingles"),
        )
    )


def _long_hits(found: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, start, len, similarity) of the windows that begin at a shingle of a long item.

    found: doc_id, text_hash, size, pos, s of every shingle; items: item_id,
    shingles, m. A shingle that the item has c times counts in the windows it is
    among the first c of: those that begin after the occurrence c places before
    it, and less than m before it. Each occurrence adds one where these begin and
    takes one off behind itself; a running sum gives what every window shares.
    """
    wanted = items.select("item_id", "m", F.explode("shingles").alias("s")).groupBy("item_id", "m", "s").agg(
        F.count("*").cast("int").alias("c")
    )
    key = ["doc_id", "text_hash", "item_id", "size", "m"]
    places = (
        found.join(_hint(written(wanted, "wanted")), "s")
        .groupBy(*key, "s", "c")
        .agg(F.array_sort(F.collect_set("pos")).alias("p"))
    )

    def steps(q: Column, j: Column) -> Column:
        before = F.when(j >= F.col("c"), F.get("p", j - F.col("c"))).otherwise(F.lit(-1))
        begin = F.greatest(before, q - F.col("m")) + 1
        event = lambda at, add, here: F.struct(at.alias("start"), F.lit(add).alias("add"), F.lit(here).alias("here"))
        return F.array(event(F.greatest(begin, F.lit(0)), 1, 0), event(q + 1, -1, 0), event(q, 0, 1))

    events = places.select(*key, F.explode(F.flatten(F.transform("p", steps))).alias("e")).groupBy(*key, "e.start").agg(
        F.sum("e.add").alias("add"), F.max("e.here").alias("here")
    )
    running = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    length = F.least(F.col("m"), F.col("size") - F.col("start"))
    windows = events.withColumn("both", F.sum("add").over(running)).where("here = 1").withColumn("len", length)
    return windows.select(
        "doc_id", "text_hash", "item_id", "start", "len", (F.col("both") / (F.col("len") + F.col("m") - F.col("both"))).alias("similarity")
    )


def flagged(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id (of the best hit, ties to the smallest), similarity."""
    found = hits(docs, benchmark, n, threshold)
    best = written(
        found.groupBy("doc_id", "text_hash").agg(
            F.count("*").alias("n_items"), F.max(F.struct("similarity", (-F.col("item_id")).alias("back"))).alias("best")
        ),
        "hits",
    )
    own = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    key = own["doc_id"].eqNullSafe(best["doc_id"]) & (own["text_hash"] == best["text_hash"])
    return own.join(_hint(best), key, "left").select(
        own["doc_id"],
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("best.back")).alias("item_id"),
        F.col("best.similarity").alias("similarity"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents, with their columns as they are, that hold no benchmark item.

    Null, empty and word-less texts hold none and stay, repeated rows stay or go
    together, and columns of any name pass through. An empty benchmark keeps all.
    """
    id_, hash_ = fresh("hit_doc_id__", docs), fresh("hit_text_hash__", docs)
    found = written(hits(docs, benchmark, n, threshold).select("doc_id", "text_hash").distinct().toDF(id_, hash_), "hits")
    found = _hint(found)
    key = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_))
    return docs.join(found, key, "left_anti")
