"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group with a demand of bytes, tokens and rows. Groups are
placed largest first, each where the dot product of its demand with the shards'
residual capacity is highest. A group stays whole, but for one above a quarter
of a shard, which is dealt by a hash of the doc_id into just enough pieces.

Groups of (nearly) equal demand form a class, and a class is placed in one step:
placing a group lowers a shard's dot product by the same amount each time, so
that what greedy placement one by one would do is known in closed form (shards
are filled from the highest dot product down to one level). The driver sees
classes, not groups: pieces and groups above a 400th of a shard are classes of
their own, the rest falls into cells of a logarithmic grid, so their number is
bounded by the parameters and the logarithms of the sizes. Within its class a
group's number tells its shard. Numbers and slots are counted in salted parts
that are offset by running sums, so no window sees a whole class or shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The share of a shard above which a group is a class of its own; the share that a piece has
#: at most, so that only larger groups are split.
LARGE, WHOLE = 1 / 400, 1 / 4
#: Cells of the grid for each doubling of bytes, tokens and rows.
CELLS = (4, 1, 1)
OVERHEAD = 16
#: Rows that a salted part has about, and the parts that a class or shard is dealt into at most.
PART, PARTS = 1_000, 4_096


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, group, size, tokens, text_crc32) of every row; the group is a digest of the text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.xxhash64(text, F.crc32(text), F.octet_length(text)), F.lit(0).cast("long")).alias("group"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
    )


def spread(value: np.ndarray, loss: float, most: np.ndarray, count: int) -> np.ndarray:
    """How many of `count` equal items each bin gets if each goes where `value` is highest.

    Every item lowers its bin's value by `loss`; a bin takes at most `most`;
    ties go to the smaller bin. At most sum(most) items are placed.
    """
    count = int(min(count, most.sum()))
    got = np.zeros(len(value), np.int64)
    if count <= 0:
        return got
    if loss <= 0:
        for k in np.argsort(-value, kind="stable"):
            got[k] = min(int(most[k]), count - int(got.sum()))
        return got
    # The level down to which bins are filled, to within one item a bin; the last items go one by one.
    low, high = float(value.min() - loss * (count + 1)), float(value.max())
    for _ in range(200):
        level = (low + high) / 2
        filled = np.minimum(most, np.maximum(0, np.floor((value - level) / loss)).astype(np.int64))
        if filled.sum() <= count:
            high, got = level, filled
        else:
            low = level
        if high - low < loss / 4:
            break
    for _ in range(count - int(got.sum())):
        at = int(np.argmax(np.where(got < most, value - got * loss, -np.inf)))
        got[at] += 1
    return got


def pack(demand: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """(classes, shards): how many items of each class go to each shard.

    `demand` is that of one item of a class, `counts` its items. Classes come
    largest first. Each item goes where the dot product with what capacity is
    left is highest, ties to the smaller shard. Capacity is an equal share of
    the total in every dimension; a shard that an item would overfill in bytes is
    taken only if all are, and then the one with the most bytes left.
    """
    total = np.maximum((demand * counts[:, None]).sum(axis=0), 1e-12)
    need = demand / total * shards
    left = np.ones((shards, demand.shape[1]))
    out = np.zeros((len(demand), shards), np.int64)
    for k in np.lexsort((np.arange(len(demand)), -need.max(axis=1))):
        one = need[k]
        room = np.floor(np.maximum(left[:, 0], 0) / max(one[0], 1e-300) + 1e-9).astype(np.int64)
        got = spread(left @ one, float(one @ one), np.minimum(room, counts[k]), counts[k])
        rest = int(counts[k] - got.sum())
        if rest:
            got += spread(left[:, 0] - got * one[0], float(one[0]), np.full(shards, rest, np.int64), rest)
        out[k] = got
        left -= got[:, None] * one[None, :]
    return out


def numbered(rows: DataFrame, key: str, salt: Column, order: list[str], name: str) -> DataFrame:
    """Adds the position (from 0) of each row among those of its key; positions run through the salted parts in turn."""
    dealt = rows.withColumn("part__", salt)
    sizes = dealt.groupBy(key, "part__").agg(F.count("*").alias("n__"))
    before = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    inside = Window.partitionBy(key, "part__").orderBy(*order)
    out = dealt.withColumn("at__", F.row_number().over(inside)).join(offsets, [key, "part__"])
    return out.withColumn(name, (F.col("before__") + F.col("at__") - 1).cast("long")).drop("part__", "before__", "at__")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`.

    size is the text's UTF-8 bytes plus 16. A null text has no bytes and no
    crc32, an empty one crc32 0; null texts form one group, repeated rows belong
    to their text's. Slots run from 0 without a gap in each shard. Fewer rows
    than shards leave some shards empty; no rows give an empty table. Columns
    other than doc_id and text are not read. grown_shard is null, since the law
    is not `key`.
    """
    spark = docs.sparkSession
    rows = written(measured(docs), "rows")
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    whole = rows.agg(*sums).first()
    share = [max(1.0, (whole[k] or 0) / shards) for k in ("b", "t", "r")]
    size = F.greatest(*(F.col(k) / s for k, s in zip("btr", share, strict=True)))
    groups = written(rows.groupBy("group").agg(*sums).withColumn("of_shard", size), "groups")

    # At most 3 * shards / LARGE groups can exceed the share in some dimension.
    large = groups.where(F.col("of_shard") > LARGE).select("group", F.ceil(F.col("of_shard") / WHOLE).cast("int").alias("parts"))
    large = F.broadcast(written(large, "large"))
    piece = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("int").alias("piece")
    in_pieces = rows.join(large, "group").select("group", piece, "size", "tokens").groupBy("group", "piece").agg(*sums)
    pieces = in_pieces.orderBy("group", "piece").collect()  # at most (3 / LARGE + 3 / WHOLE) * shards

    cell = [F.floor(F.log2(F.col(k) + 1) * per).cast("int").alias(f"c{k}") for k, per in zip("btr", CELLS, strict=True)]
    small = groups.where(F.col("of_shard") <= LARGE).select("group", F.xxhash64(*cell).alias("class"), "b", "t", "r")
    classes = (
        small.groupBy("class").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in "btr")).orderBy("class").collect()
    )  # one row for each cell of the grid that has a group

    counts = np.array([1] * len(pieces) + [c.n for c in classes], np.int64)
    demand = np.array([[x.b, x.t, x.r] for x in [*pieces, *classes]], float).reshape(-1, 3) / np.maximum(counts, 1)[:, None]
    where = pack(demand, counts, shards)

    of_piece = [(p.group, p.piece, int(w.argmax())) for p, w in zip(pieces, where[: len(pieces)], strict=True)]
    of_piece = spark.createDataFrame(of_piece, "group long, piece int, shard int")
    of_class = []
    for c, w in zip(classes, where[len(pieces) :], strict=True):
        ends = np.cumsum(w)
        of_class += [(c["class"], s, int(ends[s] - w[s]), int(ends[s])) for s in range(shards) if w[s]]
    of_class = spark.createDataFrame(of_class, "class long, shard int, low long, high long")

    many = max(1, min(PARTS, (whole["r"] or 0) // PART))
    salt = F.pmod(F.xxhash64("group", F.lit(3)), F.lit(many)).cast("int")
    at = numbered(small.select("group", "class"), "class", salt, ["group"], "at")
    inside = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    of_small = at.join(F.broadcast(of_class), "class").where(inside).select("group", "shard")
    of_small = written(of_small, "placed")

    keep = ["doc_id", "size", "text_crc32", "shard"]
    hot = rows.join(large, "group").withColumn("piece", piece).join(F.broadcast(of_piece), ["group", "piece"]).select(keep)
    rest = rows.join(large, "group", "left_anti").join(of_small, "group").select(keep)
    salt = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(many)).cast("int")
    out = numbered(hot.unionByName(rest), "shard", salt, ["doc_id", "size", "text_crc32"], "slot")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
