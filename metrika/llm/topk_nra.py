"""Exact top-k by inner product with no random access (NRA).

Every vector component, floor(scale * x), is one sorted list; a query reads each
list from the end that its own component favours, a step at a time. What has
been read of a vector is summed up; an entry not yet read lies between the
list's far end and the last entry read, which gives the vector a lower and an
upper bound. A vector whose upper bound is below the k-th best lower bound
cannot qualify and is dropped; a query stops its search once no more than k
vectors are left, and goes on reading only to complete the scores of those. No
score is ever computed from a vector by itself.

Queries and vectors are dealt into blocks, and every block of queries meets
every block of vectors once; a block's lists are sorted once for all its
queries. Each pair of blocks keeps at most k rows a query, and the k best of
those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_codes import floors

QUERY_BLOCK, VECTOR_BLOCK = 2_048, 8_192
#: Entries of each list that the first step reads, and how many times as deep every later step goes.
FIRST_STEP, FACTOR = 64, 4
#: Inner products below this are exact as sums of doubles, those below WHOLE (and four times as much) in 64-bit integers.
EXACT, WHOLE = 1 << 53, 1 << 61
_NINES = str.maketrans("0123456789", "9876543210")


class Lists:
    """The sorted lists of a block of vectors, one for each component, ascending, of float64, int64 or Python integers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        columns, self.ids = np.ascontiguousarray(vectors[order].T), ids[order]
        self.rows = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.rows, axis=1)
        self.place = np.empty(self.rows.shape, np.int16 if len(ids) < 1 << 15 else np.int32)
        np.put_along_axis(self.place, self.rows, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)

    def read(self, rising: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries start..end of all lists, (row, value): of `rising` ones from their high end, of others from the low."""
        n = len(self.ids)
        row, value = self.rows[:, start:end].copy(), self.values[:, start:end].copy()
        row[rising] = self.rows[rising, n - end : n - start][:, ::-1]
        value[rising] = self.values[rising, n - end : n - start][:, ::-1]
        return row, value

    def places(self, rising: np.ndarray) -> np.ndarray:
        """How many entries come before each vector's own in every list; an entry has been read if they are fewer than the depth."""
        out = self.place.copy()
        out[rising] = len(self.ids) - 1 - out[rising]
        return out


def search(query: np.ndarray, own: int, lists: Lists, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, entries read): the k best vectors of the block for one query, but those with its own id.

    Sums are exact: doubles hold integers below EXACT (see `lanes`), and the
    other kinds of numbers are integers themselves.
    """
    n, width, kind = len(lists.ids), len(query), lists.values.dtype
    rising, factor = (query > 0).astype(bool), query.astype(kind)[:, None]
    open_ = np.flatnonzero(lists.ids != own)
    score, place = np.zeros(n, kind), lists.places(rising)

    def add(row: np.ndarray, products: np.ndarray) -> None:
        nonlocal score
        if kind == np.float64:
            score += np.bincount(row, weights=products, minlength=n)
        else:
            np.add.at(score, row, products)

    far = (lists.read(rising, n - 1, n)[1] * factor)[:, 0]
    at = 0
    while at < n:
        depth = min(n, max(FIRST_STEP, FACTOR * at))
        row, value = lists.read(rising, at, depth)
        value *= factor
        add(row.ravel(), value.ravel())
        at = depth
        if depth == n:
            break
        edge = value[:, -1]
        # What the unread entries can add at least and at most; for doubles less and more by what single precision may be off.
        ends = np.stack((far, edge))
        if kind == np.float64:
            part = ends.astype(np.float32) @ (place < depth).astype(np.float32)
            slack = np.abs(ends).sum() * (width + 2) * 1e-7
        else:
            part, slack = ends @ (place < depth).astype(kind), 0
        lower = score[open_] + (far.sum() - slack - part[0, open_])
        upper = score[open_] + (edge.sum() + slack - part[1, open_])
        if len(open_) > k:
            bar = np.partition(lower, len(open_) - k)[len(open_) - k]
            open_ = open_[(upper >= bar).astype(bool)]
        if len(open_) <= k:
            break
    # Resolve: read on, for the vectors that are left alone, until each of their entries has been met.
    while at < n and (place[:, open_] >= at).any():
        depth = min(n, FACTOR * at)
        row, value = lists.read(rising, at, depth)
        left = np.zeros(n, bool)
        left[open_] = True
        where, entry = np.nonzero(left[row])
        add(row[where, entry], value[where, entry] * factor[where, 0])
        at = depth
    if kind == object:
        best = np.array(sorted(open_, key=lambda r: (-score[r], lists.ids[r]))[:k], np.int64)
        return best, score[best], at * width
    best = open_[np.lexsort((lists.ids[open_], -score[open_]))][:k]
    return best, score[best].astype(np.int64), at * width


def lanes(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer matrices as the cheapest kind of number that keeps all sums of their inner products exact."""
    most = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    bound = most(queries) * most(vectors) * queries.shape[1]
    kind = np.float64 if bound < EXACT else np.int64 if bound < WHOLE else object
    return queries.astype(kind), vectors.astype(kind)


def sortable(x: int) -> str:
    """A text that sorts among such texts as the integer does among integers."""
    digits = str(abs(x))
    return f"p{len(digits):04d}{digits}" if x >= 0 else f"n{9999 - len(digits):04d}{digits.translate(_NINES)}"


def answers(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query id, vector id, score, entries read by the query) for the k best vectors of every query."""
    queries, vectors = lanes(queries, vectors)
    lists = Lists(vectors, ids)
    for q, own in zip(queries, query_ids.tolist(), strict=True):
        best, scores, read = search(q, own, lists, k)
        for v, s in zip(lists.ids[best].tolist(), scores.tolist(), strict=True):
            yield own, v, s, read


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, reads: bool = False) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) for queries with vec_id divisible by `every`.

    With `reads`, n_read is the number of list entries that the query has read in
    the block of the vector.

    Vectors that are null or empty, or hold a null or non-finite component, and
    null ids, take no part. Vectors of different lengths have no inner product
    and never meet. Equal scores rank by the smaller vec_id; rows that repeat a
    vec_id with equal vectors count as one row; rows of one vec_id with
    different vectors never answer each other, each counts for other queries,
    and as queries they share their k answers. Components of any size are exact
    integers: rows whose inner products might reach 2**53 meet in groups of
    their own, by 64-bit or longer integers. A score that a long can't hold is
    null; it has its rank all the same. No rows, or none that take part, give an
    empty table. Other columns are not read.
    """
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    size = F.array_max(F.transform(value, lambda v: F.abs(v))) * F.lit(float(scale)) + 1
    large = F.size(value) * size * size >= F.lit(float(EXACT))
    whole = F.transform(value, lambda v: F.floor(v * scale).cast("double"))
    rows = (
        vectors.where(F.col("vec_id").isNotNull() & value.isNotNull() & sound & (F.size(value) > 0))
        # Large components stay as they are: they may be beyond a long after scaling.
        .select(F.col("vec_id").cast("long").alias("vec_id"), large.alias("large"), F.when(large, value).otherwise(whole).alias("v"))
        .distinct()
    )
    rows = written(rows.withColumn("dims", F.size("v")), "vectors")
    n, any_large = rows.agg(F.count("*"), F.coalesce(F.bool_or("large"), F.lit(False))).first()
    kinds = F.array(*map(F.lit, [False, True][: 1 + any_large]))
    data_blocks = max(1, -(-n // VECTOR_BLOCK))
    query_blocks = max(1, -(-(n // every + 1) // QUERY_BLOCK))
    cell = lambda c, many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int").alias(c)
    blocks = lambda c, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(c)
    data = rows.select("vec_id", "v", "dims", F.col("large").alias("of"), cell("d", data_blocks), blocks("q", query_blocks))
    data = data.withColumn("by", F.explode(kinds))
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.select("vec_id", "v", "dims", F.col("large").alias("by"), cell("q", query_blocks), blocks("d", data_blocks))
    asked = asked.withColumn("of", F.explode(kinds))

    columns = ["query_id", "vec_id", "score", *["n_read"] * reads]

    def integers(side: pd.DataFrame, is_large: bool) -> np.ndarray:
        values = np.array(side.v.tolist(), np.float64)
        return floors(values, scale) if is_large else values.astype(np.int64)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns}).astype("int64").assign(**{"order": pd.Series([], dtype=str)} if any_large else {})
        found = answers(
            integers(left, left.by.iloc[0]), left.vec_id.to_numpy(), integers(right, right.of.iloc[0]), right.vec_id.to_numpy(), k
        )
        out = pd.DataFrame([f[: len(columns)] for f in found], columns=columns, dtype=object)
        if any_large:
            out["order"] = out.score.map(sortable)
            out["score"] = out.score.map(lambda x: x if -(1 << 63) <= x < 1 << 63 else None)
        return out.astype({c: "Int64" for c in columns})

    found = ", ".join([*(f"{c} long" for c in columns), *["order string"] * any_large])
    group = ["d", "q", "dims", "of", "by"]
    best = asked.groupBy(group).cogroup(data.groupBy(group)).applyInPandas(run, found)
    key = "order" if any_large else "score"
    order = Window.partitionBy("query_id").orderBy(F.desc(key), "vec_id")
    return (
        # Queries that share an id may both have found a vector.
        best.dropDuplicates(["query_id", "vec_id", key])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", *["n_read"] * reads)
    )
