"""Vector code compression: product codes whose nearest entries are found by equal-average search.

A vector of integers is cut into equal consecutive parts, and each part is coded
by the nearest entry of its position's codebook. The entries of a codebook are
sorted by the sum of their components; a part begins at the entry whose sum is
next to its own and goes outward on both sides, always to the smaller gap. By
Cauchy-Schwarz a squared distance is at least gap**2 / width, so the search ends
when that strictly exceeds the best distance found: ties are still met, and the
lower index wins them.

Codebooks begin with the parts of the first vectors and are moved for a fixed
number of rounds. Only codebooks (entries x components) pass through the driver;
a round is one scan, whose tasks return sums and counts by entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components up to this go through 64-bit integers, larger ones through Python's integers of any size.
SAFE = 1 << 22
#: Labels of at least one row in so many are joined by broadcast (there are no more of them than this), the others by a shuffle.
HEAVY = 256


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exact: int64 while all are small, else Python integers."""
    if not values.size or np.abs(values).max() * scale <= SAFE:
        return np.floor(values * scale).astype(np.int64)
    # A double beyond 2**53 is an integer itself.
    whole = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each part, and how many entries were compared in all."""
    n, width = parts.shape
    own, sums = parts.sum(axis=1), book.sum(axis=1)
    order = np.array(sorted(range(len(book)), key=lambda e: (sums[e], e)))
    sums = sums[order]
    high = np.searchsorted(sums, own)
    low = high - 1
    entry = np.full(n, len(book))
    best = np.zeros(n, parts.dtype)
    open_, seen = np.arange(n), 0
    while len(open_):
        lo, hi, s = low[open_], high[open_], own[open_]
        below, above = s - sums[np.maximum(lo, 0)], sums[np.minimum(hi, len(book) - 1)] - s
        down = (lo >= 0) & ((hi >= len(book)) | (below <= above))
        gap = np.where(down, below, above)
        met = entry[open_] < len(book)
        go = ((lo >= 0) | (hi < len(book))) & ~(met & (gap * gap > best[open_] * width).astype(bool))
        open_, down, at = open_[go], down[go], np.where(down, lo, hi)[go]
        if not len(open_):
            break
        seen += len(open_)
        tried = order[at]
        far = ((parts[open_] - book[tried]) ** 2).sum(axis=1)
        fresh = entry[open_] == len(book)
        closer = fresh | (far < best[open_]).astype(bool) | ((far == best[open_]).astype(bool) & (tried < entry[open_]))
        best[open_[closer]], entry[open_[closer]] = far[closer], tried[closer]
        low[open_[down]] -= 1
        high[open_[~down]] += 1
    return entry, best, seen


def _same_kind(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or both as Python's if either is or squares might not fit."""
    if parts.dtype == object or book.dtype == object or parts.shape[1] > 256:
        return parts.astype(object), book.astype(object)
    return parts, book


def _rows(column: pa.Array, width: int, scale: int) -> np.ndarray:
    return floors(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _parts(values: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = values.shape[1] // len(books)
    for p, book in enumerate(books):
        yield _same_kind(values[:, p * size : (p + 1) * size], book)


def _summed(books: list[np.ndarray], width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for p, (part, book) in enumerate(_parts(_rows(batch.column(0), width, scale), books)):
                entry = nearest(part, book)[0]
                count[p] += np.bincount(entry, minlength=len(book))
                add = np.zeros(book.shape, part.dtype)
                np.add.at(add, entry, part)
                total[p] += add.astype(object)
        found = [(p, e, int(n), [str(x) for x in total[p][e]]) for p, c in enumerate(count) for e, n in enumerate(c) if n]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "n", "total"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """The sums of one entry's partial sums, as decimal text of any length."""
    total = [str(sum(map(int, x))) for x in zip(*group.total, strict=True)]
    return pd.DataFrame({"part": group.part[:1], "entry": group.entry[:1], "n": [group.n.sum()], "total": [total]})


def _coded(books: list[np.ndarray], width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _rows(batch.column(0), width, scale)
            code = np.zeros((len(values), len(books)), np.uint8)
            error = np.zeros(len(values), object)
            for p, (part, book) in enumerate(_parts(values, books)):
                code[:, p], far, _ = nearest(part, book)
                error += far.astype(object)
            text, size = code.tobytes().hex(), 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array([text[k * size : (k + 1) * size] for k in range(len(values))], pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in error], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _learned(kept: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebooks after all rounds; the driver holds entries x width integers."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = floors(np.array([r.v for r in first], np.float64), scale)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds):
        partial = kept.select("v").mapInArrow(_summed(books, width, scale), "part int, entry int, n long, total array<string>")
        moved = [b.astype(object) for b in books]
        for r in partial.groupBy("part", "entry").applyInPandas(_added, partial.schema).collect():
            moved[r.part][r.entry] = [int(x) // r.n for x in r.total]
        books = [b if max(map(abs, b.ravel())) > SAFE else b.astype(np.int64) for b in moved]
    return books


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, embedding[, label]) -> (vec_id, code, error, label_error, codebooks_sha256), one row a kept vector.

    Components become floor(scale * x). Each part position's codebook begins as
    that part of the `entries` smallest kept vec_ids (fewer if there are fewer
    rows) and is moved `rounds` times to the componentwise floor of the mean of
    the parts assigned to each entry; entries without parts stay. `code` has two
    hexadecimal digits a part; `error` sums the squared distances, `label_error`
    the errors of all rows of equal label, null labels together. Ties go to the
    lower entry. All integers are exact; a sum that a long can't hold is null.

    Vectors that are null, empty, hold a null or non-finite component, or can't
    be cut into equal parts are dropped, and so are those of another length than
    the kept vector of the smallest vec_id. Rows that repeat a vec_id are rows
    of their own, in the order of their vectors; a null vec_id comes last.
    Without a label column all labels count as null. An empty table gives an
    empty result. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry has two hexadecimal digits")
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    cut = (F.size(value) > 0) & (F.size(value) % parts == 0)
    kept = vectors.where(value.isNotNull() & sound & cut).select(value.alias("v"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"))
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("width")).first()
    kind = kept.schema["label"].dataType.simpleString()
    if head is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.where(F.size("v") == head.width)
    books = _learned(kept, head.width, parts, entries, rounds, scale)
    digits = ",".join(str(x) for book in books for entry in book for x in entry)
    coded = written(kept.mapInArrow(_coded(books, head.width, scale), f"vec_id long, label {kind}, code string, error long"), "codes")
    # A label may hold a third of all rows: rows of heavy labels meet their few sums by broadcast and aren't shuffled.
    sums = written(
        coded.groupBy("label").agg(
            F.count("*").alias("rows"),
            F.when(F.count("*") == F.count("error"), F.try_sum("error")).alias("label_error"),
        ),
        "label-errors",
    )
    heavy = sums.where(F.col("rows") * HEAVY >= (sums.agg(F.sum("rows")).first()[0] or 0))
    light = sums.join(F.broadcast(heavy), sums["label"].eqNullSafe(heavy["label"]), "left_anti")
    few = heavy.select(F.col("label").alias("label_"), "label_error")
    many = light.select(F.col("label").alias("label_"), "label_error")
    same = coded["label"].eqNullSafe(F.col("label_"))
    rest = coded.join(F.broadcast(few.select("label_")), same, "left_anti")
    out = coded.join(F.broadcast(few), same).unionByName(rest.join(many, rest["label"].eqNullSafe(F.col("label_"))))
    sha = hashlib.sha256(digits.encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
