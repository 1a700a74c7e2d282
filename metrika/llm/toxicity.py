"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 8 bytes of a text (A-Z lower-cased), hashed to
2**20 buckets, present or absent. Each is scaled by the log of its smoothed rate
in toxic over its rate in other texts, and a ridge logistic regression is fitted
to the scaled features. Training reads a bounded, documented sample of the
labelled rows on the driver; scoring is one pass over whole texts, without a
shuffle, with a sparse model of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, buffer, chunks, span_hashes, words

BITS, ORDERS = 20, (3, 4, 5, 6, 7, 8)
#: Labelled rows of each class that training reads at most, smallest hash of doc_id first, and the bytes of their texts at most.
SAMPLE, SAMPLE_BYTES = 2_000, 1 << 18
#: Buckets that a model has weights for, those with the largest share in the naive Bayes score, if a bucket is in
#: RARE or more texts of the sample. Trained on 1,000 texts a class, 4,000 held-out texts: 1,000 buckets 3 errors
#: (AUC 0.999998), 10,000 none (1.0), 100,000 one (0.999827); so no more than this helps.
FEATURES, RARE = 10_000, 4


@dataclass(frozen=True)
class Model:
    """Non-zero weights by bucket, and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bucket] = self.weight
        return out


def gram_buckets(raw: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (position, bucket) of every n-gram that lies in one text (its closing line feed included)."""
    raw = LOWER[raw].astype(np.uint64)
    last = np.repeat(begins[1:], np.diff(begins))
    code = np.zeros(len(raw), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(raw) - n + 1
        if size <= 0:
            return
        code = code[:size] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            bucket = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
            yield np.flatnonzero(np.arange(n, size + n) <= last[:size]), bucket


def present(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct n-grams of each text, of the wanted buckets only if a mask is given."""
    raw, begins = buffer(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    keys = []
    for at, bucket in gram_buckets(raw, begins):
        b = bucket[at]
        if wanted is not None:
            hit = wanted[b]
            at, b = at[hit], b[hit]
        keys.append((doc[at].astype(np.int64) << BITS) | b.astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(
    texts: list[str | None], toxic: list[int], share: float | None = None, ridge: float = 0.1, rounds: int = 250, features: int = FEATURES
) -> Model:
    """Train on texts with 0/1 labels; `share` is the share of label 1 to assume (None: that of the sample).

    The score's scale and intercept come from margins of texts that the weights
    were not fitted to (two halves, each scored by the other's weights; copies of
    a text stay in one half). With one class only, or no text, the model has no
    features and scores the smoothed share everywhere.
    """
    y = np.array(toxic, np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    share = (n1 + 0.5) / (n1 + n0 + 1) if share is None else min(max(share, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    # First pass: how many texts of each half and class hold each bucket. The half
    # follows what a text holds (its word of smallest hash), so that
    # near copies stay together; the order decides where that leaves a half
    # without a class.
    half = np.zeros(len(y), np.int64)
    for first, part in chunks(texts):
        raw, begins = buffer(part)
        start, end, doc = words(raw, begins)
        least = np.full(len(part), np.uint64((1 << 64) - 1))
        np.minimum.at(least, doc, span_hashes(LOWER[raw], start, end))
        half[first : first + len(part)] = (least & np.uint64(1)).astype(np.int64)
    if any(len(set(y[half == h])) < 2 for h in (0, 1)):
        for c in (0, 1):
            half[y == c] = np.arange(int((y == c).sum())) % 2
    held = np.zeros((2, 2, 1 << BITS))
    for first, part in chunks(texts):
        row, col = present(part)
        kind = half[first + row] * 2 + (y[first + row] > 0)
        for k in range(4):
            held[k // 2, k % 2] += np.bincount(col[kind == k], minlength=1 << BITS)
    both = held.sum(axis=0)
    picks = [_ratios(*x, features) for x in (held[1], held[0], both)]
    wanted = np.zeros(1 << BITS, bool)
    for keep, _ in picks:
        wanted[keep] = True
    # Second pass: the wanted buckets alone.
    rows, cols = [], []
    for first, part in chunks(texts):
        row, col = present(part, wanted)
        rows.append((row + first).astype(np.int32))
        cols.append(col.astype(np.int32))
    row, col = np.concatenate(rows), np.concatenate(cols)
    weight = np.where(y > 0, share / n1, (1 - share) / n0)
    margin = np.zeros(len(y))
    for h in (0, 1):
        if len(set(y[half != h])) == 2:
            table = _weights(row, col, y, half != h, picks[h], ridge, rounds)
            margin[half == h] = np.bincount(row, weights=table[col], minlength=len(y))[half == h]
    slope, intercept = _scaled(margin, y, weight)
    table = _weights(row, col, y, np.ones(len(y), bool), picks[2], ridge, rounds)
    keep = np.flatnonzero(table)
    return Model(keep, (slope * table[keep]).astype(np.float32), intercept)


def _ratios(in0: np.ndarray, in1: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with the largest share in a naive Bayes score, and their log-count ratios."""
    n0, n1 = max(in0.max(), 1.0), max(in1.max(), 1.0)
    ratio = np.log((in1 + 1) / (n1 + 2)) - np.log((in0 + 1) / (n0 + 2))
    gain = np.abs(in1 / n1 - in0 / n0) * np.abs(ratio)
    gain[(in1 + in0) < RARE] = 0
    keep = np.sort(np.argsort(-gain, kind="stable")[:features])
    keep = keep[gain[keep] > 0]
    return keep, ratio[keep]


def _weights(
    row: np.ndarray, col: np.ndarray, y: np.ndarray, used: np.ndarray, pick: tuple[np.ndarray, np.ndarray], ridge: float, rounds: int
) -> np.ndarray:
    """The weight of each bucket by a ridge logistic regression on ratio-scaled features of the used texts."""
    keep, ratio = pick
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)
    inside = used[row] & (place[col] >= 0)
    row, col = row[inside], place[col[inside]]
    value = ratio[col]
    n1, n0 = float(y[used].sum()), float((1 - y[used]).sum())
    # Accelerated gradient steps; row norms bound the step.
    norm = np.bincount(row, weights=value**2, minlength=len(y))
    step = 4.0 / (max(norm.max(initial=0), 1.0) + 4 * ridge / len(y))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * used
    w = look = np.zeros(len(keep))
    b = look_b = 0.0
    for k in range(rounds):
        s = np.bincount(row, weights=value * look[col], minlength=len(y)) + look_b
        error = weight * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y)
        g = np.bincount(col, weights=value * error[row], minlength=len(keep)) + ridge / len(y) * look
        new, new_b = look - step * g, look_b - min(step, 1.0) * error.sum()
        pace = k / (k + 3)
        look, look_b = new + pace * (new - w), new_b + pace * (new_b - b)
        w, b = new, new_b
    out = np.zeros(1 << BITS)
    out[keep] = w * ratio
    return out


def _scaled(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one margin, by Newton steps with a small ridge."""
    scale = max(float(np.abs(margin).max(initial=0)), 1e-9)
    x = np.stack([margin / scale, np.ones(len(y))], 1)
    beta = np.zeros(2)
    weight = weight / weight.sum() * len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        g = x.T @ (weight * (p - y)) + 1e-3 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        beta -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return max(float(beta[0]) / scale, 0.0), float(beta[1])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        wanted = table != 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.empty(len(texts))
            for first, part in chunks(texts):
                doc, bucket = present(part, wanted)
                s = np.bincount(doc, weights=table[bucket], minlength=len(part)) + model.intercept
                out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score); a null or empty text gets the intercept's score."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scored(model), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = SAMPLE) -> Model:
    """Fit on at most `most` labelled documents of each class for which `usable` (on doc_id) holds.

    Rows come by the hash of doc_id, so the sample does not depend on order or
    partitioning. Labels other than 0 and 1, null doc_ids, null texts and texts of
    over SAMPLE_BYTES bytes are left out; a doc_id labelled twice counts once, as
    1 if any row says so.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label__"))
    )
    counts = {r["label__"]: r["count"] for r in one.groupBy("label__").count().collect()}
    picked = None
    for value in (1, 0):
        part = one.where(F.col("label__") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        texts.where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(picked), "doc_id")  # at most 2 * most ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label__").alias("label__"))
        .orderBy("doc_id")
        .collect()
    )
    total = sum(counts.values())
    return fit([r["text"] for r in found], [r["label__"] for r in found], counts.get(1, 0) / total if total else None)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`."""
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % parts


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents outside the fold `held` of `parts`. A null
    doc_id is not held out. Repeated rows are scored row by row.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, fold("doc_id", parts) != held)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
