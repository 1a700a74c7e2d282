"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = logistic(s - threshold_k) with one score s for all thresholds and
thresholds in ascending order. s is linear in the shares of hashed features of a
text: words, character 3-grams of its shape (letters, capitals, digits and white
space as classes), and lines that repeat within it. Training reads a bounded,
documented sample of rated rows on the driver; scoring is one pass over whole
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, buffer, chunks, span_hashes, words

WORD_BITS = 15
SHAPES = 24
#: Rated rows of each grade that training reads at most, smallest hash of doc_id first, and the bytes of their texts at most.
SAMPLE, SAMPLE_BYTES = 1_500, 1 << 18

_CLASS = np.full(256, 23, np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:256] = 0, 1, 2, 3
for _k, _c in enumerate(b" \n\t.,;:!?'\"-|#$%&*@"):
    _CLASS[_c] = 4 + _k
WORDS, GRAMS, EXTRA = 1 << WORD_BITS, SHAPES**3, 2
WIDTH = WORDS + GRAMS + EXTRA


@dataclass(frozen=True)
class Model:
    """Weights by feature and the ordered thresholds (one fewer than grades)."""

    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, value): every occurrence with the reciprocal of its kind's count in the text."""
    raw, begins = buffer(texts)
    count = len(texts)

    def shared(doc: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum(np.bincount(doc, minlength=count), 1)[doc]

    start, end, doc = words(raw, begins)
    word = (span_hashes(LOWER[raw], start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    shape = _CLASS[raw].astype(np.int64)
    owner = np.repeat(np.arange(count), np.diff(begins))
    fold = np.concatenate(([True], (shape[1:] != shape[:-1]) | (owner[1:] != owner[:-1])))  # runs of a class count once
    shape, owner = shape[fold], owner[fold]
    gram = shape[:-2] * SHAPES * SHAPES + shape[1:-1] * SHAPES + shape[2:]
    inside = owner[:-2] == owner[2:]
    gram, gram_doc = gram[inside] + WORDS, owner[:-2][inside]
    stop = np.flatnonzero(raw == 10)
    line_start = np.concatenate(([0], stop[:-1] + 1))
    full = stop > line_start
    line_doc = np.searchsorted(begins, line_start[full], side="right") - 1
    line = span_hashes(raw, line_start[full], stop[full])
    again = np.concatenate(
        [_repeats(line_doc, line), _repeats(doc[1:], (word[1:] << WORD_BITS) | word[:-1]) if len(word) > 1 else np.zeros(0, bool)]
    )
    extra_doc = np.concatenate([line_doc, doc[1:]])
    kind = WORDS + GRAMS + np.concatenate([np.zeros(len(line_doc), np.int64), np.ones(max(len(doc) - 1, 0), np.int64)])
    extra = np.concatenate([shared(line_doc), shared(doc[1:])]) * again
    return (
        np.concatenate([doc, gram_doc, extra_doc]),
        np.concatenate([word, gram, kind]),
        np.concatenate([shared(doc), shared(gram_doc), extra]),
    )


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one array; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _repeats(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value of the same text stands earlier."""
    out = np.zeros(len(doc), bool)
    order = np.lexsort((np.arange(len(doc)), value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out[order[1:][same]] = True
    return out


def fit(texts: list[str | None], grades: list[int], levels: int, counts: list[int] | None = None, ridge: float = 2e-4, rounds: int = 400) -> Model:
    """Train on texts with grades 0 to levels - 1; `counts` are the rows of each grade that the sample stands for.

    Without texts, or with one grade only, all weights are zero and the
    thresholds give the smoothed shares.
    """
    y = np.array(grades, np.int64)
    have = np.bincount(y, minlength=levels).astype(float)
    total = np.array(counts if counts is not None else have, float) + 0.5
    above = np.cumsum(total[::-1])[::-1][1:] / total.sum()
    theta = -np.log(above / (1 - above))
    if (have > 0).sum() < 2:
        return Model(np.zeros(WIDTH, np.float32), theta)
    rows, cols, values = [], [], []
    for first, part in chunks(texts):
        row, col, value = features(part)
        key, at = np.unique((row + first) * np.int64(WIDTH) + col, return_inverse=True)
        # The driver holds all entries of the sample at once: at half the width, and no list of parts beside them.
        rows.append((key // WIDTH).astype(np.int32))
        cols.append((key % WIDTH).astype(np.int32))
        values.append(np.bincount(at, weights=value))
    del key, at
    row, col, value = joined(rows), joined(cols), joined(values)
    size = len(y)
    spread = np.sqrt(np.bincount(col, weights=value**2, minlength=WIDTH) / size)
    often = np.bincount(col, minlength=WIDTH) >= max(3, size // 500)
    unit = np.where(often & (spread > 0), 1 / np.maximum(spread, 1e-4), 0.0) ** 0.5
    value *= unit[col]
    used = value > 0
    row = row[used]
    col = col[used]
    value = value[used]
    weight = (1.0 / np.maximum(have, 1))[y] / (have > 0).sum()
    # Thresholds: the first free, then positive gaps; Adam on everything.
    gap = np.concatenate(([theta[0] if np.isfinite(theta[0]) else 0.0], np.log(np.maximum(np.diff(theta), 1e-2))))
    w = np.zeros(WIDTH)
    state = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(levels - 1), np.zeros(levels - 1)]
    for k in range(1, rounds + 1):
        theta = gap[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap[1:]))))
        s = np.bincount(row, weights=value * w[col], minlength=size)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -500, 500)))
        inner = np.concatenate((np.ones((size, 1)), p, np.zeros((size, 1))), 1)
        mass = np.maximum(inner[np.arange(size), y] - inner[np.arange(size), y + 1], 1e-12)
        slope = p * (1 - p)
        low = np.where(y[:, None] - 1 == np.arange(levels - 1)[None, :], slope, 0)
        high = np.where(y[:, None] == np.arange(levels - 1)[None, :], slope, 0)
        each = weight[:, None] * (high - low) / mass[:, None]  # d loss / d (s - theta_k)
        gs = each.sum(axis=1)
        gw = np.bincount(col, weights=value * gs[row], minlength=WIDTH) + ridge * w
        gt = -each.sum(axis=0)
        gg = np.concatenate(([gt.sum()], np.exp(gap[1:]) * np.cumsum(gt[::-1])[::-1][1:]))
        for x, g, m, v in ((w, gw, state[0], state[1]), (gap, gg, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
    theta = gap[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap[1:]))))
    return Model((w * unit).astype(np.float32), theta)


def _scored(model: Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score = np.zeros(len(texts))
            for first, part in chunks(texts):
                row, col, value = features(part)
                score[first : first + len(part)] = np.bincount(row, weights=value * model.weight[col], minlength=len(part))
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, level - 1])],
                names=["doc_id", "expected_grade", "tail_probability"],
            )

    return run


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The graded rating of `labels`: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when(F.col(quality) == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, most: int = SAMPLE) -> Model:
    """Fit on (doc_id, grade) rows, at most `most` of each grade by the hash of doc_id.

    Null grades, ids and texts are left out, and texts of over SAMPLE_BYTES bytes; an
    id rated twice counts with its lowest grade.
    """
    one = (
        ratings.where("doc_id is not null and grade between 0 and " + str(levels - 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("grade").cast("int").alias("grade__"))
    )
    counts = {r["grade__"]: r["count"] for r in one.groupBy("grade__").count().collect()}
    picked = None
    for k in range(levels):
        part = one.where(F.col("grade__") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        texts.where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(picked), "doc_id")  # at most levels * most ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("grade__").alias("grade__"))
        .orderBy("doc_id")
        .collect()
    )
    texts, grades = [r["text"] for r in found], [r["grade__"] for r in found]
    del found
    return fit(texts, grades, levels, [counts.get(k, 0) for k in range(levels)])


def scored(docs: DataFrame, model: Model, level: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, expected_grade, tail_probability = P(grade >= level)).

    Null, empty and blank texts have no features, and so the score 0.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scored(model, level), "doc_id long, expected_grade double, tail_probability double")


def rated(docs: DataFrame, labels: DataFrame, level: int = 1, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, selected (its tail probability is at least `least`)."""
    bounded_batches(docs.sparkSession)
    model = train(docs, labels.select("doc_id", grade().alias("grade")))
    return scored(docs, model, level).withColumn("selected", F.col("tail_probability") >= least)


def selected(docs: DataFrame, labels: DataFrame, level: int = 1, least: float = 0.5) -> DataFrame:
    """The documents, with their columns as they are, whose tail probability is at least `least` (ties stay).

    Null, empty and blank texts have the score 0 and stay or go with it; repeated
    rows are judged alike; no rows, or no ratings, give a table or a model of
    shares alone. Columns of any name pass through.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels.select("doc_id", grade().alias("grade")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scored(model, level)
        for batch in batches:
            names = batch.schema.names
            pair = pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("text"))], names=["doc_id", "text"])
            out = next(judge(iter([pair])))
            yield batch.filter(pa.array(np.asarray(out.column(2)) >= least))

    return docs.mapInArrow(run, docs.schema)
