"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

The vocabulary's pieces (letters only, case folded, word starts marked) are
given, of any length; each language gets its own piece probabilities by
expectation maximisation over a bounded, documented sample of its texts. A
word's probability sums over all its segmentations by the forward algorithm, a
text's is the product over all its words, and the languages' posterior decides.

Words are scored once for each batch of documents, all words of one length at a
time; words of over LONG characters one by one, with scaled forward scores. The
model is broadcast with the task: it has the size of the vocabulary times the
number of languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK, bounded_batches
from .toxicity import fold

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of more characters have their forward scores scaled; products of so many factors do not underflow.
LONG = 32
#: Texts of each language that training reads, about so many, by the hash of doc_id, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 250, 1 << 18
#: Languages that a model has at most.
LANGUAGES = 1_000
ROUNDS = 5
FLOOR = 1e-7
SLOTS = 17
_WORD = regex.compile(r"\p{L}+")
_B = 0x9E3779B97F4A7C15 | 1
_MIX = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The distinct pieces of letters, folded to lower case, with their mark; the mark alone is one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(k).lower() for k in range(model.get_piece_size()))
    return sorted({p for p in found if p.removeprefix(MARK) and _WORD.fullmatch(p.removeprefix(MARK))} | {MARK})


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _B + ord(c) + 1) & MASK
    return h


def _slot(h: np.ndarray, way: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(_MIX[way]) >> np.uint64(64 - SLOTS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages, piece hashes in two-way tables, piece probabilities (pieces + 1, languages), the longest piece."""

    langs: list[str]
    keys: np.ndarray
    ids: np.ndarray
    prob: np.ndarray
    longest: int

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, or the number of pieces where there is none."""
        out = np.full(h.shape, len(self.prob) - 1, np.int32)
        for way in (0, 1):
            at = _slot(h, way)
            hit = self.keys[way][at] == h
            out[hit] = self.ids[way][at[hit]]
        return out


def tables(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cuckoo tables of the pieces' hashes."""
    keys, ids = np.zeros((2, 1 << SLOTS), np.uint64), np.zeros((2, 1 << SLOTS), np.int32)
    for k, piece in enumerate(pieces):
        h, number, way = _hash(piece), k, 0
        for _ in range(500):
            at = int(_slot(np.array([h], np.uint64), way)[0])
            h, keys[way, at] = int(keys[way, at]), np.uint64(h)
            number, ids[way, at] = int(ids[way, at]), number
            if not h:
                break
            way ^= 1
        else:
            raise RuntimeError("no place for a piece")
    return keys, ids


def units(text: str) -> list[str]:
    """The lower-cased runs of letters, marked."""
    return [MARK + w for w in _WORD.findall(text.lower())]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points as a matrix) of the words of each length up to LONG, at most 20,000 words at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size[size <= LONG]):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), 20_000):
            part = at[k : k + 20_000]
            yield part, _codes("".join(words[i] for i in part)).reshape(len(part), n)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(model: Model, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, piece number of each word) of every span that may be a piece."""
    for end in range(1, codes.shape[1] + 1):
        h, power = np.zeros(len(codes), np.uint64), np.uint64(1)
        for begin in range(end - 1, max(-1, end - 1 - model.longest), -1):
            h = h + (codes[:, begin].astype(np.uint64) + np.uint64(1)) * power
            power = np.uint64(int(power) * _B & MASK)
            yield begin, end, model.lookup(h)


def _spans(model: Model, word: str) -> np.ndarray:
    """(characters, longest): the piece number of the span of j + 1 characters that ends behind character i."""
    code = _codes(word).astype(np.uint64) + np.uint64(1)
    out = np.full((len(code), model.longest), len(model.prob) - 1, np.int32)
    h, power = np.zeros(len(code), np.uint64), 1
    for j in range(min(model.longest, len(code))):
        h = h[1:] if j else h
        h = h + code[: len(code) - j] * np.uint64(power)
        power = power * _B & MASK
        out[j:, j] = model.lookup(h)
    return out


def _forward(spans: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """(characters + 1, languages): log forward scores of one word of any length, from its spans' piece numbers."""
    n, longest = spans.shape
    out = np.zeros((n + 1, prob.shape[1]))
    recent = np.zeros((longest, prob.shape[1]))  # the forward scores of the last places, the nearest first, scaled
    recent[0], scale = 1.0, np.zeros(prob.shape[1])
    for i in range(n):
        p = prob[spans[i]]
        p[0] = np.maximum(p[0], FLOOR)
        here = (recent * p).sum(axis=0)
        recent[1:] = recent[:-1]
        recent[0] = 1.0
        recent[1:] /= here
        scale += np.log(here)
        out[i + 1] = scale
    return out


def log_probabilities(model: Model, words: list[str]) -> np.ndarray:
    """log P(word | language), (words, languages), summed over all segmentations.

    A character outside the vocabulary has the probability FLOOR as a piece.
    """
    out = np.zeros((len(words), len(model.langs)))
    for at, codes in _by_length(words):
        alpha = np.zeros((codes.shape[1] + 1, len(codes), len(model.langs)))
        alpha[0] = 1
        for begin, end, piece in _pieces(model, codes):
            p = model.prob[piece]
            alpha[end] += alpha[begin] * (np.maximum(p, FLOOR) if end - begin == 1 else p)
        out[at] = np.log(alpha[-1])
    for k, word in enumerate(words):
        if len(word) > LONG:
            out[k] = _forward(_spans(model, word), model.prob)[-1]
    return out


def _expected(model: Model, word: str) -> tuple[np.ndarray, np.ndarray]:
    """(piece numbers, expected uses) of one long word under a model of one language."""
    spans = _spans(model, word)
    n, longest = spans.shape
    p = model.prob[spans, 0]
    p[:, 0] = np.maximum(p[:, 0], FLOOR)
    forward = _forward(spans, model.prob)[:, 0]
    # The backward scores are the forward scores of the word read from its end.
    back = np.full((n, longest), 0.0)
    for j in range(min(longest, n)):
        back[: n - j, j] = p[j:, j]
    backward, recent, scale = np.zeros(n + 1), np.zeros(longest), 0.0
    recent[0] = 1.0
    for i in range(n - 1, -1, -1):
        here = float(recent @ back[i])
        recent[1:] = recent[:-1]
        recent[0] = 1.0
        recent[1:] /= here
        scale += np.log(here)
        backward[i] = scale
    uses = np.zeros((n, longest))
    for j in range(min(longest, n)):
        uses[j:, j] = p[j:, j] * np.exp(forward[: n - j] + backward[j + 1 :] - forward[n])
    return spans.ravel(), uses.ravel()


def fit(samples: dict[str, list[str]], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Per-language piece probabilities by expectation maximisation; texts by language."""
    pieces = vocabulary(path)
    keys, ids = tables(pieces)
    longest = max(map(len, pieces))
    langs = sorted(samples)
    prob = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        count = Counter(w for text in samples[lang] for w in units(text))
        words, weight = list(count), np.fromiter(count.values(), float, len(count))
        size = np.fromiter(map(len, pieces), float, len(pieces))
        p = np.append(np.exp(-size), 0.0)
        p /= p.sum()
        for _ in range(rounds if words else 0):
            one = Model([lang], keys, ids, p[:, None], longest)
            seen = np.zeros(len(p))
            for at, codes in _by_length(words):
                n = codes.shape[1]
                spans = list(_pieces(one, codes))
                value = [np.maximum(p[x], FLOOR) if e - b == 1 else p[x] for b, e, x in spans]
                alpha, beta = np.zeros((n + 1, len(codes))), np.zeros((n + 1, len(codes)))
                alpha[0] = beta[n] = 1
                for (b, e, _), v in zip(spans, value, strict=True):
                    alpha[e] += alpha[b] * v
                for (b, e, _), v in zip(reversed(spans), reversed(value), strict=True):
                    beta[b] += v * beta[e]
                scale = weight[at] / alpha[n]
                for (b, e, x), v in zip(spans, value, strict=True):
                    seen += np.bincount(x, weights=alpha[b] * v * beta[e] * scale, minlength=len(p))
            for word, many in zip(words, weight, strict=True):
                if len(word) > LONG:
                    x, uses = _expected(one, word)
                    seen += np.bincount(x, weights=uses * many, minlength=len(p))
            seen[-1] = 0
            p = seen + 0.01 * np.append(np.exp(-size), 0.0)
            p /= p.sum()
        prob[:, k] = p
    return Model(langs, keys, ids, prob, longest)


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [units(t) if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > 100_000:
                known.clear()
            new = list({w for t in texts for w in t if w not in known})
            known.update(zip(new, log_probabilities(model, new), strict=True))
            langs, scores = [], []
            for t in texts:
                if not t or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(model.langs))
                for w, n in Counter(t).items():
                    total += n * known[w]
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def train(docs: DataFrame, usable: Column, path: str = VOCABULARY, most: int = SAMPLE) -> Model:
    """Fit on about `most` texts of each language, of the rows where `usable` holds.

    Rows with a null lang, text or id are left out, and texts of over
    SAMPLE_BYTES bytes; rows that repeat a language's doc_id count once. Texts
    come by the hash of doc_id, at most 2 * `most` of a language. More than
    LANGUAGES languages are refused.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (F.octet_length("text") <= SAMPLE_BYTES) & usable
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return fit({}, path)
    share = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(most / n)))), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    picked = picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"))
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * most).orderBy("lang", "k").collect():
        samples[r["lang"]].append(r["text"])
    return fit(samples, path)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score).

    A text without a letter (null and empty ones, and those of digits and other
    numerals), or a model without languages, gives `und` with score 0. Equal posteriors go to the language
    that sorts first.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, path: str = VOCABULARY, parts: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learns outside the fold `held` of `parts`."""
    bounded_batches(docs.sparkSession)
    model = train(docs, fold("doc_id", parts) != held, path)
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
