"""SentencePiece encoding by a shared-prefix Viterbi, and decoding.

A text, after the model's dummy space, is cut into marked words: runs of spaces
(the marks) with the characters that follow. No piece has a mark after another
character, so the best segmentation of a text is that of its words. The distinct
words of a batch are sorted, which is the depth-first order of their trie; the
forward scores of the prefix that a word has in common with the one before are
kept, and only the rest is computed. Scores are those of the public model's
pieces; the segmentation has the highest sum (unigram decoding).

Characters outside the vocabulary, a literal mark sign among them, become byte
pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORD = re.compile(r" +[^ ]*|[^ ]+")
#: Words a worker remembers at most between batches.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by text (marks as spaces) with id and score, byte pieces by byte, and what a character without a piece costs."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    text: list[bytes]
    unknown: float
    suffixes: frozenset[str] = field(repr=False)


def load(path: str = MODEL) -> Vocabulary:
    """Read a model with byte pieces; `path` is any SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_, text, least = {}, [0] * 256, [], 0.0
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            bytes_[int(piece[3:5], 16)] = k
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            text.append(b"")
        else:
            plain = piece.replace(MARK, " ")
            if " " in plain.lstrip(" "):
                raise ValueError(f"a piece has a mark after another character: {piece}")
            pieces[plain] = (k, model.get_score(k))
            text.append(plain.encode())
            least = min(least, model.get_score(k))
    suffixes = frozenset(p[k:] for p in pieces for k in range(len(p)))
    return Vocabulary(pieces, bytes_, text, least - 10.0, suffixes)


def segment(words: list[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """Piece ids of each distinct word by a depth-first walk over their trie.

    Of equally good segmentations, the one with the longest last piece wins, then
    the longest before it, and so on.
    """
    pieces, suffixes, unknown = vocabulary.pieces, vocabulary.suffixes, vocabulary.unknown
    best, back, number = [0.0], [0], [0]
    out, last = {}, ""
    for word in sorted(words):
        shared, limit = 0, min(len(last), len(word))
        while shared < limit and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :], number[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, begin_of, id_of = best[end - 1] + unknown, end - 1, -1
            for begin in range(end - 1, -1, -1):
                part = word[begin:end]
                if part not in suffixes:
                    break
                found = pieces.get(part)
                if found is not None:
                    score = best[begin] + found[1]
                    if score >= top or (id_of < 0 and begin == end - 1):
                        top, begin_of, id_of = score, begin, found[0]
            best.append(top)
            back.append(begin_of)
            number.append(id_of)
        ids, end = [], len(word)
        while end:
            begin = back[end]
            if number[end] < 0:
                ids.extend(vocabulary.bytes_[b] for b in reversed(word[begin:end].encode("utf-8", "surrogatepass")))
            else:
                ids.append(number[end])
            end = begin
        ids.reverse()
        out[word] = ids
        last = word
    return out


def marked_words(text: str) -> list[str]:
    """The marked words of a text, its dummy space included; none for an empty text."""
    return _WORD.findall(" " + text) if text else []


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of piece ids: bytes joined, invalid ones replaced, the dummy space dropped."""
    text = vocabulary.text
    return b"".join([text[k] for k in ids])[1:].decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts, remembering a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, texts: list[str | None]) -> list[list[int] | None]:
        cut = [None if t is None else marked_words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known.update(segment(list({w for t in cut if t for w in t if w not in known}), self.vocabulary))
        return [None if t is None else [k for w in t for k in known[w]] for t in cut]


def _runs(texts: list[str | None], rows: int = 200, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(index of the first, texts) in runs of at most `rows` texts and, but for a longer single text, `most` characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and (k - first >= rows or size + len(text or "") > most):
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield first, texts[first:]


def _encoded(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = wanted.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, part in _runs(texts):
                ids = encoder(part)
                columns = [batch.column(0).slice(first, len(part)), pa.array(ids, pa.list_(pa.int32()))]
                names = ["doc_id", "ids"]
                if back:
                    same = [None if t is None else decode_ids(k, vocabulary) == t for t, k in zip(part, ids, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                    names.append("exact")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql import SparkSession

    wanted = SparkSession.active().sparkContext.broadcast(load(path))  # as large as the vocabulary
    return run


def encode(docs: DataFrame, path: str = MODEL, check: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>), and with `check` also exact: whether decoding gives the text back.

    A null text has null ids, an empty one an empty array. Rows keep their
    repetitions; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_encoded(path, check), "doc_id long, ids array<int>" + ", exact boolean" * check)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give a null text."""
    bounded_batches(tokens.sparkSession)
    wanted = tokens.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            text = [None if k is None else decode_ids(k, wanted.value) for k in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
