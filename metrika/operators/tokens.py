"""Tokens, lines, stanzas, sentences and phrases of texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from metrika.functions import text as T


def tokens(texts: DataFrame, text_id: str = "doc_id", clean: bool = True) -> DataFrame:
    """One row per token with the numbers of the stanza, line, sentence, phrase and line part that it stands in.

    text_id, word_num, word_txt, is_punc, para_num, line_num, sent_num,
    sentpart_num, linepart_num. A token that carries a line feed begins a line
    (and a line part), with two or more a stanza; after a token with a phrase
    separator a new sentence part and line part begin. A sentence begins after
    `.`, `!` or `?` (and up to one closing quote or bracket) before white space.

    Texts are dealt out by id once; then each text's tokens are numbered in its
    own row, a batch of texts at a time: what a token is (a break, a stop, a
    separator) is told once a distinct token, counters are running sums over
    the batch. No token is shuffled or sorted. Texts that share an id are
    numbered each by itself.
    """
    source = T.clean_text(F.col("text")) if clean else F.col("text")
    rows = spread(texts.select(F.col(text_id).alias("text_id"), "text"), "text_id").select("text_id", _numbered(T.token_array(source)).alias("t"))
    # An outer generator: for an inner one a filter would number every text a second time, before they are dealt out.
    return rows.select("text_id", F.inline_outer("t")).where("word_num is not null")


def spread(texts: DataFrame, text_id: str) -> DataFrame:
    """Texts dealt out by id to as many parts as a shuffle has: a token makes much more work than the bytes that it is read from."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_id)


_COUNTERS = ["para_num", "line_num", "sent_num", "sentpart_num", "linepart_num"]
TOKEN = ArrayType(
    StructType(
        [StructField("word_num", IntegerType()), StructField("word_txt", StringType())]
        + [StructField(k, IntegerType()) for k in ("is_punc", *_COUNTERS)]
    )
)
_SPACE = " \t\n\x0b\f\r"
_SEPARATOR = re.compile(T.SEPARATOR_CLASS).search


@lru_cache(maxsize=1 << 18)
def facts_of(token: str) -> tuple[int, int, int, int, int, int]:
    """is_punc, line feeds, separator, white space in front, stop, closing sign."""
    core = token.lstrip(_SPACE)
    if core.isalpha():
        return 0, token.count("\n"), 0, int(core != token), 0, 0
    return (
        int(not any(map(str.isalpha, token))), token.count("\n"), int(_SEPARATOR(token) is not None), int(core != token),
        int(core in (".", "!", "?")), int(core in ('"', "'", ")", "]")),
    )


def _number(found: pa.Array) -> pa.Array:
    """The tokens of each text with their numbers; none for a null text."""
    flat = found.flatten()
    coded = flat.dictionary_encode()
    facts = np.array([facts_of(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 6)
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy().astype(np.int64)
    numbers = numbered(facts[coded.indices.to_numpy()].T, size)
    columns = [flat if f.name == "word_txt" else pa.array(numbers[f.name].astype(np.int32)) for f in TOKEN.elementType.fields]
    tokens = pa.StructArray.from_arrays(columns, names=[f.name for f in TOKEN.elementType.fields])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), tokens)


def numbered(facts: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of the tokens of texts of so many tokens each, from what `facts_of` tells of each token."""
    punctuation, breaks, separator, spaced, stop, closing = facts
    ends = np.cumsum(size)
    first = np.repeat(ends - size, size)
    at = np.arange(len(first)) - first

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[k:] = x[: max(len(x) - k, 0)]
        return np.where(at >= k, out, 0)

    def so_far(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[1:] - sums[first]

    begins = spaced & (before(stop, 1) | (before(closing, 1) & before(stop, 2)))
    lines, seps = so_far(breaks > 0), so_far(separator) - separator
    counters = [1 + so_far(breaks > 1), 1 + lines, 1 + so_far(begins), 1 + seps, 1 + seps + lines]
    return {"word_num": at + 1, "is_punc": punctuation, **dict(zip(_COUNTERS, counters, strict=True))}


# As if not deterministic: else a filter of what it returns would run it a second time below.
_numbered = F.arrow_udf(_number, TOKEN).asNondeterministic()


#: Between the tokens of a text in one string: no token has it, since all but letters, numbers and U+0020 to U+2014 is marked.
BETWEEN = "\x1f"


#: Texts of an Arrow batch that are Python's at one time.
TEXTS_TOGETHER = 128


def _each(texts: pa.Array, tell: Callable[[str], str]) -> pa.Array:
    parts = (texts.slice(k, TEXTS_TOGETHER).to_pylist() for k in range(0, len(texts), TEXTS_TOGETHER))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else tell(t) for t in part], pa.string()) for part in parts)])


def _clean(texts: pa.Array) -> pa.Array:
    return _each(texts, T.cleaned)


def _found(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: BETWEEN.join(T.tokens_of(t)))


_cleaned = F.arrow_udf(_clean, StringType()).asNondeterministic()
_tokens_of = F.arrow_udf(_found, StringType()).asNondeterministic()


def token_strings(texts: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """text_id, tokens: the tokens of each text in one string, BETWEEN them, for passes over whole texts (`numbered` numbers them).

    Built-in functions read a text once for each of its two dozen replacements;
    Python's string functions find at once that there is nothing to replace. One
    string goes back and forth at a fraction of the cost of an array of tokens.
    """
    rows = spread(texts.select(F.col(text_id).alias("text_id"), "text"), "text_id").select("text_id", _cleaned("text").alias("text"))
    return rows.select("text_id", _tokens_of(T.marked(F.col("text"))).alias("tokens"))


#: What has a letter has a word.
LETTER = r"\p{L}"


def _lines(texts: DataFrame, text_id: str) -> DataFrame:
    """text_id, line (from 0), line_txt. An outer generator: for an inner one a filter would split every text a second time."""
    split = F.split(T.normalize_dashes(T.clean_text(F.col("text"))), r"\s*\n\s*")
    texts = spread(texts.select(F.col(text_id).alias("text_id"), "text"), "text_id")
    return texts.select("text_id", F.posexplode_outer(split).alias("line", "line_txt")).where("line_txt is not null")


def line_parts(texts: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """text_id, line_num, linepart, words: the parse units, made row by row; only whole texts are dealt out, by id.

    Lines are split at line feeds with the white space around them, parts after
    each phrase separator; linepart counts from 1 within its line. Parts without
    a word are left out.
    """
    lines = _lines(texts, text_id)
    parts = lines.select("text_id", "line", F.posexplode_outer(F.split("line_txt", T.SEPARATOR_CLASS)).alias("part", "part_txt"))
    return parts.where(F.col("part_txt").rlike(LETTER)).select(
        "text_id",
        (F.col("line") + 1).alias("line_num"),
        (F.col("part") + 1).alias("linepart"),
        T.word_array(F.col("part_txt")).alias("words"),
    )


def whole_lines(texts: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """text_id, line_num, words of every line with a word."""
    lines = _lines(texts, text_id)
    return lines.where(F.col("line_txt").rlike(LETTER)).select("text_id", (F.col("line") + 1).alias("line_num"), T.word_array(F.col("line_txt")).alias("words"))


#: From the last word with a letter on: read backwards from the end, no other word is cut out.
LAST_WORD = rf"(?s)^.*(?<![\p{{L}}\p{{N}}_'])([\p{{L}}\p{{N}}_']*\p{{L}}[\p{{L}}\p{{N}}_']*)"


def line_ends(texts: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """`whole_lines` with the last word of each line alone: all that rhymes read."""
    lines = _lines(texts, text_id)
    word = F.regexp_extract("line_txt", LAST_WORD, 1)
    return lines.where(F.col("line_txt").rlike(LETTER)).select("text_id", (F.col("line") + 1).alias("line_num"), F.array(word).alias("words"))


def sentences(texts: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """text_id, sent_num, sentence: split after . ! ? (and closing quotes) before white space."""
    cut = F.split(F.regexp_replace("text", r"([.!?][\"')]?)(\s+)", "$1\u0001$2"), "\u0001")
    return texts.select(F.col(text_id).alias("text_id"), F.posexplode(cut).alias("at", "sentence")).select(
        "text_id", (F.col("at") + 1).alias("sent_num"), "sentence"
    )
