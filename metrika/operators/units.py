"""Parse units as bit masks: bit i of a mask is syllable i of the unit.

Everything is computed within the unit's row: distinct words of an Arrow batch
give their syllables once, masks are arithmetic over all words of the batch, and
what follows is bit arithmetic in generated code; encoding needs no shuffle.
Masks: st stressed, he heavy, sg strong, wk weak, fn function word, wb a word
begins; n is the number of syllables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from metrika.functions import ortho
from metrika.functions import text as T

MASKS = ["st", "he", "sg", "wk", "fn", "wb"]
LONGEST = 18


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value.cast("long"), by.cast("int"))


def _full(n: Column) -> Column:
    return _shift(F.lit(1), n) - 1


#: What a word adds to its unit: syllables, and the masks of heavy, stressed and ambiguous ones.
Shape = tuple[int, int, int, int]


@lru_cache(maxsize=1 << 18)
def shape(word: str) -> Shape:
    """The syllables of a lower-cased word and their masks, by the orthographic rules."""
    chunks = _CHUNKS(word)
    n = len(chunks)
    heavy = sum(1 << i for i, c in enumerate(chunks[:LIMIT]) if c[-1] not in ortho.VOWELS or _LONG(c))
    if n == 1:
        return n, heavy, int(word not in _UNSTRESSED and word not in _AMBIGUOUS), int(word in _AMBIGUOUS)
    return n, heavy, sum(1 << i for i in range(0, min(n, LIMIT), 2) if i == 0 or i < n - 1), 0


_CHUNKS = re.compile(ortho.CHUNK).findall
_LONG = re.compile(f"[{ortho.VOWELS}]{{2}}").search
_AMBIGUOUS = frozenset(ortho.AMBIGUOUS_WORDS) - frozenset(ortho.FUNCTION_WORDS)
_UNSTRESSED = frozenset(ortho.FUNCTION_WORDS)
#: Syllables that a mask has room for.
LIMIT = 62


def _masks(words: pa.Array) -> tuple[np.ndarray, ...]:
    """(n, he, wb, st, amb) of a batch of units: each distinct word is looked at once, the rest is arithmetic over all."""
    flat = words.flatten()
    size = np.diff(words.offsets.to_numpy()) if isinstance(words, pa.ListArray) else np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    known = np.array([shape(w.lower()) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 4)
    return _joined(*known[coded.indices.to_numpy()].T, size)


def _joined(n: np.ndarray, heavy: np.ndarray, stressed: np.ndarray, ambiguous: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, he, wb, st, amb) of units of so many words each, from what each word adds."""
    unit = np.repeat(np.arange(len(size)), size)
    total = np.bincount(unit, weights=n, minlength=len(size)).astype(np.int64)
    before = np.cumsum(n) - n
    first = np.cumsum(size) - size
    at = before - (before[np.minimum(first, max(len(n) - 1, 0))] if len(n) else np.zeros(len(size), np.int64))[unit]
    fits = (total <= LIMIT)[unit] & (n > 0)
    at, unit = at[fits], unit[fits]
    out = []
    for bits in (heavy, np.ones_like(n), stressed, ambiguous):
        mask = np.zeros(len(size), np.int64)
        np.add.at(mask, unit, bits[fits] << at)  # bits of different words never meet
        out.append(mask)
    return total, *out


_RHYTHM = StructType([StructField("n", IntegerType()), *(StructField(k, LongType()) for k in ("he", "wb", "st", "amb"))])


def _told(words: pa.Array) -> pa.Array:
    total, *masks = _masks(words)
    columns = [pa.array(total.astype(np.int32)), *(pa.array(m) for m in masks)]
    return pa.StructArray.from_arrays(columns, names=["n", "he", "wb", "st", "amb"])


# As if not deterministic: else the filter by length would run it a second time below.
_rhythm = F.arrow_udf(_told, _RHYTHM).asNondeterministic()


def rhythms(units: DataFrame, longest: int = LONGEST, shortest: int = 2) -> DataFrame:
    """Adds n, he, wb, st and amb to units with `words`, one row a unit: heavy, word beginnings, stressed, ambiguous.

    Units outside shortest..longest syllables are left out. Only the words leave
    the JVM, in Arrow batches; measured against ten replacements over each unit's
    text, it takes a fraction of the time.
    """
    keys = units.columns
    out = units.where(F.col("words").isNotNull()).select(*keys, _rhythm("words").alias("v"))
    return out.where(F.col("v.n").between(shortest, longest)).select(*keys, "v.*")


# ---- units of whole texts, told in the text's own row ----

#: What a text is read for: words, phrase separators, line feeds with the white space after them. `\\w` has the letters, numbers and the low line.
_PIECES = re.compile(r"[\w']+|" + T.SEPARATOR_CLASS + r"|\n[ \t\n\x0b\f\r]*").findall
#: Texts that are read together.
TEXTS_TOGETHER = 256


class _Known(dict):
    """Piece -> its row in `table`: line feed, separator, word, and the shape of a word; each distinct piece is looked at once."""

    MOST = 1 << 19

    def __init__(self):
        self.new: list[tuple] = []
        self.table = np.zeros((0, 7), np.int64)

    def __missing__(self, piece: str) -> int:
        word = any(map(str.isalpha, piece))
        self.new.append((piece[0] == "\n", piece in T.SEPARATORS, word, *(shape(piece.lower()) if word else (0, 0, 0, 0))))
        self[piece] = len(self)
        return len(self) - 1

    def rows(self, found: list[list[str]]) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.int64)])
            self.new = []
        return self.table[at]


_known = _Known()


def _read(texts: list[str | None], longest: int, shortest: int) -> tuple[np.ndarray, ...]:
    """(text, line_num, linepart, n, he, wb, st, amb) of the line parts of a batch of texts, in order: what `tokens.line_parts` and `rhythms` tell."""
    found = [_PIECES(T.cleaned(t)) if t else [] for t in texts]
    size = np.fromiter(map(len, found), np.int64, len(found))
    feed, sep, word, *shapes = np.ascontiguousarray(_known.rows(found).T)
    text = np.repeat(np.arange(len(size)), size)
    begins = np.zeros(len(feed), bool)
    begins[(np.cumsum(size) - size)[size > 0]] = True
    feeds, seps = np.cumsum(feed), np.cumsum(sep)
    so_far = lambda x, at: np.maximum.accumulate(np.where(at, x, 0)) if len(x) else x
    line = 1 + feeds - so_far(feeds - feed, begins)
    part = 1 + seps - so_far(seps - sep, begins | (feed > 0))
    unit = np.cumsum((feed > 0) | (sep > 0) | begins)
    own = np.flatnonzero(word)
    fresh = np.ones(len(own), bool)
    fresh[1:] = unit[own][1:] != unit[own][:-1]
    first = np.flatnonzero(fresh)
    total, *masks = _joined(*(x[own] for x in shapes), np.diff(np.append(first, len(own))))
    fits = (total >= shortest) & (total <= longest)
    first = own[first[fits]]
    return text[first], line[first], part[first], total[fits], *(m[fits] for m in masks)


def _told_of(texts: DataFrame, text_id: str, tell: Callable[[pa.Array, tuple[np.ndarray, ...]], list], schema: str, longest: int, shortest: int) -> DataFrame:
    """The columns that tell(ids, what `_read` gives) makes of some texts at a time; texts are dealt out by id once."""
    spark = texts.sparkSession
    rows = texts.select(F.col(text_id).alias("text_id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "text_id")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_TOGETHER):
                part = batch.slice(first, TEXTS_TOGETHER)
                yield pa.RecordBatch.from_arrays(tell(part.column(0), _read(part.column(1).to_pylist(), longest, shortest)), names=names)

    return rows.mapInArrow(run, schema)


#: Syllables that one of the two longs of a packed rhythm has room for, twice over and with their number.
PACKED = 20


def _pack(n: np.ndarray, he: np.ndarray, wb: np.ndarray, st: np.ndarray, amb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return n << (2 * PACKED) | he << PACKED | wb, st << PACKED | amb


def unpacked(first: str, second: str) -> list[Column]:
    """n, he, wb, st and amb of a rhythm packed into two longs."""
    low = F.lit((1 << PACKED) - 1)
    cut = lambda c: (F.shiftright(c, PACKED).bitwiseAND(low), F.col(c).bitwiseAND(low))
    return [F.shiftright(first, 2 * PACKED).cast("int").alias("n"), *(x.alias(k) for k, x in zip(("he", "wb", "st", "amb"), (*cut(first), *cut(second)), strict=True))]


def packed() -> list[Column]:
    """r1 and r2, the two longs of a rhythm: what `unpacked` takes apart."""
    put = lambda c, by: F.shiftleft(F.col(c).cast("long"), by)
    first = put("n", 2 * PACKED).bitwiseOR(put("he", PACKED)).bitwiseOR(F.col("wb"))
    return [first.alias("r1"), put("st", PACKED).bitwiseOR(F.col("amb")).alias("r2")]


def rhythms_of(texts: DataFrame, text_id: str = "doc_id", longest: int = LONGEST, shortest: int = 2) -> DataFrame:
    """n, he, wb, st, amb: the rhythms that `rhythms` tells of `tokens.line_parts`, each once for some texts that are read together.

    A text's words are found and told in one go, and only rhythms new among the
    texts at hand leave Python: repeated ones are left to a `distinct`. Up to
    PACKED syllables.
    """
    if longest > PACKED:
        raise ValueError(f"a packed rhythm has at most {PACKED} syllables")

    def tell(ids: pa.Array, found: tuple[np.ndarray, ...]) -> list:
        first, second = _pack(*found[3:])
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return [pa.array(first[fresh]), pa.array(second[fresh])]

    rows = _told_of(texts, text_id, tell, "r1 long, r2 long", longest, shortest)
    return rows.select(*unpacked("r1", "r2"))


def neighbours_of(texts: DataFrame, text_id: str = "doc_id", longest: int = LONGEST, shortest: int = 2) -> DataFrame:
    """text_id, line_num, linepart (the first part), a1, a2, b1, b2: every two neighbouring parts of a line, their rhythms packed (see `unpacked`)."""
    if longest > PACKED:
        raise ValueError(f"a packed rhythm has at most {PACKED} syllables")

    def tell(ids: pa.Array, found: tuple[np.ndarray, ...]) -> list:
        text, line, part, *rhythm = found
        at = np.flatnonzero((text[1:] == text[:-1]) & (line[1:] == line[:-1]) & (part[1:] == part[:-1] + 1))
        packed = _pack(*rhythm)
        return [
            ids.take(pa.array(text[at])), pa.array(line[at].astype(np.int32)), pa.array(part[at].astype(np.int32)),
            *(pa.array(x[at + k]) for k in (0, 1) for x in packed),
        ]

    kind = dict(texts.dtypes)[text_id]
    return _told_of(texts, text_id, tell, f"text_id {kind}, line_num int, linepart int, a1 long, a2 long, b1 long, b2 long", longest, shortest)


def variants(rows: DataFrame) -> DataFrame:
    """Rows with n, he, wb, st and amb -> variant, n and the masks: one row per distinct variant.

    Variants are aligned: variant 1 takes the second form of every ambiguous word.
    """
    keys = [c for c in rows.columns if c not in ("n", "he", "wb", "st", "amb")]
    two = F.when(F.col("amb") != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("variant", F.explode(two))
    return masked(out.withColumn("st", F.when(F.col("variant") == 1, F.col("st").bitwiseOR(F.col("amb"))).otherwise(F.col("st"))), [*keys, "variant"])


def masked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(n, st, he, wb) -> keys, n and all masks: neighbours belong to one word unless the later one begins a word."""
    one = F.lit(1).cast("long")
    full = _full(F.col("n"))
    inside = full.bitwiseAND(F.bitwise_not("wb"))
    un = full.bitwiseAND(F.bitwise_not("st"))
    beside = lambda m: F.shiftleft(m, 1).bitwiseAND(inside).bitwiseOR(F.shiftright(m.bitwiseAND(inside), 1))
    alone = F.col("wb").bitwiseAND(F.shiftright(F.col("wb").bitwiseOR(_shift(one, F.col("n"))), 1))
    return rows.select(
        *keys,
        "n",
        "st",
        "he",
        F.col("st").bitwiseAND(beside(un)).alias("sg"),
        un.bitwiseAND(beside(F.col("st"))).alias("wk"),
        alone.bitwiseAND(un).alias("fn"),
        "wb",
    )


def encoded(units: DataFrame, longest: int = LONGEST, shortest: int = 2) -> DataFrame:
    """Adds variant, n and the masks to units with `words`: one row per distinct variant of shortest..longest syllables."""
    return variants(rhythms(units, longest, shortest))


def with_phrasal(units: DataFrame, stress: str = "phrasal_stress") -> DataFrame:
    """Units with `words` and an array of their words' phrasal stress -> adds ph_hi and ph_lo, the syllables of prominent and demoted words.

    A word of phrasal stress -1 or more (or none) is prominent, one of -2 or less
    demoted; where no word of a unit has a stress but 0, nothing is either.
    """
    level = F.transform(stress, lambda p: F.coalesce(p, F.lit(0)))
    n = F.transform("words", lambda w: F.regexp_count(F.lower(w), F.lit(f"[{ortho.VOWELS}]+")))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("at"), zero.alias("hi"), zero.alias("lo"))

    def add(a: Column, w: Column) -> Column:
        bits = _shift(_full(w["n"]), a["at"])
        some = lambda test, m: m.bitwiseOR(F.when(test, bits).otherwise(zero))
        return F.struct((a["at"] + w["n"]).alias("at"), some(w["p"] >= -1, a["hi"]).alias("hi"), some(w["p"] <= -2, a["lo"]).alias("lo"))

    pairs = F.zip_with(n, level, lambda k, p: F.struct(k.alias("n"), p.alias("p")))
    found = F.when(F.exists(level, lambda p: p != 0), F.aggregate(pairs, start, add)).otherwise(start)
    return units.withColumn("ph", found).select(*units.columns, F.col("ph.hi").alias("ph_hi"), F.col("ph.lo").alias("ph_lo"))


def product_variants(units: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Every combination of word forms (a full product) of every unit of 2 to `longest` syllables.

    Returns the unit's columns, variant (bit k is the form of the k-th ambiguous
    word) and the masks. A unit has at most 2**longest variants; they are made
    from `parts` (a number in 0..2**k - 1 for units of over eight ambiguous
    words), so that one row never expands into more than 256 at once.
    """
    keys = units.columns
    rows = rhythms(units, longest).withColumn("k", F.bit_count("amb").cast("int"))
    low, high = F.least(F.col("k"), F.lit(8)), F.greatest(F.col("k") - 8, F.lit(0))
    upto = lambda bits: F.sequence(F.lit(0), _shift(F.lit(1), bits).cast("int") - 1)
    rows = rows.withColumn("high", F.explode(upto(high))).withColumn("low", F.explode(upto(low)))
    rows = rows.withColumn("variant", F.col("low").bitwiseOR(_shift(F.col("high"), F.lit(8)).cast("int")))
    # Deal the variant's bits to the places of the ambiguous syllables, lowest first.
    zero = F.lit(0).cast("long")
    step = lambda a, i: F.struct(
        a["m"].bitwiseOR(_shift(_bit(a["v"], F.lit(0)).bitwiseAND(_bit(F.col("amb"), i)), i)).alias("m"),
        F.when(_bit(F.col("amb"), i) == 1, F.shiftright(a["v"], 1)).otherwise(a["v"]).alias("v"),
    )
    start = F.struct(zero.alias("m"), F.col("variant").cast("long").alias("v"))
    dealt = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, step)["m"]
    return masked(rows.withColumn("st", F.col("st").bitwiseOR(dealt)), [*keys, "variant"])


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at.cast("int")).bitwiseAND(F.lit(1).cast("long"))
