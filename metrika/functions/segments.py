"""IPA segments with diacritics, their 24 features, sonority and syllables, in built-in functions alone.

A segment is the longest known base with the marks around it; marks overlay the
base's features, so a base and a mark that no table lists together have features
too. Everything is an expression on a string column.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import phonology as P

FEATURES = [*P.FEATURES, "hitone", "hireg"]
# What the marks after and before a base do to its features.
AFTER = {
    "ʼ": "cg+", "̥": "voi-", "ʰ": "sg+", "̟": "", "̠": "", "̈": "", "̩": "syl+", "̯": "syl-",
    "˞": "ant- hi+ round+", "̤": "sg+", "̰": "cg+", "ˀ": "cg+", "̼": "lab+", "ʷ": "round+ back+ hi+", "ʲ": "hi+ back-",
    "ᶣ": "hi+ back- round+", "ˠ": "hi+ back+", "ˤ": "lo+ back+", "̴": "hi+ back+", "̝": "", "̞": "", "̘": "tense+",
    "̙": "tense-", "̺": "distr-", "̻": "distr+", "̃": "nas+", "ⁿ": "nas+", "ˡ": "lat+ delrel+", "ː": "long+", "̆": "long-",
}
BEFORE = {"ˀ": "cg+"}
STRESS = "ˈˌ'`"

_BASES = sorted((k for k in P.inventory() if P.LENGTH not in k), key=lambda k: (-len(k), k))
#: The marks before, the base and the marks after it.
SEGMENT = f"([{''.join(BEFORE)}]*)({'|'.join(_BASES)})([{''.join(AFTER)}]*)"
PHONE = f"[{STRESS}]?{SEGMENT}"
VOWELS = f"[{''.join(P.VOWELS)}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(values: dict[str, list[int | None]]) -> Column:
    """A map of arrays of small numbers, written as SQL so that it is folded into one literal."""
    numbers = lambda v: ", ".join("CAST(NULL AS INT)" if x is None else str(x) for x in v)
    return F.expr("map(" + ", ".join(f"'{k}', array({numbers(v)})" for k, v in values.items()) + ")")


def decompositions(last: int = 0x1FFF) -> dict[str, str]:
    """Characters up to `last` that are a base and combining marks, in full."""
    found = ((chr(k), unicodedata.normalize("NFD", chr(k))) for k in range(0xC0, last + 1))
    return {c: d for c, d in found if d != c}


@lru_cache(maxsize=1)
def _pairs() -> tuple[str, str, str]:
    """Characters with their first and second half, in the order of the code points; a half may come apart once more."""
    halves = {c: unicodedata.decomposition(c).split() for c in decompositions()}
    pairs = {c: h for c, h in halves.items() if len(h) == 2 and "<" not in h[0]}
    return "".join(pairs), *("".join(chr(int(h[k], 16)) for h in pairs.values()) for k in (0, 1))


def decomposed(text: Column) -> Column:
    """Characters of the Latin, Greek and Cyrillic blocks as base and combining marks."""
    whole, base, mark = _pairs()
    cut = lambda c: F.concat(F.translate(c, whole, base), F.when(F.contains(F.lit(whole), c) & (c != ""), F.translate(c, whole, mark)).otherwise(""))
    for _ in range(3):  # no character has more than three marks
        text = F.when(text.rlike("[\u00c0-\u1fff]"), F.array_join(F.transform(F.split(text, ""), cut), "")).otherwise(text)
    return text


def segments(ipa: Column) -> Column:
    """The segments from left to right, the longest known base first; what is no segment is left out."""
    return F.regexp_extract_all(decomposed(ipa), F.lit(SEGMENT), F.lit(0))


def is_known(ipa: Column) -> Column:
    """Whether segments and stress marks cover the text."""
    return F.regexp_replace(decomposed(ipa), PHONE, "") == ""


def _overlay(text: str) -> list[int | None]:
    sets = {x[:-1]: 1 if x[-1] == "+" else -1 for x in text.split()}
    return [sets.get(f) for f in FEATURES]


def features(segment: Column) -> Column:
    """The 24 features of a segment (-1, 0, 1), the marks' own over the base's; null for what is no segment."""
    bases = _constant({k: [*P.inventory()[k], 0, 0] for k in _BASES})
    marks = _constant({k: _overlay(v) for k, v in (AFTER | BEFORE).items()})
    part = lambda k: F.regexp_extract(segment, f"^{SEGMENT}$", k)
    # Marks in front go from the base outwards, those behind in their order.
    order = F.filter(F.concat(F.reverse(F.split(part(1), "")), F.split(part(3), "")), lambda m: m != "")
    own = lambda done, m: F.zip_with(done, F.element_at(marks, m), lambda a, b: F.coalesce(b, a))
    return F.aggregate(order, F.try_element_at(bases, part(2)), own)


def sonority(vector: Column) -> Column:
    """1 (voiceless stops) to 9 (vowels that are not high) from the features."""

    def level(v: Column) -> Column:
        f = {k: F.element_at(v, FEATURES.index(k) + 1) for k in ("syl", "hi", "cons", "son", "nas", "cont", "voi")}
        return (
            F.when((f["syl"] > 0) & (f["hi"] < 0), 9).when(f["syl"] > 0, 8).when(f["cons"] < 0, 7)
            .when((f["son"] > 0) & (f["nas"] < 0), 6).when(f["son"] > 0, 5)
            .when((f["cont"] > 0) & (f["voi"] > 0), 4).when(f["cont"] > 0, 3).when(f["voi"] > 0, 2).otherwise(1)
        )

    return let(vector, level)


def _level(phone: Column) -> Column:
    """Sonority in the classes of syllabification: vowels are one class, and so are all obstruents."""
    found = sonority(features(F.regexp_replace(phone, f"^[{STRESS}]", "")))
    return let(found, lambda s: F.when(s >= 8, 9).when(s <= 4, 4).otherwise(s))


def begins(level: Column) -> Column:
    """For every place whether a syllable may begin there, from the sonority levels.

    Not where sonority rises (1), nor where it has fallen and doesn't rise next
    (2a) or the word ends (2b), nor within three equal ones (3; at the second
    place the one before the first is the last).
    """

    def whole(levels: Column) -> Column:
        n = F.size(levels)
        at = lambda k: F.get(levels, k)

        def one(s: Column, i: Column) -> Column:
            last, earlier = at(i - 1), at(F.when(i == 1, n - 1).otherwise(i - 2))
            falls = (last > s) & ((i == n - 1) | (s >= at(i + 1)))
            return (i == 0) | ~((last < s) | F.coalesce(falls, F.lit(False)) | ((earlier == last) & (last == s)))

        return F.transform(levels, one)

    return let(level, whole)


def syllables(ipa: Column) -> Column:
    """IPA syllables by sonority, each with at most one stress mark (' or `) in front.

    Pieces without a vowel join the next one that has one, at the end the last;
    nothing if there is no vowel; null for null.
    """

    def cut(phones: Column) -> Column:
        starts = begins(F.transform(phones, _level))
        marked = F.zip_with(phones, starts, lambda p, s: F.concat(F.when(s, "\u0001").otherwise(""), p))
        pieces = F.split(F.regexp_replace(F.array_join(marked, ""), "^\u0001", ""), "\u0001")
        # A cut stays after a piece with a vowel if another one follows: from the left, every vowel-less run goes to what comes after it.
        joined = F.array_join(F.transform(pieces, lambda p: F.concat(p, F.when(p.rlike(VOWELS), "\u0001").otherwise(""))), "")
        return F.regexp_replace(joined, "\u0001([^\u0001]*)$", "$1")

    def dressed(s: Column) -> Column:
        mark = F.when(s.contains("ˌ") | s.contains("`"), "`").when(s.contains("ˈ") | s.contains("'"), "'").otherwise("")
        return F.concat(mark, F.regexp_replace(s, f"[{STRESS}]", ""))

    whole = let(F.regexp_extract_all(decomposed(ipa), F.lit(PHONE), F.lit(0)), cut)
    found = let(whole, lambda w: F.when(w.rlike(VOWELS), F.transform(F.split(w, "\u0001"), dressed)).otherwise(F.array().cast("array<string>")))
    return F.when(ipa.isNotNull(), found)


def rime_distance(a: Column, b: Column) -> Column:
    """Feature edit distance of two rimes over the longer one's segments, 0 for equal texts and 1 if either has no segment.

    A substitution costs the mean difference of the features (0 to 2), deletion
    and insertion cost 1. Null if either is null.
    """


    def cost(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d) / F.lit(len(FEATURES))

    def aligned(both: Column) -> Column:
        u, v = both["u"], both["v"]
        m = F.size(v)

        def next_row(row: Column, x: Column) -> Column:
            def cell(new: Column, j: Column) -> Column:
                left, up, across = F.get(new, j - 1) + 1, F.get(row, j) + 1, F.get(row, j - 1) + cost(x, F.get(v, j - 1))
                return F.concat(new, F.array(F.least(left, up, across)))

            return F.aggregate(F.sequence(F.lit(1), m), F.array(F.get(row, F.lit(0)) + 1), cell)

        first = F.transform(F.sequence(F.lit(0), m), lambda j: j.cast("double"))
        found = F.get(F.aggregate(u, first, next_row), m) / F.greatest(F.size(u), m)
        return F.when((F.size(u) == 0) | (m == 0), F.lit(1.0)).otherwise(found)

    read = lambda x: F.transform(segments(x), features)
    far = let(F.struct(read(a).alias("u"), read(b).alias("v")), aligned)
    return F.when(a == b, F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), far)


def written_features(ipa: Column) -> Column:
    """The features of a text's segments as one string, a sign a feature: 0 for -1, 1 for 0, 2 for 1."""
    signs = F.transform(segments(ipa), lambda s: F.array_join(F.transform(features(s), lambda f: (f + 1).cast("string")), ""))
    return F.array_join(signs, "")


def _aligned(left: pa.Array, right: pa.Array) -> pa.Array:
    """Feature edit distances over the longer one's segments; pairs of equal lengths are aligned together."""
    out = np.full(len(left), np.nan)
    a, b = (np.asarray(x.to_pylist(), object) for x in (left, right))
    able = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
    m, n = (pc.fill_null(pc.binary_length(x), 0).to_numpy().astype(np.int64) // len(FEATURES) for x in (left, right))
    sizes, kind = np.unique(np.stack([m, n], 1), axis=0, return_inverse=True)
    order = np.argsort(np.where(able, kind.ravel(), len(sizes)), kind="stable")
    ends = np.cumsum(np.bincount(kind.ravel()[able], minlength=len(sizes)))
    for (p, q), which in zip(sizes, np.split(order, ends)[: len(sizes)], strict=True):
        if p == 0 or q == 0:
            out[which] = 1.0
            continue
        for first in range(0, len(which), 4096):
            part = which[first : first + 4096]
            u, v = (np.frombuffer("".join(x[part]).encode(), np.int8).reshape(len(part), k, len(FEATURES)) for x, k in ((a, p), (b, q)))
            row = [np.full(len(part), float(j)) for j in range(q + 1)]
            for i in range(p):
                cost = np.abs(u[:, i, None, :] - v).sum(axis=2) / len(FEATURES)
                new = [row[0] + 1]
                for j in range(1, q + 1):
                    new.append(np.minimum(np.minimum(new[j - 1] + 1, row[j] + 1), row[j - 1] + cost[:, j - 1]))
                row = new
            out[part] = row[q] / max(p, q)
    return pa.array(out, mask=~able)


#: The distance of `rime_distance` between two texts' written features, a batch of pairs at a time; null if either is null.
written_distance = F.arrow_udf(_aligned, DoubleType())
