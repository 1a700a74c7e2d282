"""IPA segments, features, sonority, syllabification and distances.

The segment inventory is made by rule from articulatory descriptions: 22 ternary
features (-1, 0, +1) by name. It is a bounded dimension (about 70 rows) that a
caller can replace by any table (ipa, feats). Sequence rules run as Arrow
functions over distinct words or pairs; features of single segments are joins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the features in order.
FEATURES = [
    "syl", "son", "cons", "cont", "delrel", "lat", "nas", "strid", "voi", "sg", "cg", "ant", "cor", "distr", "lab",
    "hi", "lo", "back", "round", "velaric", "tense", "long",
]
RIME_FEATURES = ["hi", "lo", "back", "round", "tense", "long", "son", "cons", "nas", "voi"]
# Consonants as place, manner, voice.
CONSONANTS = {
    "p": "labial stop -", "b": "labial stop +", "t": "alveolar stop -", "d": "alveolar stop +", "k": "velar stop -",
    "g": "velar stop +", "ɡ": "velar stop +", "q": "uvular stop -", "ʔ": "glottal stop -", "m": "labial nasal +",
    "n": "alveolar nasal +", "ɲ": "palatal nasal +", "ŋ": "velar nasal +", "f": "labiodental fricative -",
    "v": "labiodental fricative +", "θ": "dental fricative -", "ð": "dental fricative +", "s": "alveolar sibilant -",
    "z": "alveolar sibilant +", "ʃ": "postalveolar sibilant -", "ʒ": "postalveolar sibilant +", "x": "velar fricative -",
    "ç": "palatal fricative -", "ɣ": "velar fricative +", "χ": "uvular fricative -", "ʁ": "uvular fricative +",
    "h": "glottal fricative -", "ts": "alveolar affricate -", "dz": "alveolar affricate +", "tʃ": "postalveolar affricate -",
    "dʒ": "postalveolar affricate +", "l": "alveolar lateral +", "ʎ": "palatal lateral +", "r": "alveolar trill +",
    "ɾ": "alveolar tap +", "ɹ": "alveolar approximant +", "j": "palatal glide +", "w": "labiovelar glide +",
    "ʋ": "labiodental approximant +",
}
# Vowels as height, backness, rounding, tenseness.
VOWELS = {
    "i": "hi front - +", "y": "hi front + +", "u": "hi back + +", "ɯ": "hi back - +", "ɪ": "hi front - -",
    "ʏ": "hi front + -", "ʊ": "hi back + -", "e": "mid front - +", "ø": "mid front + +", "o": "mid back + +",
    "ɛ": "mid front - -", "œ": "mid front + -", "ɔ": "mid back + -", "ʌ": "mid back - -", "ə": "mid central - -",
    "ɜ": "mid central - +", "æ": "lo front - -", "a": "lo front - +", "ɑ": "lo back - +", "ɒ": "lo back + -",
    "ɐ": "lo central - -",
}
# X-SAMPA symbols whose IPA sign differs.
XSAMPA = {
    "dZ": "dʒ", "tS": "tʃ", "@": "ə", "A": "ɑ", "E": "ɛ", "I": "ɪ", "O": "ɔ", "U": "ʊ", "V": "ʌ", "Q": "ɒ", "{": "æ",
    "2": "ø", "9": "œ", "3": "ɜ", "6": "ɐ", "N": "ŋ", "J": "ɲ", "S": "ʃ", "Z": "ʒ", "T": "θ", "D": "ð", "R": "ʁ",
    "G": "ɣ", "X": "χ", "?": "ʔ", "L": "ʎ", "4": "ɾ", "M": "ɯ", ":": "ː", '"': "'", "%": "`",
}
# Consonant classes of the collapsed comparison.
CLASSES = {"P": "pbfvʋ", "T": "tdθð", "S": "szʃʒ", "K": "kgɡqxɣχç", "M": "m", "N": "nɲŋ", "R": "rɾɹlʎʁ", "W": "w", "J": "j", "H": "hʔ"}
LENGTH = "ː"


def _consonant(text: str) -> dict[str, int]:
    place, manner, voice = text.split()
    sonorant = manner in ("nasal", "lateral", "trill", "tap", "approximant", "glide")
    coronal = place in ("dental", "alveolar", "postalveolar", "palatal")
    return {
        "syl": -1, "son": 1 if sonorant else -1,
        "cons": -1 if manner == "glide" or manner == "approximant" or (place == "glottal" and manner == "stop") else 1,
        "cont": -1 if manner in ("stop", "nasal", "affricate") else 1,
        "delrel": 1 if manner == "affricate" else -1, "lat": 1 if manner == "lateral" else -1, "nas": 1 if manner == "nasal" else -1,
        "strid": 1 if manner == "sibilant" or manner == "affricate" or place == "labiodental" else -1,
        "voi": 1 if voice == "+" else -1, "sg": 1 if place == "glottal" and manner == "fricative" else -1,
        "cg": 1 if place == "glottal" and manner == "stop" else -1,
        "ant": (1 if place in ("labial", "labiodental", "dental", "alveolar") else -1), "cor": 1 if coronal and place != "palatal" else -1,
        "distr": (1 if place in ("dental", "postalveolar") else -1) if coronal else 0,
        "lab": 1 if place.startswith("labi") else -1, "hi": 1 if place in ("palatal", "velar", "labiovelar") else -1,
        "lo": -1, "back": 1 if place in ("velar", "uvular", "labiovelar") else -1, "round": 1 if place == "labiovelar" else -1,
        "velaric": -1, "tense": 0, "long": -1,
    }


def _vowel(text: str) -> dict[str, int]:
    height, depth, rounded, tense = text.split()
    return {
        "syl": 1, "son": 1, "cons": -1, "cont": 1, "delrel": -1, "lat": -1, "nas": -1, "strid": 0, "voi": 1, "sg": -1, "cg": -1,
        "ant": 0, "cor": -1, "distr": 0, "lab": 1 if rounded == "+" else -1, "hi": 1 if height == "hi" else -1,
        "lo": 1 if height == "lo" else -1, "back": -1 if depth == "front" else 1, "round": 1 if rounded == "+" else -1,
        "velaric": -1, "tense": 1 if tense == "+" else -1, "long": -1,
    }


@lru_cache(maxsize=1)
def inventory() -> dict[str, tuple[int, ...]]:
    """Feature vectors by segment; vowels also long."""
    out = {k: _consonant(v) for k, v in CONSONANTS.items()} | {k: _vowel(v) for k, v in VOWELS.items()}
    out |= {k + LENGTH: _vowel(v) | {"long": 1} for k, v in VOWELS.items()}
    return {unicodedata.normalize("NFD", k): tuple(v[f] for f in FEATURES) for k, v in out.items()}


def segments_table(spark: SparkSession) -> DataFrame:
    """ipa and one tinyint column per feature."""
    rows = [(k, *v) for k, v in sorted(inventory().items())]
    return spark.createDataFrame(rows, "ipa string, " + ", ".join(f"{f} int" for f in FEATURES))


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    return re.compile("|".join(sorted(map(re.escape, inventory()), key=len, reverse=True)))


def segment(word: str) -> list[str]:
    """Longest known segments from left to right; unknown characters are skipped."""
    return _pattern().findall(unicodedata.normalize("NFD", word))


def is_known(word: str) -> bool:
    """Whether known segments cover the word but for stress marks."""
    plain = re.sub("['`]", "", unicodedata.normalize("NFD", word))
    return "".join(segment(plain)) == plain


def sonority_of(v: tuple[int, ...]) -> int:
    """1 (stops) to 9 (low vowels) by a decision over features."""
    f = dict(zip(FEATURES, v, strict=True))
    if f["syl"] > 0:
        return 8 if f["hi"] > 0 else 9
    if f["cons"] < 0:
        return 7 if f["hi"] > 0 or f["son"] > 0 else 1
    if f["son"] > 0:
        return 5 if f["nas"] > 0 else 6
    if f["cont"] > 0:
        return 4 if f["voi"] > 0 else 3
    return 2 if f["voi"] > 0 else 1


def sonority(syl: Column, hi: Column, cons: Column, son: Column, nas: Column, cont: Column, voi: Column) -> Column:
    """The same decision over feature columns."""
    return (
        F.when((syl > 0) & (hi > 0), 8).when(syl > 0, 9)
        .when((cons < 0) & ((hi > 0) | (son > 0)), 7).when(cons < 0, 1)
        .when((son > 0) & (nas > 0), 5).when(son > 0, 6)
        .when((cont > 0) & (voi > 0), 4).when(cont > 0, 3)
        .when(voi > 0, 2).otherwise(1)
    )


def syllabify(word: str) -> list[str]:
    """IPA syllables: a boundary before the consonant of least sonority between two nuclei; pieces without a vowel join their neighbour."""
    found = segment(word)
    levels = [sonority_of(inventory()[s]) for s in found]
    nuclei = [k for k, v in enumerate(levels) if v >= 8]
    # Adjacent vowels of rising-falling sonority form one nucleus only if the second is high (a diphthong).
    starts = [k for i, k in enumerate(nuclei) if not (i and nuclei[i - 1] == k - 1 and levels[k] == 8 and levels[k - 1] == 9)]
    cuts = []
    for a, b in zip(starts, starts[1:], strict=False):
        between = [k for k in range(a + 1, b) if levels[k] < 8]
        cuts.append(min(between, key=lambda k: (levels[k], -k)) if between else b)
    edges = [0, *cuts, len(found)]
    return ["".join(found[i:j]) for i, j in zip(edges, edges[1:], strict=False) if j > i]


def orthographic_syllables(word: str, count: int | None = None) -> list[str]:
    """Spelling cut into syllables; with `count`, the last is halved or the tail joined until there are as many."""
    from .ortho import CHUNK

    out = re.findall(CHUNK, word.lower()) or [word.lower()]
    cased, at = [], 0
    for part in out:
        cased.append(word[at : at + len(part)])
        at += len(part)
    while count and len(cased) < count:
        last = cased.pop()
        half = max(1, len(last) // 2)
        cased += [last[:half], last[half:]]
    if count and len(cased) > count:
        cased = [*cased[: count - 1], "".join(cased[count - 1 :])]
    return cased


def parts(syllable: str) -> tuple[str, str, str]:
    """Onset, nucleus and coda, split at the first and last vowel."""
    found = segment(syllable)
    vowels = [k for k, s in enumerate(found) if inventory()[s][0] > 0]
    if not vowels:
        return "".join(found), "", ""
    a, b = vowels[0], vowels[-1] + 1
    return "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])


def complexity(word: list[str]) -> dict[str, int]:
    """Counts of onsetless syllables, complex onsets, codas and complex codas."""
    cut = [parts(s) for s in word]
    many = lambda x: len(segment(x)) > 1
    return {
        "onsetless": sum(not o for o, _, _ in cut), "complex_onsets": sum(many(o) for o, _, _ in cut),
        "codas": sum(bool(c) for _, _, c in cut), "complex_codas": sum(many(c) for _, _, c in cut),
    }


# ---- distances ----


def min_edit(a: list, b: list, delete, insert, substitute) -> float:
    """Weighted edit distance by dynamic programming."""
    row = [0.0]
    for y in b:
        row.append(row[-1] + insert(y))
    for x in a:
        new = [row[0] + delete(x)]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + delete(x), new[j] + insert(y), row[j] + substitute(x, y)))
        row = new
    return row[-1]


def _unweighted():
    n = len(FEATURES)
    edge = lambda v: sum(0.5 if x == 0 else 1.0 for x in v) / n
    return edge, edge, lambda u, v: sum(abs(x - y) for x, y in zip(u, v, strict=True)) / 2 / n


def _hamming():
    n = len(FEATURES)
    edge = lambda v: sum(0.5 if x == 0 else 1.0 for x in v) / n
    return edge, edge, lambda u, v: sum(x != y for x, y in zip(u, v, strict=True)) / n


def _partial():
    n = len(FEATURES)
    edge = lambda v: sum(0.5 if x == 0 else 1.0 for x in v) / n
    one = lambda x, y: 0.0 if x == y else (0.5 if 0 in (x, y) else 1.0)
    return edge, edge, lambda u, v: sum(one(x, y) for x, y in zip(u, v, strict=True)) / n


def weighted(weights: dict[str, float]):
    """Costs with weights joined by feature name (missing: 1)."""
    w = [weights.get(f, 1.0) for f in FEATURES]
    total = sum(w)
    edge = lambda v: total  # noqa: E731, ARG005
    return edge, edge, lambda u, v: sum(abs(x - y) * k for x, y, k in zip(u, v, w, strict=True))


COSTS = {"unweighted": _unweighted, "hamming": _hamming, "partial_hamming": _partial}


def feature_edit(a: str, b: str, cost: str = "unweighted", scale: float = 1.0, relative: bool = False, weights: dict[str, float] | None = None) -> float:
    """Feature edit distance of two IPA words; `scale` multiplies deletions and insertions (0.25: jt), relative divides by the longer."""
    delete, insert, substitute = weighted(weights or {}) if cost == "weighted" else COSTS[cost]()
    u, v = ([inventory()[s] for s in segment(x)] for x in (a, b))
    found = min_edit(u, v, lambda x: scale * delete(x), lambda x: scale * insert(x), substitute)
    return found / max(len(u), len(v)) if relative and (u or v) else found


def rime_distance(a: str, b: str) -> float:
    """Rime distance: substitution by the mean feature difference (0 to 2), deletion and insertion 1, over the longer length."""
    u, v = ([inventory()[s] for s in segment(x)] for x in (a, b))
    if a == b:
        return 0.0
    if not u or not v:
        return 1.0
    far = lambda x, y: sum(abs(p - q) for p, q in zip(x, y, strict=True)) / len(x)
    return min_edit(u, v, lambda x: 1.0, lambda y: 1.0, far) / max(len(u), len(v))  # noqa: ARG005


def distances(pairs: DataFrame, kind: str = "rime", **options) -> DataFrame:
    """(a, b) -> a, b, dist over distinct pairs: an Arrow function."""

    @F.pandas_udf("double")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        one = rime_distance if kind == "rime" else lambda x, y: feature_edit(x, y, **options)
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.select("a", "b").distinct().withColumn("dist", found("a", "b"))


def error_rate(hypotheses: list[str], references: list[str]) -> float:
    """Segment edits over reference segments; no references give 0."""
    one = lambda *x: 1.0  # noqa: E731, ARG005
    pairs = [(segment(h), segment(r)) for h, r in zip(hypotheses, references, strict=True)]
    total = sum(len(r) for _, r in pairs)
    return sum(min_edit(h, r, one, one, lambda x, y: float(x != y)) for h, r in pairs) / total if total else 0.0


def feature_error_rate(hypotheses: list[str], references: list[str]) -> float:
    total = sum(len(segment(r)) for r in references)
    return sum(feature_edit(h, r) for h, r in zip(hypotheses, references, strict=True)) / total if total else 0.0


def from_xsampa(text: str) -> str:
    """X-SAMPA as IPA, longest symbols first."""
    return re.sub("|".join(sorted(map(re.escape, XSAMPA), key=len, reverse=True)), lambda m: XSAMPA[m[0]], text)


def collapsed(text: str) -> str:
    """Consonants by class and vowels as V."""
    table = {c: k for k, chars in CLASSES.items() for c in chars} | dict.fromkeys((v for v in VOWELS), "V")
    return "".join(table.get(c, "") for c in unicodedata.normalize("NFD", text))


# ---- segment algebra over feature columns ----


def matches(mask: dict[str, int], prefix: str = "") -> Column:
    """Whether a segment has every feature of the mask."""
    out = F.lit(True)
    for k, v in mask.items():
        out &= F.col(f"{prefix}{k}") == v
    return out


def differing(a: str, b: str) -> Column:
    """The names of the features in which segments a.* and b.* differ."""
    return F.array_compact(F.array(*(F.when(F.col(f"{a}.{f}") != F.col(f"{b}.{f}"), F.lit(f)) for f in FEATURES)))


def segment_distances(table: DataFrame) -> DataFrame:
    """All pairs of a bounded inventory: differing features, summed and normalised difference, Hamming distance, contrast."""
    a, b = table.alias("a"), table.alias("b")
    size = sum((F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) for f in FEATURES[1:]), F.abs(F.col("a.syl") - F.col("b.syl")))
    diff = differing("a", "b")
    return a.join(F.broadcast(b), F.col("a.ipa") < F.col("b.ipa")).select(
        F.col("a.ipa").alias("a"), F.col("b.ipa").alias("b"), size.cast("int").alias("distance"), F.round(size / len(FEATURES), 6).alias("norm_distance"),
        F.size(diff).alias("hamming"), (F.size(diff) == 1).alias("contrast"), F.array_join(diff, " ").alias("differing"),
    )


def nearest(vector: list[int], table: DataFrame) -> DataFrame:
    """The segments closest to a feature vector, the shortest sign first: equality or the least difference (not a search probe)."""
    size = sum((F.abs(F.col(f) - v) for f, v in zip(FEATURES[1:], vector[1:], strict=True)), F.abs(F.col("syl") - vector[0]))
    return table.select("ipa", size.cast("int").alias("distance")).orderBy("distance", F.length("ipa"), "ipa").limit(1)


def mean_profile(words: DataFrame, table: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(word_id, ipa array of segments) -> the mean of each feature by word."""
    rows = words.select("word_id", F.explode("segments").alias("ipa")).join(F.broadcast(table), "ipa")
    return rows.groupBy("word_id").agg(*(F.round(F.avg(f), 6).alias(f) for f in features))


def syllabified(words: DataFrame) -> DataFrame:
    """(ipa) -> ipa, sylls over distinct words: an Arrow function."""

    @F.pandas_udf("array<string>")
    def found(ipa: pd.Series) -> pd.Series:
        return ipa.map(syllabify)

    return words.select("ipa").distinct().withColumn("sylls", found("ipa"))


def euclidean(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum()))
