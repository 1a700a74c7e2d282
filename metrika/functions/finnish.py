"""Finnish by rule: syllables, weight, stress and IPA, over distinct words.

Restates the textbook rules: a syllable begins before each consonant-vowel
sequence, vowels that form neither a long vowel nor a diphthong separate;
weight is light (CV), heavy (CVC) or superheavy (a long nucleus); primary stress
is initial, secondary stress falls on every second syllable from the third but
moves one on where the next is heavier, and not on a final light syllable.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouyäöå"
# The diphthongs, and letters whose IPA sign differs.
DIPHTHONGS = ["ai", "ei", "oi", "ui", "yi", "äi", "öi", "au", "eu", "iu", "ou", "ey", "iy", "äy", "öy", "ie", "uo", "yö"]
IPA = {"ä": "æ", "ö": "ø", "å": "o", "a": "ɑ", "u": "ʊ", "š": "ʃ", "ž": "ʒ", "c": "k", "q": "k", "w": "v", "x": "z"}
SUFFIXES = ["kin", "kaan", "kään", "han", "hän"]


def nuclei(vowels: str) -> list[str]:
    """A run of vowels cut into long vowels, diphthongs and single ones."""
    out, k = [], 0
    while k < len(vowels):
        pair = vowels[k : k + 2]
        two = len(pair) == 2 and (pair[0] == pair[1] or pair in DIPHTHONGS)
        out.append(pair if two else vowels[k])
        k += 1 + two
    return out


def syllables(word: str) -> list[str]:
    """The syllables of a simple word; -ien at its end separates (i.en)."""
    cut = re.findall(rf"[{VOWELS}]+|[^{VOWELS}]+", word.lower())
    pieces: list[str] = []
    for k, run in enumerate(cut):
        if run[0] in VOWELS:
            found = nuclei(run)
            if run.endswith("ie") and k == len(cut) - 2 and cut[-1] == "n" and pieces:
                found = [*nuclei(run[:-1]), "e"]
            for j, nucleus in enumerate(found):
                if j == 0 and pieces and pieces[-1].startswith("+"):
                    pieces[-1] = pieces[-1][1:] + nucleus
                else:
                    pieces.append(nucleus)
        elif k == len(cut) - 1 and pieces:
            pieces[-1] += run
        elif not pieces:
            pieces.append("+" + run)
        else:
            pieces[-1] += run[:-1]
            pieces.append("+" + run[-1])
    return [p.removeprefix("+") for p in pieces]


def weight(syllable: str) -> int:
    """0 light, 1 closed, 2 with a long nucleus."""
    vowel = re.search(rf"[{VOWELS}]+", syllable)
    if vowel and len(vowel[0]) > 1:
        return 2
    return 1 if vowel and vowel.end() < len(syllable) else 0


def stresses(weights: list[int]) -> list[list[str]]:
    """Variants of P, S and U by syllable; a final closed syllable in a stressable place is optional."""
    n = len(weights)
    if n == 1:
        return [["U" if weights[0] == 0 else "P"]]
    out = ["P"] + ["U"] * (n - 1)
    k = 2
    while k < n:
        if k + 1 < n and weights[k] == 0 and weights[k + 1] > 0 and k + 1 < n - 1:
            k += 1
        if k < n - 1 or weights[k] == 2:
            out[k] = "S"
        elif weights[k] == 1:
            return [out, [*out[:k], "S"]]
        k += 2
    return [out]


def compounds(word: str, first_parts: tuple[str, ...] = ()) -> list[str]:
    """Parts of a word: at hyphens, after known first parts, before clitics."""
    out = []
    for part in word.lower().split("-"):
        for head in sorted(first_parts, key=len, reverse=True):
            if part.startswith(head) and len(part) > len(head) + 2:
                out.append(head)
                part = part[len(head) :]  # noqa: PLW2901
                break
        tail = next((s for s in SUFFIXES if part.endswith(s) and len(part) > len(s) + 3), None)
        out += [part[: -len(tail)], tail] if tail else [part]
    return [p for p in out if p]


def ipa(syllable: str) -> str:
    """A syllable's letters as IPA; a doubled vowel is long."""
    out = "".join(IPA.get(c, c) for c in syllable.replace("nk", "ŋk").replace("ng", "ŋ"))
    return re.sub(r"([ɑeioyæø])\1", r"\1ː", out.replace("ʊʊ", "uː"))


def annotate(word: str, first_parts: tuple[str, ...] = ()) -> list[dict]:
    """All variants of a word: syllables, weights, stresses, ipa ('primary, `secondary) and the sonority tag of each nucleus."""
    parts = [syllables(p) for p in compounds(word, first_parts)]
    parts = [p for p in parts if any(c in VOWELS for s in p for c in s)]
    if not parts:
        return []
    flat = [s for p in parts for s in p]
    weights = [weight(s) for s in flat]
    marks = {"P": "'", "S": "`", "U": ""}
    out = []
    for choice in product(*(stresses([weight(s) for s in p]) for p in parts)):
        stress: list[str] = []
        for k, c in enumerate(choice):
            stress += c if k == 0 else ["S" if x == "P" else x for x in c]
        tags = [next((c.upper() for c in s if c in VOWELS), "") for s in flat]
        out.append({"syllables": flat, "weights": weights, "stresses": stress, "sonority": tags, "ipa": [marks[x] + ipa(s) for x, s in zip(stress, flat, strict=True)]})
    return out


def annotated(words: DataFrame, first_parts: tuple[str, ...] = ()) -> DataFrame:
    """(token) -> token, form_idx, sylls, ipa, stress, weight over distinct tokens: an Arrow function."""
    schema = "array<struct<sylls:string,ipa:string,stress:string,weight:string>>"

    @F.pandas_udf(schema)
    def found(tokens: pd.Series) -> pd.Series:
        def one(token: str) -> list[dict]:
            return [
                {"sylls": ".".join(v["syllables"]), "ipa": ".".join(v["ipa"]), "stress": "".join(v["stresses"]), "weight": "".join("LHS"[w] for w in v["weights"])}
                for v in annotate(token, first_parts)
            ]

        return tokens.map(one)

    return words.select("token").distinct().select("token", F.posexplode(found("token")).alias("form_idx", "f")).select("token", "form_idx", "f.*")
