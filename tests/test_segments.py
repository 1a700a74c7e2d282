"""Segments with marks, features and syllables against hand-made cases and a plain replay of the rules."""

import random

from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import segments as S


def one(spark, expression, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, ipa string")
    return [r.out for r in rows.select("k", expression(F.col("ipa")).alias("out")).orderBy("k").collect()]


def plain_syllables(word):
    """The rules on Python lists; `word` is a list of bases without marks."""
    def level(s):
        f = dict(zip(P.FEATURES, P.inventory()[s], strict=True))
        return 9 if f["syl"] > 0 else 7 if f["cons"] < 0 else (5 if f["nas"] > 0 else 6) if f["son"] > 0 else 4

    g = [level(s) for s in word]
    b = [True] * len(g)
    for i in range(1, len(g)):
        if g[i - 1] < g[i]:
            b[i] = False
        if g[i - 1] > g[i] and (i == len(g) - 1 or g[i] >= g[i + 1]):
            b[i] = False
        if g[i - 2] == g[i - 1] == g[i]:
            b[i] = False
    pieces = []
    for s, new in zip(word, b, strict=True):
        if new or not pieces:
            pieces.append("")
        pieces[-1] += s
    out, run = [], ""
    for p in pieces:
        run += p
        if any(v in p for v in P.VOWELS):
            out.append(run)
            run = ""
    if run and out:
        out[-1] += run
    return out


def test_segments_and_marks(spark):
    got = one(spark, S.segments, "tʰãː", "ˀb̥", "é", "çok", "t͡", "", None, "tʃ")
    assert got == [["tʰ", "ãː"], ["ˀb̥"], ["e"], ["ç", "o", "k"], ["t"], [], None, ["tʃ"]]
    assert one(spark, S.is_known, "ˈtʰa", "t%", "", None) == [True, False, True, None]


def test_features_of_unlisted_pairs(spark):
    found = one(spark, S.features, "tʷ", "t", "n̥", "ˀbˠ", "̃", "iː̃", "l̩̯", "l̯̩")
    f = [None if v is None else dict(zip(S.FEATURES, v, strict=True)) for v in found]
    assert len(S.FEATURES) == 24 and f[4] is None
    assert f[0] == f[1] | {"round": 1, "back": 1, "hi": 1} and f[2]["voi"] == -1 and f[2]["nas"] == 1
    assert (f[3]["cg"], f[3]["hi"], f[3]["back"], f[3]["voi"]) == (1, 1, 1, 1)
    assert (f[5]["long"], f[5]["nas"], f[5]["hi"]) == (1, 1, 1) and f[6]["syl"] == -1 and f[7]["syl"] == 1
    one_by_one = [one(spark, lambda c: S.sonority(S.features(c)), *"aiwlnzsbp")]
    assert one_by_one == [[9, 8, 7, 6, 5, 4, 3, 2, 1]]


def test_syllables(spark):
    words = ["dˈʌmiwˌʌmi", "ɹaɪpəɹ", "saɪəns", "", None, "pst", "strɪŋ", "ˈmʌðəɹ", "ŋŋŋ a"]
    got = one(spark, S.syllables, *words)
    assert got[0] == ["'dʌ", "mi", "`wʌ", "mi"] and got[3:6] == [[], None, []]
    assert got[6] == ["strɪŋ"] and got[7] == ["'mʌ", "ðəɹ"]
    rng = random.Random(0)
    bases = [b for b in P.inventory() if len(b) == 1]
    made = [[rng.choice(bases) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    # Neighbours that would be read as one base are left out.
    made = [w for w in made if P.segment("".join(w)) == w]
    assert one(spark, S.syllables, *map("".join, made)) == [plain_syllables(w) for w in made]
