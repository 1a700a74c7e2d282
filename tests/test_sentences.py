"""Learned sentence boundaries against a plain token-by-token version of the published method."""

import math
import re
from collections import Counter

from metrika.operators import punkt

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\W_][\w.'’-]*[!?]*")


def rows(spark, *texts):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, a int, b int")


def split(spark, text, learn_from=None):
    return [r.sentence for r in sorted(punkt.sentences(rows(spark, text), learn_from=learn_from).collect(), key=lambda r: r.sent_num)]


def plain_scores(texts):
    """Abbreviation scores, straight from the definition."""
    n, dot = Counter(), Counter()
    for text in texts:
        for t in TOKEN.findall(re.sub("-{2,}", "—", text)):
            core = re.sub(r"[.!?]+$", "", t)
            kind = "##" if re.match(r"^\d[\d.-]*$", core) else core.lower()
            n[kind] += 1
            dot[kind] += t.endswith(".")
    total, dots = sum(n.values()), sum(dot.values())
    out = {}
    for k in dot:
        if dot[k] and k != "##":
            ll = lambda p: dot[k] * math.log(p) + (n[k] - dot[k]) * math.log(1 - p)  # noqa: B023, E731
            letters = len(k.replace(".", ""))
            out[k] = 2 * (ll(0.99) - ll(dots / total)) * math.exp(-letters) * (len(k) - letters + 1) * letters ** -(n[k] - dot[k])
    return out


def test_scores_equal_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.type: r.score for r in punkt.type_counts(punkt.pair_counts(docs)).where("n_dot > 0 and score is not null").collect()}
    want = plain_scores([r.text for r in docs.collect()])
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_known_abbreviations(spark):
    assert split(spark, "Dr. Smith came. He left.") == ["Dr. Smith came.", " He left."]
    assert split(spark, 'She said "Stop!" Then she left. (It was late.) Bye') == ['She said "Stop!"', " Then she left.", " (It was late.)", " Bye"]
    assert split(spark, "J. Smith and K. Jones met.  They spoke") == ["J. Smith and K. Jones met.", "  They spoke"]
    assert split(spark, "He paid 3.50 in May. 12 came.") == ["He paid 3.50 in May.", " 12 came."]


def test_learned_abbreviation_and_starters(spark):
    learned = rows(spark, *["We met Lt. Brown at noon. The river was cold. We saw Lt. Green again. The day was long."] * 40, *["cold noon after long day again in a green river we met and saw the others at the brown hill was a cold place"] * 60)
    pairs = punkt.pair_counts(learned)
    assert {r.type for r in punkt.abbreviations(pairs, []).collect()} == {"lt"}
    assert {"the", "we"} >= {r.type for r in punkt.starters(pairs, []).collect()} >= {"the"}
    assert split(spark, "Then Lt. Brown slept. The end.", learned) == ["Then Lt. Brown slept.", " The end."]
    # An abbreviation ends a sentence if what follows is written small elsewhere and never large inside.
    mixed = rows(spark, *["They sell tea, jam etc. Prices of tea are low. Milk, oil etc. are sold too by the shop. Low tea in a shop by day."] * 40, *["the low shop by the day sells tea and jam"] * 60)
    assert split(spark, "Buy jam etc. The shop is open.", mixed)[0] == "Buy jam etc."
    assert split(spark, "Buy jam etc. are gone.", mixed) == ["Buy jam etc. are gone."]


def test_hard_texts(spark):
    texts = rows(spark, None, "", " ", "...", "no stop", "Same. Text.", "ends.\u0001 Next")
    found = {}
    for r in punkt.sentences(texts.union(texts.where("doc_id = 5"))).collect():
        found.setdefault(r.text_id, []).append((r.sent_num, r.sentence))
    assert {k: sorted(v) for k, v in found.items()} == {
        1: [(1, "")], 2: [(1, " ")], 3: [(1, "...")], 4: [(1, "no stop")], 5: [(1, "Same."), (2, " Text.")], 6: [(1, "ends."), (2, " Next")],
    }
    assert punkt.sentences(rows(spark, "a").limit(0)).count() == 0


def test_sentences_give_the_text_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for r in punkt.sentences(docs).collect():
        found.setdefault(r.text_id, []).append((r.sent_num, r.sentence))
    for r in docs.collect():
        assert "".join(s for _, s in sorted(found[r.doc_id])) == re.sub("-{2,}", "—", r.text)
