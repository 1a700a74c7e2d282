"""What once had a bound: large components of op3, long names, short secrets and country codes of op6."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.llm import pii, topk_nra


# ---- op3 ----


def brute(rows, k, every, scale=256):
    whole = [(i, [math.floor(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v]) for i, v in rows]
    out = set()
    for i, v in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)[:k]
            out |= {(i, r + 1, j, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("large", [1e6, 1e9, 1e300])
def test_top_k_of_components_of_any_size(spark, monkeypatch, large):
    monkeypatch.setattr(topk_nra, "FIRST_STEP", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (240, 8))
    x[::7, 3] = large * rng.normal(size=len(x[::7]))
    x[50] = x[100] = -large
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = topk_nra.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 50)


def test_sums_stay_exact_in_every_kind_of_number():
    rng = np.random.default_rng(1)
    for bound in (1 << 10, 1 << 27, 1 << 40):
        x = rng.integers(-bound, bound, (500, 6))
        got = [r[:3] for r in topk_nra.answers(x[:20], np.arange(20), x, np.arange(500), 3)]
        rows = [(k, v.tolist()) for k, v in enumerate(x)]
        want = {(i, j): -s for i in range(20) for s, j in sorted((-sum(a * b for a, b in zip(rows[i][1], w, strict=True)), j) for j, w in rows if j != i)[:3]}
        assert {(i, j): s for i, j, s in got} == want


def test_sortable_texts_are_in_the_order_of_their_integers():
    values = [-(10**40), -1000, -999, -12, -1, 0, 1, 2, 10, 99, 100, 1 << 63, 10**40]
    assert sorted(values, key=topk_nra.sortable) == values


# ---- op6 ----


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.surrogated(df, "key").orderBy("doc_id").collect()]


def test_names_of_any_length_with_particles(spark):
    long = "Mr " + " ".join(["Alfonso"] * 3_000)
    texts = [
        "Mr Juan Carlos Alberto Garcia Lopez left.", "We met Maria van der Berg today.", "Dr de Witt and Mrs Berg", long,
        "John Q. Adams wrote", "then nothing of this",
    ]
    got = replaced(spark, *texts)
    for hidden in ("Juan", "Carlos", "Alberto", "Garcia", "Lopez"):
        assert hidden not in got[0]
    assert re.fullmatch(r"Mr( \p{Lu}\p{L}+){5} left\.".replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "[a-z]"), got[0])
    assert re.fullmatch(r"We met [A-Z][a-z]+ van der [A-Z][a-z]+ today\.", got[1]) and "Berg" not in got[1]
    assert got[1].split()[5] == got[2].split()[-1], "one family name has one surrogate"
    assert re.fullmatch(r"Dr de [A-Z][a-z]+ and Mrs [A-Z][a-z]+", got[2]) and "Witt" not in got[2]
    assert len(got[3].split()) == 3_001 and len(set(got[3].split()[1:-1])) == 1 and "Alfonso" not in got[3]
    assert "Adams" not in got[4] and got[5] == texts[5]


def test_secrets_of_any_form(spark):
    values = ["hunter", "ab1", "abcdefgh", "Secret123", "p", "é9!x", "eyJhbGciOi.eyJzdWIi.c2ln", "a-b_c/d", "geheim"]
    leads = ["password: {}", "password = {}", "token: {}", "pwd=\"{}\"", "passwd: {}", "api_key={}", "Authorization: Bearer {}", "secret='{}'", "passphrase: {}."]
    got = replaced(spark, *(lead.format(v) for lead, v in zip(leads, values, strict=True)))
    for lead, value, text in zip(leads, values, got, strict=True):
        before, after = lead.split("{}")
        assert text.startswith(before) and text.endswith(after), text
        inner = text[len(before) : len(text) - len(after)]
        assert inner != value and len(inner) >= len(value), text
    for plain in ("the token is lost", "password:", "password: ***", "secret = ", "a bearer of bad news", "the ratio a: b"):
        assert replaced(spark, plain) == [plain]


def test_more_short_secrets_than_their_format_has_room_for(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    got = replaced(spark, " ".join(f"pwd={c}" for c in letters))[0].split()
    made = [w.removeprefix("pwd=") for w in got]
    assert len(set(made)) == 26 and not set(made) & set(letters)


def test_country_codes_and_whole_addresses(spark):
    got = replaced(spark, "call +44 1234 5678 or 441-234-5678", "write to max.müller@firma.de now", "+1 555 234 9876 is 555-234-9876")
    first = re.fullmatch(r"call \+44 (\d{4} \d{4}) or (\d{3}-\d{3}-\d{4})", got[0])
    assert first and first[1] != "1234 5678" and re.sub(r"\D", "", "44" + first[1]) != re.sub(r"\D", "", first[2])
    mail = re.fullmatch(r"write to ([a-z.]+)@[a-z]+\.de now", got[1])
    assert mail and "max" not in mail[1] and "ller" not in mail[1]
    same = re.fullmatch(r"\+1 (\d{3}) (\d{3}) (\d{4}) is (\d{3})-(\d{3})-(\d{4})", got[2])
    assert same and same.groups()[:3] == same.groups()[3:]


def test_kinds_of_mentions(spark):
    mentions = ["max.müller@firma.de", "+44 1234 5678", "Maria van der Berg"]
    df = spark.createDataFrame([(m,) for m in mentions], "m string")
    assert [r.k for r in df.select(pii.kind_of(F.col("m")).alias("k")).collect()] == ["email", "phone", "name"]
