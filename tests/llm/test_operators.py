"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and extra columns."""

import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrika.llm import (
    chat_tools, common, decontam, langid, minhash, pii, quality, queries, sentencepiece_trie, sharding, topk_nra, toxicity,
)

SF = "/root/testdata/sf0.001"
#: Internal names of the operators, given to the documents as columns of their own.
CLASH = {
    k: "own"
    for k in (
        "text_hash digest n_shingles kept rows id__ hash__ component component_id h l h__ l__ m__ size__ made__ many__ mention mentions "
        "hit_doc_id__ hit_text_hash__ item_id similarity contaminated size tokens group shard piece parts class at label__ grade__ selected"
    ).split()
}
EXTRA = "doc_id long, text string, rep long, key string, score double, lang string, " + ", ".join(f"{k} string" for k in CLASH)


def docs(spark, *values, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = ids or range(len(values))
    return spark.createDataFrame([(i, t, 1, "k", 0.5, "en", *CLASH.values()) for i, t in zip(ids, values, strict=True)], EXTRA)


def hard(spark):
    """Null, empty, blank and very long texts, repeats, a null id."""
    long = "word " * 40_000
    return docs(spark, None, "", " \t\n", long, "a b c d e f", "a b c d e f", "same id", "日本語 ▁ x", "null id", ids=[0, 1, 2, 3, 4, 4, 6, 7, None])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- shared pieces ----


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *((k, k + 1) for k in range(100, 180))]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 8, 9)} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and got[180] == 100 and 5 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op1 ----


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(0)
    plain = lambda: " ".join(rng.choice(["river", "stone", "green", "table", "sings"]) for _ in range(30))
    texts = [plain() + (" you vile zorgon fool" if k % 3 == 0 else "") for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, *texts), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.doc_id % 3 == 0) == (r.score >= 0.5) for r in got if r.held_out)
    again = toxicity.toxicity(docs(spark, *texts), labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def test_toxicity_hard_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(hard(spark), none).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs(spark).limit(0), none).count() == 0


# ---- op2 ----


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "t", '{"b":1,"a":"x"}', ["b"]), (1, 2, "b", "t", '{"a":"5","b":"2"}', []), (1, 3, "c", "t", "oops", ["d"]),
            (1, 4, "d", "t", '{"a":3}', ["c"]), (2, 1, None, "u", "{}", None), (2, 2, "x", "t", '{"a":"q","z":[1,{"d":1,"c":2}]}', ["zz"]),
        ],
        "conv_id long, seq long, call_id string, tool string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", "ok"), (1, "b", None), (1, "b", "two"), (3, "q", "orphan")], "conv_id long, call_id string, output string")
    schemas = spark.createDataFrame([("t", "a", "string", True, 1.0, 3.0), ("t", "b", "integer", False, 0.0, 5.0)], "tool string, field string, type string, required boolean, low double, high double")
    got = {(r.conv_id, r.call_id): r for r in chat_tools.link_tool_calls(calls, results, schemas).collect()}
    assert [got[1, k].link for k in "abc"] == ["linked", "ambiguous", "missing"]
    assert got[1, "b"].position < got[1, "a"].position and got[1, "c"].position is None and got[1, "d"].position is None
    assert got[1, "b"].errors == ["b: not integer"] and got[1, "c"].errors == ["arguments: not an object"] and got[1, "d"].errors == ["a: not string"]
    assert got[2, "x"].errors == ["depends_on: unknown zz", "z: not in schema"] and got[2, None].errors == ["tool: unknown"]
    x = json.loads(got[2, "x"].json)
    assert got[2, "x"].json == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat_tools.orphans(calls, results).collect()[0].call_id == "q"


def test_tool_calls_of_all_conversations(spark):
    turns = table(spark, "conversations").collect()
    got = {r.call_id: r for r in queries.op2_tool_calls(spark, SF).collect()}
    want = {f"c{t.conv_id}-{t.turn}": t for t in turns if t.role == "assistant"}
    users = {(t.conv_id, t.turn): t.text for t in turns if t.role == "user"}
    assert set(got) == set(want)
    for k, t in want.items():
        j = json.loads(got[k].json)
        assert j["arguments"]["text"] == t.text and j["arguments"]["n_chars"] == len(t.text)
        assert j["result"] == users.get((t.conv_id, t.turn + 1)) and (got[k].link == "linked") == ((t.conv_id, t.turn + 1) in users)
        assert got[k].position == sum(o.conv_id == t.conv_id and o.turn <= t.turn for o in want.values())


# ---- op3 ----


def brute_top(ids, x, k, every):
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[o]), int(s[o])) for r, o in enumerate(order)}
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_top_k(spark, copies):
    rng = np.random.default_rng(copies)
    x = np.repeat(rng.normal(0, 0.2, (400 // copies, 16)), copies, axis=0)
    rows = [(k, v.tolist(), 1, 2) for k, v in enumerate(x)]
    rows += [(9_000, None, 0, 0), (9_050, [float("nan")] * 16, 0, 0), (9_100, [1.0, None] + [0.0] * 14, 0, 0), (9_150, [], 0, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d int, q int")
    got = {tuple(r)[:4] for r in topk_nra.top_k(df).collect()}
    assert got == brute_top(np.arange(len(x)), np.floor(x * 256).astype(np.int64), 5, 50)


def test_top_k_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_nra, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(topk_nra, "QUERY_BLOCK", 2)
    x = np.random.default_rng(3).normal(0, 0.2, (300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {tuple(r)[:4] for r in topk_nra.top_k(df).collect()} == brute_top(np.arange(300), np.floor(x * 256).astype(np.int64), 5, 50)
    assert topk_nra.top_k(df.limit(0)).count() == 0


# ---- op4 ----


def test_sharding(spark):
    d = table(spark, "documents")
    got = sharding.sharded(d, 8).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(got) == len(text)
    bytes_, slots = Counter(), {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    assert max(bytes_.values()) < 1.1 * sum(bytes_.values()) / 8


def test_sharding_hot_group_and_hard_cases(spark):
    hot = docs(spark, *(["the same text"] * 600 + [f"text number {k}" for k in range(900)]))
    got = sharding.sharded(hot, 10).collect()
    rows = Counter(r.shard for r in got)
    assert len(got) == 1500 and max(rows.values()) - min(rows.values()) < 30
    got = sharding.sharded(hard(spark), 4).collect()
    assert len(got) == 9 and sum(r.text_crc32 is None for r in got) == 1 and min(r.size for r in got) == 16
    assert sharding.sharded(docs(spark).limit(0)).count() == 0


# ---- op5 ----


def shingle_set(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else ({tuple(words)} if words else set())


def brute_groups(texts, n):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(120)]
    texts = {0: " ".join(base)}
    for k in range(1, 120):  # a star of copies edited by differing degrees, some of them beyond the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 40)}"
        texts[k] = " ".join(copy)
    texts |= {r.doc_id + 1000: r.text for r in table(spark, "documents").collect()}
    got = minhash.near_duplicates(docs(spark, *texts.values(), ids=list(texts)), n, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(texts, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_hard_cases(spark):
    got = minhash.near_duplicates(hard(spark)).collect()
    assert len(got) == 9
    empty = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for r in empty)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    left = minhash.deduplicated(hard(spark))
    assert left.columns == hard(spark).columns and left.count() == 8
    # Different texts under one doc_id all stay, repeated rows once, and each row is judged by its own text.
    same = docs(spark, "a b c d e f", "g h i j k l", "g h i j k l", "m n o p q r", "a b c d e f", ids=[1, 1, 1, 2, 2])
    kept = sorted((r.doc_id, r.text) for r in minhash.deduplicated(same).collect())
    assert kept in ([(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r")], [(1, "a b c d e f"), (1, "g h i j k l")])
    assert minhash.near_duplicates(docs(spark).limit(0)).count() == 0


# ---- op6 ----


def test_surrogates(spark):
    texts = [
        "Mail Ann.Lee@Mail3.example.com, ann.lee@mail3.example.com or call +1 (555) 123-4567, 555-123-4567.",
        'card 4111111111111111 and 4111-1111-1111-1111; ssn 123-45-6789 ip 10.0.0.1. token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" end',
        "Mrs. Anna Smith met Mr Jones, Госпожа Иванова; DE89370400440532013000", None, "", "nothing here", "v1.2.3 2024-01-05 12345",
    ]
    got = {r.doc_id: r for r in pii.surrogated(docs(spark, *texts), "k", counts=True).collect()}
    assert [got[k].n_mentions for k in range(7)] == [4, 5, 4, 0, 0, 0, 0] and [got[k].text for k in range(3, 7)] == texts[3:]
    for k in range(3):
        for secret in re.findall(r"[\w.]+@[\w.]+\w|\d{3}-\d{4}|\d{16}|[0-9a-f]{40}|10\.0\.0\.1|Smith|Jones|Иванова|DE\w+", texts[k]):
            assert secret not in got[k].text
    mails = re.findall(r"\S+@[\w.]+\w", got[0].text)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[1].endswith(".com")
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4})", got[0].text).groups()
    assert f"{a}-{b}." in got[0].text
    card = re.search(r"card (\d{16})", got[1].text)[1]
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    iban = re.search(r"DE\d+", got[2].text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"Mrs\. [A-Z][a-z]+ [A-Z][a-z]+a met", got[2].text) and re.search(r"Госпожа [А-Я][а-я]+а;", got[2].text)
    other = pii.surrogated(docs(spark, *texts), key="another").where("doc_id = 1").first().text
    assert other != got[1].text
    with pytest.raises(ValueError, match="key"):
        pii.surrogated(docs(spark, *texts), "")
    assert got[0].hash__ == got[0].h__ == got[0].size__ == "own"


def test_surrogates_stay_distinct(spark):
    texts = [f"from 10.0.{a}.{b} to" for a in range(20) for b in range(20)]
    mentions = spark.createDataFrame([(t.split()[1],) for t in texts], "mention string")
    rows = pii.entity_map(mentions, "k").collect()
    made = [r.surrogate for r in rows]
    assert len(set(made)) == len(made) == 400 and not set(made) & {r.mention for r in rows}
    assert pii.surrogated(hard(spark), "k").count() == 9 and pii.surrogated(hard(spark), "k").columns == hard(spark).columns
    own = docs(spark, "to a@b.example.com").withColumn("n_mentions", F.lit("own"))
    assert pii.surrogated(own, "k", counts=True).first().n_mentions == 1 and pii.surrogated(own, "k").first().n_mentions == "own"
    assert pii.surrogated(docs(spark).limit(0), "k", counts=True).count() == 0


# ---- op7 ----


def brute_hits(texts, items, n=5):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
    out = set()
    for d, t in texts.items():
        s = cut(words(t))
        for i, x in items.items():
            want = Counter(cut(words(x)))
            m = sum(want.values())
            if not m or not set(s) & set(want):
                continue
            for k in range(len(s)):
                for size in {min(m, len(s) - k)}:
                    both = sum((Counter(s[k : k + size]) & want).values())
                    if both >= 0.8 * (size + m - both):
                        out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = {r.item_id: r.text for r in table(spark, "benchmark").collect()} | {900: "short item", 901: "", 902: None}
    texts = {r.doc_id: r.text for r in table(spark, "documents").limit(60).collect()}
    for k, x in enumerate(list(items.values())[:30]):  # passages with a few words changed, within and beyond the threshold
        w = x.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        texts[5000 + k] = "before it " + " ".join(w) + " and after"
    texts |= {6000: "Short ITEM!", 6001: None, 6002: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    frame = docs(spark, *texts.values(), ids=list(texts))
    got = {(r.doc_id, r.item_id) for r in decontam.hits(frame, bench).collect()}
    assert got == brute_hits(texts, items)
    flags = decontam.flagged(frame, bench).collect()
    assert len(flags) == len(texts) and {r.doc_id for r in flags if r.contaminated} == {d for d, _ in got}
    clean = decontam.decontaminated(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in got}
    assert decontam.flagged(hard(spark), bench.limit(0)).where("contaminated").count() == 0


# ---- op8 ----


def best_score(word, pieces, unknown):
    best = [0.0] + [-1e300] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + unknown
        for begin in range(end):
            if word[begin:end] in pieces:
                best[end] = max(best[end], best[begin] + pieces[word[begin:end]][1])
    return best[-1]


def test_sentencepiece(spark):
    v = sentencepiece_trie.load()
    encoder = sentencepiece_trie.Encoder(v)
    texts = [r.text for r in table(spark, "documents").limit(30).collect()] + ["", " ", "  a", "a  b ", "▁x ▁", "日本語 🙂", "\n\t"]
    ids = encoder(texts)
    assert [sentencepiece_trie.decode_ids(k, v) for k in ids] == texts and encoder([None]) == [None]
    by_id = {k: s for k, s in v.pieces.values()}
    words = {w for t in texts for w in sentencepiece_trie.marked_words(t)}
    for word, found in sentencepiece_trie.segment(list(words), v).items():
        if all(k in by_id for k in found):
            assert sum(by_id[k] for k in found) == best_score(word, v.pieces, v.unknown)
    got = {r.doc_id: r for r in sentencepiece_trie.encode(hard(spark).where("doc_id is not null"), check=True).collect()}
    assert got[0].ids is None and got[1].ids == [] and all(r.exact for k, r in got.items() if k)
    back = {r.doc_id: r.text for r in sentencepiece_trie.decode(sentencepiece_trie.encode(hard(spark))).collect()}
    assert back[0] is None and back[7] == "日本語 ▁ x"


# ---- op9 ----


def test_quality(spark):
    d, labels = table(spark, "documents"), table(spark, "labels")
    got = quality.rated(d, labels).join(labels, "doc_id").collect()
    assert sum(r.selected == (r.quality == 1) for r in got) > 0.85 * len(got)
    model = quality.fit(["good text here"] * 20 + ["bad %%% bad"] * 20 + ["fine text here"] * 20, [2] * 20 + [0] * 20 + [1] * 20, 3)
    assert model.thresholds[0] <= model.thresholds[1]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    left = quality.selected(hard(spark), labels.where("quality = 2").union(none))
    assert left.columns == hard(spark).columns
    assert quality.rated(hard(spark), labels).count() == 9 and quality.rated(docs(spark).limit(0), labels).count() == 0


# ---- op10 ----


def test_language_id(spark):
    d = table(spark, "documents")
    got = {r.doc_id: r for r in langid.language_id(d).collect()}
    held = [(r, got[r.doc_id]) for r in d.collect() if got[r.doc_id].held_out]
    assert sum(r.lang == g.lang_pred for r, g in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.language_id(hard(spark)).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and odd[3].lang_pred in ("en", "und")
    model = langid.fit({"a": ["banana bandana"] * 3, "b": ["kiosk desk mask"] * 3})
    pieces = {p: i for i, p in enumerate(langid.vocabulary())}

    def brute(word, k):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            p = 1.0
            for a, b in itertools.pairwise(edges):
                found = model.prob[pieces[word[a:b]], k] if word[a:b] in pieces else 0.0
                p *= max(found, langid.FLOOR) if b - a == 1 else found
            total += p
        return np.log(total)

    words = [u for t in ("banana mask", "qzß") for u in langid.units(t)]
    got = langid.log_probabilities(model, words)
    assert all(abs(got[i, k] - brute(w, k)) < 1e-9 for i, w in enumerate(words) for k in (0, 1))


# ---- pipeline and registry ----


def test_pipeline(spark):
    """Every stage against brute force on what the stage before kept; the classifier against `rated`."""
    d = table(spark, "documents")
    docs_columns, seen = d.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, common.written(stage(spark, d, SF), name)
        seen.append((before, d))
        assert d.columns == docs_columns or name == "tokens"
    texts = [{r.doc_id: r.text for r in x.collect()} for x, _ in seen]
    rated = quality.rated(seen[0][0], table(spark, "labels")).where("selected").collect()
    assert set(texts[1]) == {r.doc_id for r in rated} and 0.5 * len(texts[0]) < len(texts[1]) < len(texts[0])
    assert set(texts[2]) == {i for i, (_, root) in brute_groups(texts[1], 5).items() if root == i}
    hits = brute_hits(texts[2], {r.item_id: r.text for r in table(spark, "benchmark").collect()})
    assert set(texts[3]) == set(texts[2]) - {d for d, _ in hits} and hits
    assert set(texts[4]) == set(texts[3]) and any(texts[4][k] != texts[3][k] for k in texts[3])
    back = {r.doc_id: r.text for r in sentencepiece_trie.decode(d.select("doc_id", "ids")).collect()}
    assert back == texts[4] and all(r.n_pieces == len(r.ids) for r in d.collect())


def test_pipeline_hard_cases(spark, tmp_path):
    """Nulls, empty and long texts and repeated rows through all stages; empty tables too."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 9), (4, "a b c d e f g", "en", "s", 9),
            (4, "a b c d e f g", "en", "s", 9), (None, "call 555-123-4567 now", "en", None, 5)]
    spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for many, want in ((rows, [None, 1, 2, 3, 4]), ([], [])):
        spark.createDataFrame(many, columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_every_operator_is_registered():
    numbers = {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES}
    assert numbers == set(range(1, 11))
