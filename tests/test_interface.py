"""Bounding from left to right, modes, exports, bulk runs and deep trees, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.functions import finnish, ortho
from metrika.operators import bounding, maxent, parse, scansion, texts, tokens, trees, units
from metrika.operators import constraints as C

from test_engine import MASKS, random_units

PHRASAL = f"{MASKS}, ph_hi long, ph_lo long"


def docs(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")


def minimal(vectors):
    return {v for v in vectors if not any(u != v and all(a <= b for a, b in zip(u, v, strict=True)) for u in vectors)}


@pytest.mark.parametrize("names", [C.DEFAULT, C.TEXTUAL, (*C.TEXTUAL, "w_prom", "s_demoted")])
def test_walk_equals_all_scansions(spark, names):
    """Six, thirteen and fifteen constraints: vectors, how many scansions share them, and which."""
    rng = random.Random(len(names))
    rows = [(*r, rng.getrandbits(r[0]), rng.getrandbits(r[0])) for r in random_units(11, 25, 2, 9)]
    e = spark.createDataFrame(rows, PHRASAL)
    meter = parse.Meter(weights=dict.fromkeys(names, 1.0))
    assert all(C.REGISTRY[k].local for k in names)
    groups: dict = {}
    for r in parse.scored(e, meter).collect():
        groups.setdefault(tuple(r[k] for k in meter.key), {}).setdefault(tuple(r[k] for k in names), []).append(r.scan_ord)
    want = {(key, v): sorted(found[v]) for key, found in groups.items() for v in minimal(found)}
    got = {(tuple(r[k] for k in meter.key), tuple(r[k] for k in names)): r.places for r in parse.undominated(e, meter).collect()}
    assert got == want
    assert all(r.scansions == len(r.places) and r.scan_ord == r.places[0] for r in parse.undominated(e, meter).take(5))


def test_longer_positions_and_user_constraints_are_bounded_over_all_scansions(spark):
    C.register("odd_place", "no strong third syllable", lambda m: m.S.bitwiseAND(F.lit(4).cast("long")))
    try:
        names = ("w_stress", "s_unstress", "foot_size", "odd_place", "clash", "lapse", "w_heavy", "s_light", "s_func", "word_foot", "w_peak")
        meter = parse.Meter(weights=dict.fromkeys(names, 1.0), max_s=3, max_w=3, longest=6)
        e = spark.createDataFrame(list(random_units(4, 8, 2, 6)), MASKS)
        groups: dict = {}
        for r in parse.scored(e, meter).collect():
            groups.setdefault(tuple(r[k] for k in meter.key), set()).add(tuple(r[k] for k in names))
        got = {(tuple(r[k] for k in meter.key), tuple(r[k] for k in names)) for r in parse.undominated(e, meter).collect()}
        assert got == {(key, v) for key, found in groups.items() for v in minimal(found)}
    finally:
        del C.REGISTRY["odd_place"]


def test_zero_weights_take_undominated_parses_only(spark):
    meter = parse.Meter(weights={"w_stress": 1.0, "s_unstress": 0.0, "w_heavy": 0.0})
    e = spark.createDataFrame([(k, 0, *r[:1], *r[1:]) for k, r in enumerate(random_units(6, 20, 2, 7))], f"id int, variant int, {MASKS}")
    scored = parse.scored(e, meter).collect()
    for r in parse.best(e, meter).collect():
        mine = [s for s in scored if all(s[k] == r[k] for k in meter.key)]
        kept = minimal({tuple(s[k] for k in meter.names) for s in mine})
        order = sorted((s.score, s.scan_ord) for s in mine if tuple(s[k] for k in meter.names) in kept)
        assert (r.score, r.scan_ord) == order[0]
    lines = tokens.line_parts(docs(spark, "all the world is a stage, and all the men", "would that it were so"))
    key = lambda df: sorted((r.text_id, r.line_num, r.linepart, r.variant, r.score, r.scan_ord) for r in df.collect())
    for m in (meter, parse.DEFAULT):
        assert key(parse.best_of(lines, m)) == key(parse.best(units.encoded(lines), m))
    with pytest.raises(ValueError, match="negative"):
        parse.best(e, parse.Meter(weights={"w_stress": -1.0}))


def test_modes(spark):
    frame = docs(spark, "all would be well, and now the day", "no more of this")
    every = texts.parse_texts(frame, mode="all").collect()
    unit = lambda r: (r.text_id, r.line_num, r.linepart)
    kept = {}
    for u in {unit(r) for r in every}:
        mine = [r for r in every if unit(r) == u]
        assert len(mine) == len({r.variant for r in mine}) * sum(1 for _ in scansion.positions(mine[0].n))
        vectors = {(r.variant, *(r[k] for k in C.DEFAULT)) for r in mine}
        good = {v for v in vectors if not any(w[1:] != v[1:] and all(a <= b for a, b in zip(w[1:], v[1:], strict=True)) for w in vectors)}
        kept[u] = sorted((r.score, r.variant, r.scan_ord) for r in mine if (r.variant, *(r[k] for k in C.DEFAULT)) in good)
        assert [(r.score, r.variant, r.scan_ord) for r in sorted((r for r in mine if not r.is_bounded), key=lambda r: r.parse_rank)] == kept[u]
    for mode, lim in (("unbounded", None), ("unbounded", 2), ("best", None)):
        got = texts.parse_texts(frame, mode=mode, lim=lim).collect()
        for u, want in kept.items():
            most = 1 if mode == "best" else lim
            assert [(r.score, r.variant, r.scan_ord) for r in sorted((r for r in got if unit(r) == u), key=lambda r: r.parse_rank)] == want[:most]
    best = {unit(r): (r.score, r.variant, r.scan_ord) for r in parse.best_of(tokens.line_parts(frame)).collect()}
    assert best == {u: want[0] for u, want in kept.items()}
    assert {r.linepart for r in texts.parse_texts(frame, by="line").collect()} == {1}
    with pytest.raises(ValueError, match="mode"):
        texts.parse_texts(frame, mode="some")


def test_products_of_parts(spark):
    lines = tokens.line_parts(docs(spark, "all would be well, and now the day", "one, two"))
    lists = {(r.text_id, r.line_num, r.linepart): [tuple(p.v) for p in r.parses] for r in units.rhythms(lines).join(texts.parse_lists(lines), texts.RHYTHM).collect()}
    row = texts.combined(lines).collect()
    assert len(row) == 1
    sums = [tuple(a + b for a, b in zip(x, y, strict=True)) for x, y in itertools.product(lists[0, 1, 1], lists[0, 1, 2])]
    good = minimal(set(sums))
    assert row[0].n_product == len(sums) and row[0].n_kept == sum(s in good for s in sums) and row[0].best_score == min(map(sum, good))
    out = texts.export_lines(lines).where("text_id = 0").first()
    assert out.num_parses == len(sums) and out.n_parts == 2 and out.meter_str.count("|") == 1
    assert out.score_unbounded == sum(map(sum, lists[0, 1, 1])) + sum(map(sum, lists[0, 1, 2]))


def test_bulk_runs_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", "the cat sat"), ("b", ""), ("c", "on all the mats"), ("d", "12")], "id string, txt string")
    path = str(tmp_path / "out")
    assert texts.parse_corpus(rows.where("id < 'c'"), path) == {"n_done": 1, "n_skipped": 0, "n_failed": 1}
    spark.range(1).select(F.lit("lost").alias("text_id")).write.parquet(f"{path}/parses/batch=died")
    assert texts.parse_corpus(rows, path) == {"n_done": 1, "n_skipped": 2, "n_failed": 1}
    assert {r.text_id for r in texts.load_parses(spark, path).collect()} == {"a", "c"}
    with pytest.raises(Exception, match="bad item"):
        texts.parse_corpus(spark.createDataFrame([("e", "")], "id string, txt string"), path, on_error="raise")
    assert texts.statuses(spark, path).count() == 4 and texts.statuses(spark, str(tmp_path / "none")) is None


def test_one_poisoned_item_is_isolated(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id").isin(17, 40), F.raise_error(F.lit("poison"))).otherwise(F.lit("the cat sat on the mat")).alias("text"))
    path = str(tmp_path / "out")
    assert texts.parse_corpus(rows, path) == {"n_done": 58, "n_skipped": 0, "n_failed": 2}
    assert {r.text_id for r in texts.errors(spark, path).collect()} == {"17", "40"} and all("poison" in r.error for r in texts.errors(spark, path).collect())
    assert texts.load_parses(spark, path).select("text_id").distinct().count() == 58
    assert texts.parse_corpus(rows, path) == {"n_done": 0, "n_skipped": 60, "n_failed": 0}
    with pytest.raises(Exception, match="poison"):
        texts.parse_corpus(rows.where("id = '17' or id = '40'"), str(tmp_path / "other"), most_errors=1)


def test_all_combinations_of_forms(spark):
    """Twelve ambiguous words give 4,096 variants; small units equal an enumeration."""
    many = " ".join(["all"] * 6 + ["cat"] + ["will"] * 6)
    rows = units.product_variants(tokens.line_parts(docs(spark, many, "all the men will go"))).collect()
    assert sum(r.text_id == 0 for r in rows) == 4096 == len({(r.variant, r.st) for r in rows if r.text_id == 0})
    words = "all the men will go".split()
    want = set()
    for forms in itertools.product((0, 1), repeat=2):
        stress, at = 0, iter(forms)
        for k, w in enumerate(words):
            form = next(at) if w in ortho.AMBIGUOUS_WORDS else None
            stress |= (w not in ortho.FUNCTION_WORDS if form is None else form) << k
        want.add((forms[0] + 2 * forms[1], stress))
    assert {(r.variant, r.st) for r in rows if r.text_id == 1} == want


def test_codes_equal_definitions(spark):
    """Rhythms by string replacement against the syllable rules word by word."""
    rng = random.Random(3)
    stems = ["the", "all", "Beauty", "naïve", "str", "x2y", "o'er", "queue", "Äpfel", "rhythm", "idea", "will", "a", "under", "été", "hmm", "ÉCOLE", "where"]
    lines = [" ".join(rng.choice(stems) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    frame = tokens.line_parts(docs(spark, *lines))
    got = {(r.text_id, r.linepart): r for r in units.rhythms(frame).collect()}
    import re

    for r in frame.collect():
        n = he = wb = st = amb = 0
        for w in (w.lower() for w in r.words):
            runs = re.findall(f"[{ortho.VOWELS}]+", w)
            for i, run in enumerate(runs):
                heavy = len(run) > 1 or (i == len(runs) - 1 and w[-1] not in ortho.VOWELS)
                one = len(runs) == 1
                a = one and w in ortho.AMBIGUOUS_WORDS
                s = (w not in ortho.FUNCTION_WORDS and not a) if one else (i % 2 == 0 and (i == 0 or i < len(runs) - 1))
                he, wb, st, amb = he | heavy << n, wb | (i == 0) << n, st | s << n, amb | a << n
                n += 1
        found = got.get((r.text_id, r.linepart))
        assert (found is None) if not 2 <= n <= 18 else (found.n, found.he, found.wb, found.st, found.amb) == (n, he, wb, st, amb), r.words


def test_phrasal_masks(spark):
    rows = spark.createDataFrame([(["under", "the", "hmm", "tree"], [0, -2, -1, None]), (["a", "cat"], [0, 0])], "words array<string>, phrasal_stress array<int>")
    got = units.with_phrasal(rows).collect()
    assert (got[0].ph_hi, got[0].ph_lo) == (0b1011, 0b0100) and (got[1].ph_hi, got[1].ph_lo) == (0, 0)


# ---- MaxEnt ----


def test_sums_over_scansions_equal_enumeration(spark):
    e = spark.createDataFrame(list(random_units(9, 20, 2, 8)), MASKS)
    names, key = parse.DEFAULT.names, parse.DEFAULT.key
    weights = {k: 0.3 + 0.2 * i for i, k in enumerate(names)}
    rows = parse.signatures(e).select(*key, *bounding.costs(names))
    got = {tuple(r[k] for k in key): r for r in maxent.expectations(rows, key, list(names), weights).collect()}
    every: dict = {}
    for r in parse.scored(e).collect():
        every.setdefault(tuple(r[k] for k in key), []).append([r[k] for k in names])
    for k, counts in every.items():
        x = np.array(counts, float)
        mass = np.exp(-x @ np.array([weights[c] for c in names]))
        assert got[k].log_z == pytest.approx(np.log(mass.sum()))
        assert [got[k][f"e_{c}"] for c in names] == pytest.approx((mass[:, None] * x).sum(axis=0) / mass.sum())
    both = rows.withColumn("units", F.lit(3)).select("*", *(F.lit(6.0 if c == "w_stress" else 0.0).alias(f"o_{c}") for c in names))
    model = maxent.fit_rhythms(both, key, list(names), regularization=10.0)
    assert min(model.weights.values()) >= 0 and max(model.weights, key=model.weights.get) != "w_stress"
    assert maxent.report(model).splitlines()[-1].startswith("loss")


# ---- trees ----


def test_deep_trees(spark):
    """A chain of 600 words, sparse word numbers, a circle and a missing head; depths equal a walk."""
    rng = random.Random(2)
    rows, want = [("chain", 1, k, k - 1) for k in range(600)], {("chain", k): k for k in range(600)}
    heads = {2: -1, 5: 2, 9: 5, 14: 2, 20: 14}
    rows += [("sparse", 1, w, h) for w, h in heads.items()]
    want |= {("sparse", w): d for w, d in ((2, 0), (5, 1), (9, 2), (14, 1), (20, 2))}
    rows += [("circle", 1, 0, -1), ("circle", 1, 1, 2), ("circle", 1, 2, 1), ("circle", 1, 3, 0), ("circle", 1, 4, 77)]
    want |= {("circle", 0): 0, ("circle", 3): 1}
    for s in range(200):
        depth = {0: 0}
        rows.append((f"r{s}", 1, 0, -1))
        for k in range(1, 40):
            head = rng.randrange(k)
            depth[k] = depth[head] + 1
            rows.append((f"r{s}", 1, k, head))
        want |= {(f"r{s}", k): d for k, d in depth.items()}
    rng.shuffle(rows)
    got = {(r.text_id, r.word_num): r.depth for r in trees.depths(spark.createDataFrame(rows, "text_id string, sent_num int, word_num int, head int")).collect()}
    assert got == want


def test_two_million_words(spark):
    words = spark.range(2_000_000).select((F.col("id") / 50).cast("int").alias("text_id"), F.lit(1).alias("sent_num"), (F.col("id") % 50).cast("int").alias("word_num"))
    deps = words.withColumn("head", F.when(F.col("word_num") == 0, -1).otherwise(F.col("word_num") - 1).cast("int"))
    assert trees.depths(deps).where("depth = word_num").count() == 2_000_000


def test_finnish_letters():
    assert [finnish.ipa(s) for s in ("uu", "vau", "ksi", "zoo", "aa")] == ["uː", "vɑʊ", "ksi", "zoː", "ɑː"]
