"""Goldens, brute force and invariants of the engine."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.functions import finnish, phonology
from metrika.functions import text as T
from metrika.operators import constraints as C
from metrika.operators import form, maxent, parse, rhyme, scansion, stats, sylls, tokens, trees, units
from metrika.sources import corpus
from metrika.streaming import lines as streaming

MASKS = "n int, st long, he long, sg long, wk long, fn long, wb long"


def texts(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")


# ---- tokens ----


def test_tokens_carry_white_space_and_counters(spark):
    rows = tokens.tokens(texts(spark, "The cat, sat.\nA dog--barked!\n\nEnd", None, "", "    ererer e   e  ")).orderBy("text_id", "word_num").collect()
    first = [r for r in rows if r.text_id == 0]
    want = ["The", " cat", ",", " sat", ".", "\nA", " dog", "—", "barked", "!", "\n\nEnd"]
    assert [r.word_txt for r in first] == want
    assert [r.line_num for r in first if r.word_txt.strip() in ("The", "A", "End")] == [1, 2, 3]
    assert [r.para_num for r in first if r.word_txt.strip() in ("The", "A", "End")] == [1, 1, 2]
    assert [r.sent_num for r in first if r.word_txt.strip() in ("The", "A", "End")] == [1, 2, 3]
    assert not [r for r in rows if r.text_id in (1, 2)]
    assert len([r for r in rows if r.text_id == 3]) == 3


def test_text_functions(spark):
    row = spark.createDataFrame([("a--b &amp; “c”\r\n",)], "t string").select(
        T.normalize_dashes(F.col("t")).alias("d"), T.clean_text(F.col("t")).alias("c"), T.stress_class(F.lit("'maɪ")).alias("p"),
        T.stress_class(F.lit("`maɪ")).alias("s"), T.stress_class(F.lit("maɪ")).alias("u"), T.format_syllable(F.lit("ma'ɪ")).alias("f"),
        T.attribute_string(a=F.lit(1), b=F.lit(None)).alias("x"), T.normalize_token(F.lit(" a  b ")).alias("n"),
    ).first()
    assert row.d.startswith("a—b") and row.c == 'a--b & "c"\n'
    assert (row.p, row.s, row.u, row.f, row.x, row.n) == ("P", "S", "U", "'maɪ", "a=1", "a-b")


def test_long_line_splits_into_parts(spark):
    part = "a tale of lands and seas and hills and dales"
    rows = tokens.line_parts(texts(spark, f"{part}, {part}")).collect()
    assert [r.linepart for r in rows] == [1, 2] and rows[0].words == rows[1].words


# ---- scansions and constraints ----


def test_catalogue_counts_and_order():
    assert [sum(1 for _ in scansion.positions(n)) for n in (2, 4, 8, 10, 14, 18)] == [4, 10, 68, 178, 1220, 8362]
    assert sum(1 for _ in scansion.positions(10, 10, 10)) == 2**10
    assert ["|".join(p) for p in scansion.positions(2)] == ["ww", "ss", "w|s", "s|w"]
    assert ["|".join(p) for p in scansion.positions(3)] == ["w|ss", "w|s|w", "ww|s", "s|ww", "s|w|s", "ss|w"]


def by_syllable(name, u, parts):
    """Violations of one constraint, syllable by syllable, from the definitions."""
    n = u["n"]
    bit = lambda k, i: bool(u[k] >> i & 1)
    spot = [(p[0] == "s", k, len(p)) for p in parts for k in range(len(p))]
    count = 0
    for i in range(n):
        strong, k, size = spot[i]
        st, he = bit("st", i), bit("he", i)
        before = i > 0
        pst = before and bit("st", i - 1)
        pstrong = before and spot[i - 1][0]
        fn = bit("fn", i) and before and bit("fn", i - 1)
        count += {
            "w_stress": st and not strong, "s_unstress": not st and strong, "w_peak": bit("sg", i) and not strong,
            "s_trough": bit("wk", i) and strong,
            "unres_within": before and k > 0 and not bit("wb", i) and (bit("he", i - 1) or not pst),
            "unres_across": k > 0 and bit("wb", i) and (strong or not fn), "foot_size": size > 2,
            "clash": before and st and pst and not (strong and pstrong), "lapse": before and not st and not pst and (strong or pstrong),
            "w_heavy": he and not strong, "s_light": not he and strong, "s_func": bit("fn", i) and strong, "word_foot": bit("wb", i) and k > 0,
        }[name]
    return count


def random_units(seed, many, low, high):
    rng = random.Random(seed)
    for _ in range(many):
        n = rng.randint(low, high)
        yield (n, *(rng.getrandbits(n) for _ in range(5)), rng.getrandbits(n) | 1)


def test_masks_equal_definitions(spark):
    rows = list(random_units(3, 40, 2, 7))
    found = spark.createDataFrame(rows, MASKS).join(scansion.scansions(spark, 7), "n")
    names = C.TEXTUAL
    out = found.select("n", "st", "he", "sg", "wk", "fn", "wb", "positions", *C.counts(names)).collect()
    assert len(out) > 500
    for r in out:
        for k in names:
            assert r[k] == by_syllable(k, r.asDict(), r.positions.split("|")), (k, r)


def test_bounding_equals_brute_force(spark):
    rows = [(*r,) for r in random_units(5, 25, 2, 8)]
    e = spark.createDataFrame(rows, MASKS)
    names = C.DEFAULT
    vectors = parse.vectors(e).collect()
    got = {(*(r[k] for k in parse.DEFAULT.key), *(r[k] for k in names)) for r in parse.unbounded(parse.vectors(e)).collect()}
    groups: dict = {}
    for r in vectors:
        groups.setdefault(tuple(r[k] for k in parse.DEFAULT.key), []).append(tuple(r[k] for k in names))
    want = set()
    for key, vs in groups.items():
        for v in vs:
            if not any(u != v and all(a <= b for a, b in zip(u, v, strict=True)) for u in vs):
                want.add((*key, *v))
    assert got == want
    ranked = parse.ranked(e)
    best = {tuple(r[k] for k in parse.DEFAULT.key): (r.score, r.scan_ord) for r in ranked.where("parse_rank = 1").collect()}
    all_ = parse.scored(e).groupBy(*parse.DEFAULT.key).agg(F.min(F.struct("score", "scan_ord")).alias("b")).collect()
    assert best == {tuple(r[k] for k in parse.DEFAULT.key): (r.b.score, r.b.scan_ord) for r in all_}


def test_weights_and_user_constraint(spark):
    C.register("first_weak", "begins weak", lambda m: m.S.bitwiseAND(F.lit(1).cast("long")))
    try:
        meter = parse.Meter(weights={"w_stress": 10.0, "s_unstress": 2.0, "first_weak": 1.0})
        e = spark.createDataFrame([(3, 0b110, 0, 0, 0, 0, 0b111)], MASKS)  # the big cat
        row = parse.scored(e, meter).join(scansion.scansions(spark, 3), ["n", "scan_ord"]).where("meter = 'wsw'").first()
        assert (row.w_stress, row.s_unstress, row.score) == (1, 0, 10.0)
    finally:
        del C.REGISTRY["first_weak"]
    assert C.parse_weight("w_stress/2.5") == ("w_stress", 2.5) and C.parse_weight("clash") == ("clash", 1.0)


def test_zones_add_up(spark):
    e = spark.createDataFrame(list(random_units(8, 20, 3, 8)), MASKS).join(scansion.scansions(spark, 8), "n")
    for zones in (None, "initial", "foot", 3):
        suffixes = [s for s, _ in C.zones_of(F.col("n"), zones)]
        total = e.select(*C.counts(("w_stress",)), *(c for c in C.zone_counts(("w_stress",), zones) if zones is not None))
        if zones is not None:
            assert total.where(sum((F.col(f"w_stress{s}") for s in suffixes[1:]), F.col(f"w_stress{suffixes[0]}")) != F.col("w_stress")).count() == 0


@pytest.mark.parametrize(
    ("words", "want"),
    [("ba", None), ("the baba", "iambic"), ("bababa bababa", "trochaic")],
)
def test_best_parse_small(spark, words, want):
    found = parse.with_properties(parse.best(units.encoded(tokens.line_parts(texts(spark, words))))).collect()
    assert (found[0].foot_type if found else None) in ((want,) if want is None else ("iambic", "trochaic", "anapestic", "dactylic"))
    if found:
        assert len(found[0].meter_str) == found[0].n == len(found[0].stress_str)


def test_properties(spark):
    rows = [("w|s|w|s", 4), ("s|w|s|w", 4), ("ww|s|ww|s", 6), ("s|ww|s|ww", 6), ("ww", 2)]
    df = spark.createDataFrame([(p, p.replace("|", ""), n, 0, len(p.split("|")), p.count("s")) for p, n in rows], "positions string, meter string, n int, st long, n_pos int, n_strong int")
    assert [r.foot_type for r in parse.with_properties(df).collect()] == ["iambic", "trochaic", "anapestic", "dactylic", "iambic"]


# ---- rhyme and form: goldens ----

IDS = [1, 2, 1, 2, 0, 3, 0, 3, 0, 4, 5, 4, 5, 5]
FEET = [5, 5, 5, 5, 5, 5, 4, 6, 4, 4, 5, 5, 5, 5]


def test_scheme_goldens(spark):
    ids = spark.createDataFrame([("t", k + 1, v) for k, v in enumerate(IDS)], "text_id string, line_num int, rhyme_id int")
    top = rhyme.scheme_match(ids, 5).orderBy("rank").collect()
    assert [r.form for r in top] == ["Sonnet A", "Sonnet, Shakespearean", "Sonnet E", "Sonnet B", "Sonnet D"]
    assert [round(r.accuracy, 2) for r in top] == [0.70, 0.56, 0.43, 0.40, 0.36]
    sonnet = form.sonnets(
        spark.createDataFrame([("t", k, 10) for k in range(14)], "text_id string, line_num int, length int"), rhyme.scheme_match(ids)
    ).first()
    assert sonnet.is_sonnet and not sonnet.is_shakespearean_sonnet
    assert spark.range(1).select(rhyme.scheme_letters(F.array(F.lit(0), F.lit(1), F.lit(1)))).first()[0] == "-aa"


def test_template_goldens():
    assert form.best_template(FEET, True) == ((5,), 8)
    assert form.best_template([5] * 10, True)[0] == (5,)
    assert form.best_template([4, 3] * 4, True)[0] == (4, 3)


def test_template_equals_enumeration():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(3, 6) for _ in range(rng.choice([1, 2, 3, 4, 6, 8]))]
        for beat in (True, False):
            best = None
            for k in range(1, min(len(lengths), 10) + 1):
                if len(lengths) % k:
                    continue
                cols = [lengths[p::k] for p in range(k)]
                mid = [int(np.median(c)) for c in cols]
                for combo in itertools.product(*([m - 1, m, m + 1] for m in mid)):
                    if k > 1 and len(set(combo)) == 1:
                        continue
                    d = sum(abs(x - combo[i % k]) for i, x in enumerate(lengths)) * (2 if beat else 1)
                    d += (0 if beat else sum(5 for x in combo if x % 2)) + (len(set(combo)) > 1)
                    if best is None or d < best[1]:
                        best = (combo, d)
            assert form.best_template(lengths, beat) == best


def test_meter_type_golden(spark):
    labels = ["w"] * 66 + ["s"] * 67 + ["ww"] * 3 + ["ss"]
    df = spark.createDataFrame([("t", "|".join(labels), "wsws", 3)], "text_id string, positions string, meter string, k int")
    row = form.meter_type(df, ambiguity="k").first()
    assert (row.n_positions, row.n_w, row.n_s, row.n_ww, row.n_ss, row.type) == (137, 66, 67, 3, 1, "iambic")


def test_rhyming_lines(spark):
    lines = tokens.whole_lines(texts(spark, "the cat\non the mat\nsaw a dog\non a log"))
    ids = {r.line_num: r.rhyme_id for r in rhyme.rhyme_ids(lines).collect()}
    assert ids == {1: 1, 2: 1, 3: 2, 4: 2}
    assert {(r.line_num, r.partner) for r in rhyme.rhyming_lines(lines).collect()} == {(2, 1), (4, 3)}


def test_scheme_labels(spark):
    row = spark.range(1).select(
        form.scheme_repr(F.lit("5"), True).alias("a"), form.scheme_repr(F.lit("4-3"), True).alias("b"), form.scheme_repr(F.lit("4-3-4")).alias("c")
    ).first()
    assert row.a == "Pentameter" and row.b == "Alternating (tetrameter-trimeter)" and row.c == "Complex (4-3-4)"


# ---- learning ----


def test_fit_meets_its_conditions(spark):
    rows = []
    rng = random.Random(2)
    for key in range(20):
        for v in range(4):
            rows.append((key, rng.randint(0, 3), rng.randint(0, 2), 1, float(v == 0), 1 + key % 3))
    df = spark.createDataFrame(rows, "k int, a int, b int, scansions int, observed double, units int").persist()
    model = maxent.fit(df, ["k"], ["a", "b"], regularization=10.0)
    w = np.array([model.weights["a"], model.weights["b"]])
    _, g = maxent.loss(df, ["k"], ["a", "b"], model.weights)
    g = g + w / 10.0
    assert (w >= 0).all() and all(abs(x) < 0.05 if y > 0 else x > -0.05 for x, y in zip(g, w, strict=True))
    p = maxent.predicted(df, ["k"], ["a", "b"], model.weights).groupBy("k").agg(F.sum(F.col("prob") * F.col("scansions")).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in p.collect())


def test_observed_share(spark):
    candidates = spark.createDataFrame([("t", "ws"), ("t", "sw"), ("u", "ws")], "text_id string, scansion string")
    notes = spark.createDataFrame([("t", "ws", 3.0), ("t", "sw", 1.0)], "text_id string, scansion string, frequency double")
    got = {(r.text_id, r.scansion): r.observed for r in maxent.observed_share(notes, candidates).collect()}
    assert got == {("t", "ws"): 0.75, ("t", "sw"): 0.25, ("u", "ws"): 0.0}


# ---- syllables, lexicon, statistics, trees ----


def test_lexicon_takes_precedence(spark):
    lex = sylls.lexicon_from_lines(spark.createDataFrame([("record\t'rɛ.kɚd",), ("record\tɹɪ.'kɔɹd",)], "value string"))
    rows = sylls.syllables(tokens.tokens(texts(spark, "record the")), lex).where("is_punc = 0").collect()
    assert {r.num_forms for r in rows if r.word_txt == "record"} == {2}
    assert {r.is_functionword for r in rows if r.word_txt.strip() == "the"} == {True}
    forced = sylls.restressed(lex, ["record"], []).collect()
    assert [r.sylls for r in forced] in ([["rɛ", "kɚd"]], [["ɹɪ", "kɔɹd"]])


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 9)), rng.randint(0, 1)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(stats.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc - want) < 1e-5


def test_tree_stress_and_grid(spark):
    nodes = [("t", 1, 0, -1, "S", None, 0.0), ("t", 1, 1, 0, "NP", None, 0.0), ("t", 1, 2, 0, "VP", None, 0.0), ("t", 1, 3, 1, "DT", 1, -1.0), ("t", 1, 4, 1, "NN", 2, 0.0), ("t", 1, 5, 2, "VB", 3, 0.0)]
    df = spark.createDataFrame(nodes, "text_id string, sent_num int, node int, parent int, label string, word_num int, lstress double")
    words = trees.tree_stress(df)
    assert {r.word_num: r.total for r in words.collect()} == {1: -3.0, 2: -1.0, 3: 0.0}
    assert min(r.grid for r in trees.sentence_grid(words).collect()) == 1
    assert {r.norm_total for r in trees.normalized(words, "total").collect()} == {0.0, 0.666667, 1.0}


# ---- phonology and Finnish ----


def test_phonology():
    assert phonology.segment("tʃɪkən") == ["tʃ", "ɪ", "k", "ə", "n"]
    assert phonology.syllabify("kæntəbəɹi") == ["kæn", "tə", "bə", "ɹi"] and phonology.syllabify("taɪm") == ["taɪm"]
    assert phonology.rime_distance("aɪt", "aɪt") == 0 and 0 < phonology.rime_distance("aɪt", "aɪd") < phonology.rime_distance("aɪt", "oʊn")
    for cost in ("unweighted", "hamming", "partial_hamming", "weighted"):
        assert phonology.feature_edit("kæt", "kæt", cost) == 0
        assert phonology.feature_edit("kæt", "kæd", cost) == phonology.feature_edit("kæd", "kæt", cost) > 0
    assert phonology.from_xsampa("tSIn") == "tʃɪn" and phonology.error_rate(["kæt"], ["kæd"]) == pytest.approx(1 / 3)
    assert phonology.is_known("'maɪ") and not phonology.is_known("m€")
    assert phonology.orthographic_syllables("Kitten", 2) == ["Ki", "tten"] and len(phonology.orthographic_syllables("cat", 2)) == 2


def test_finnish():
    assert [finnish.syllables(w) for w in ("kalevala", "suomalainen", "maailma", "kauppaan", "opettaja")] == [
        ["ka", "le", "va", "la"], ["suo", "ma", "lai", "nen"], ["maa", "il", "ma"], ["kaup", "paan"], ["o", "pet", "ta", "ja"],
    ]
    found = finnish.annotate("kalevala")
    assert len(found) == 1 and found[0]["stresses"] == ["P", "U", "S", "U"]
    assert finnish.annotate("xyz" * 0) == [] and finnish.compounds("talo-kissa") == ["talo", "kissa"]


# ---- sources and streaming ----


def test_save_load_and_files(spark, tmp_path):
    rows = texts(spark, "one", "two")
    corpus.save(rows, str(tmp_path / "s"), {"lang": "en"})
    back, meta = corpus.load(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and meta["lang"] == "en"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "en.poem.txt").write_text(" a line\n\nanother \n")
    found = corpus.from_files(spark, str(tmp_path / "c"))
    assert found.first().lang == "en" and corpus.listing(found).first().n_lines == 2
    (tmp_path / "a.tsv").write_text("Line\tParse\nthe cat\tws\n")
    note = corpus.annotations(spark, str(tmp_path / "a.tsv")).first()
    assert (note.text, note.scansion, note.frequency) == ("the cat", "ws", 1.0)
    with pytest.raises(ValueError, match="outside"):
        corpus.safe_path("/corpora", "../etc/passwd")
    with pytest.raises(ValueError, match="no text"):
        corpus.from_strings(spark, [])


def test_status_and_resume(spark):
    rows = corpus.items(spark.createDataFrame([("a", "x"), ("b", ""), ("c", "12"), ("d", None)], "id string, txt string"))
    assert {r.text_id: r.status for r in corpus.with_status(rows).collect()} == {"a": "ok", "b": "empty", "c": "no words", "d": "empty"}
    assert corpus.pending(rows, rows.where("text_id = 'a'")).count() == 3
    with pytest.raises(Exception, match="bad item"):
        corpus.with_status(rows, "raise").collect()


def test_stream_equals_table(spark, tmp_path):
    rows = texts(spark, "the cat sat on the mat, again", "another day for all of us")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.parse_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = parse.with_properties(parse.best(units.encoded(tokens.line_parts(rows))))
    key = lambda df: sorted((r.text_id, r.line_num, r.linepart, r.meter_str) for r in df.collect())
    assert key(got) == key(want)
