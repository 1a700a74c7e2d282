"""Mojibake repair, language profiles and tree statistics on small cases."""

from metrika.functions import mojibake
from metrika.operators import languages, trees
from metrika.plans import language_queries

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def mend(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.t for r in df.select("k", mojibake.repaired(F.col("text")).alias("t")).orderBy("k").collect()]


def test_planted_double_encodings_are_restored(spark):
    texts = ["Élan vital, déjà vu", "Größe über Maß", "naïve “quotes” – and dashes…", "señor ¿qué?", "12 € ™", "Привет мир"]
    read = lambda t, code: "".join(bytes([b]).decode(code, "replace") if code == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode())
    for code in ("latin-1", "cp1252"):
        once = [read(t, code) for t in texts]
        twice = [read(t, code) for t in once]
        assert mend(spark, *once) == texts
        assert mend(spark, *twice) == texts
    assert mend(spark, "clean é and " + read("é", "latin-1")) == ["clean é and é"]


def test_clean_texts_are_left_alone(spark):
    texts = ["«CAFÉ» et «FORÊT»", "«PÅ» «JÄ»", "Â", "Ã", "", None, "plain", "château à l’école", "Ελλάδα Ïα", "50 Â", "\x80\x81"]
    assert mend(spark, *texts) == texts


def test_mojibake_query_mends_documents(spark):
    rows = language_queries.mojibake_repair(spark, SF).collect()
    assert sum(r.misread for r in rows) > 20 and sum(r.mended for r in rows) >= 0.99 * len(rows)


def test_held_out_accuracy_of_profiles(spark):
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()}
    held = [r for r in language_queries.language_profiles(spark, SF).collect() if r.held_out and r.found and truth[r.doc_id][1]]
    assert len(held) >= 30 and sum(r.found == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_profiles_of_odd_rows(spark):
    rows = [(1, "the then there", "en"), (2, None, "en"), (3, "", "xx"), (4, "der die das", "de"), (5, "les", None)]
    df = spark.createDataFrame(rows, "text_id int, text string, lang string")
    known = languages.profiles(df)
    assert {r.lang for r in known.select("lang").distinct().collect()} == {"en", "de"}
    asked = spark.createDataFrame([(1, "The there"), (1, "The there"), (2, "das"), (3, None), (4, ""), (5, "漢字"), (6, "12 34")], "text_id int, text string")
    assert {tuple(r) for r in languages.detected(asked, known).collect()} == {(1, "en"), (2, "de"), (3, None), (4, None), (5, None), (6, None)}
    assert languages.detected(asked, known.limit(0)).where("lang is not null").count() == 0
    assert languages.profiles(df.limit(0)).count() == 0


def test_statistics_of_a_tree(spark):
    # (S (NP a0 big1) (VP ran2)): a is ambiguous with one syllable, big ambiguous with two.
    nodes = [(0, 0, 9, None, "S", None, 0.0, None), (0, 0, 10, 9, "NP", None, 0.0, None), (0, 0, 11, 9, "VP", None, 0.0, None),
             (0, 0, 1, 10, "IN", 0, -0.5, 1), (0, 0, 2, 10, "IN", 1, -0.5, 2), (0, 0, 3, 11, "VB", 2, 0.0, 1)]
    df = spark.createDataFrame(nodes, "text_id int, sent_num int, node int, parent int, label string, word_num int, lstress double, n_syll int")
    rows = {r.word_num: r for r in trees.statistics(df).collect()}
    assert [(r.m1, r.m2a, r.m2b) for _, r in sorted(rows.items())] == [(-2.0, -3.0, -3.0), (-1.0, -1.0, -2.0), (0.0, 0.0, 0.0)]
    assert {(r.ambig_words, r.ambig_monosyll) for r in rows.values()} == {(2, 1)}
    assert [rows[k].lexstress for k in range(3)] == ["ambig", "ambig", "yes"]
    assert {r.contour for r in rows.values()} == {"-2.67 -1.33 0.00"}
    assert [round(rows[k].norm_m1, 6) for k in range(3)] == [0.0, 0.5, 1.0] and [rows[k].word_index for k in range(3)] == [1, 2, 3]
    alone = trees.statistics(df.where("node = 3")).collect()
    assert [(r.m1, r.norm_m1) for r in alone] == [(0.0, None)]
    assert trees.statistics(df.limit(0)).count() == 0
