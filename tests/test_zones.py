"""Constraints by zone in scores and in learning, and learning from annotated scansions, against enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.operators import constraints as C
from metrika.operators import maxent, parse, scansion, tokens, units

TEXTS = ["the little river sang and went away", "all of the days", "when shall we see them now", "stone bridge"]
KEY = ["n", *units.MASKS]


def frame(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")


def listed(spark, rows, names):
    """Every scansion of every row of masks: (row, counts)."""
    table = scansion.scansions(spark)
    found = rows.join(table, "n").select(*rows.columns, "meter", "scan_ord", "positions", *C.counts(names))
    return found.collect()


@pytest.mark.parametrize("zones", [None, "initial", "foot", 3])
def test_zones_add_up_to_the_whole(spark, zones):
    names = ("w_stress", "unres_within", "clash")
    every = C.zoned(names, zones, 18)
    rows = units.masked(units.rhythms(tokens.line_parts(frame(spark))), ["text_id"])
    whole = {(r.text_id, r.scan_ord): r for r in listed(spark, rows, names)}
    for r in listed(spark, rows, every):
        for k in names:
            assert sum(r[c] for c in every if c == k or c.startswith(k + "_")) == whole[r.text_id, r.scan_ord][k]
    assert len(every) == len(names) * {None: 1, "initial": 2, "foot": 9, 3: 3}[zones] and len(C.zone_suffixes("foot", 6)) == 3
    with pytest.raises(ValueError, match="zones"):
        C.zone_suffixes("middle")


def test_zone_weights_score_parses(spark):
    names = C.zoned(C.DEFAULT, "initial")
    meter = parse.Meter({k: 0.5 if k.endswith("_init") else 2.0 + 0.25 * i for i, k in enumerate(names)})
    lines = tokens.line_parts(frame(spark))
    got = {r.text_id: (round(r.score, 6), r.variant, r.scan_ord) for r in parse.best_of(lines, meter).collect()}
    want = {}
    for r in listed(spark, units.encoded(lines), names):
        here = (round(sum(meter.weights[k] * r[k] for k in names), 6), r.variant, r.scan_ord)
        want[r.text_id] = min(want.get(r.text_id, here), here)
    assert got == want


def test_gradient_by_zone_equals_enumeration(spark):
    names = C.zoned(("w_stress", "s_unstress", "unres_within"), 3)
    weights = {k: 0.2 * i for i, k in enumerate(names)}
    notes = spark.createDataFrame(
        [(TEXTS[0], "-+-+-+-+-+", 3.0), (TEXTS[0], "+-+-+-+-+-", 1.0), (TEXTS[1], "wsws", None), (TEXTS[1], "-+", 5.0), (TEXTS[2], "sws www", 2.0), ("pst", "-", 1.0), (None, "-+", 1.0)],
        "text string, scansion string, frequency double",
    )
    rhythms = maxent.annotated_rhythms(notes, list(names))
    got = {r.name: r for r in maxent.violations(rhythms, KEY, list(names), weights).collect()}
    words = spark.createDataFrame([(t, t.split()) for t in TEXTS[:3]], "text string, words array<string>")
    by = {}
    for r in listed(spark, units.masked(units.rhythms(words), ["text"]), names):
        by.setdefault(r.text, []).append((r.meter, np.array([r[k] for k in names])))
    shares = {TEXTS[0]: {"wswswswsws": 0.75, "swswswswsw": 0.25}, TEXTS[1]: {"wsws": 1.0}, TEXTS[2]: {"swswww": 1.0}}
    seen, expected, used = np.zeros(len(names)), np.zeros(len(names)), 0
    w = np.array(list(weights.values()))
    for t, all_ in by.items():
        own = {m: f for m, f in shares[t].items() if m in {m for m, _ in all_}}
        if not own:
            continue
        used += 1
        mass = [math.exp(-float(v @ w)) for _, v in all_]
        expected += sum(m * v for m, (_, v) in zip(mass, all_, strict=True)) / sum(mass)
        seen += sum(own.get(m, 0) / sum(own.values()) * v for m, v in all_)
    assert used and np.allclose([got[k].observed for k in names], seen) and np.allclose([got[k].predicted for k in names], expected)
    assert rhythms.agg(F.sum("units")).first()[0] == used


def test_fit_of_annotations(spark):
    notes = spark.createDataFrame([(TEXTS[1], "-+-+", 9.0), (TEXTS[1], "+-+-", 1.0), (TEXTS[3], "+-", 1.0)], "text string, scansion string, frequency double")
    model, rhythms = maxent.fit_annotations(notes, ("w_stress", "s_unstress"), zones="initial", regularization=10.0, rounds=30)
    totals = maxent.violations(rhythms, KEY, list(model.weights), model.weights)
    # At the optimum observed and predicted violations differ by the penalty alone.
    for r in totals.collect():
        gap = r.observed - r.predicted + r.weight / 10.0
        assert abs(gap) < 1e-3 if r.weight > 0 else gap > -1e-3
    text = maxent.report(model, totals)
    assert "observed" in text and "w_stress_init" in text and text.splitlines()[-1].startswith("loss")
    assert maxent.annotated_rhythms(notes.limit(0), ["w_stress"]).count() == 0
    parse.best_of(tokens.line_parts(frame(spark)), parse.Meter({k: w + 0.5 for k, w in model.weights.items()})).collect()
    bad = spark.createDataFrame([(TEXTS[1], "-+-+", -1.0)], notes.schema)
    with pytest.raises(Exception, match="below zero"):
        maxent.annotated_rhythms(bad, ["w_stress"]).collect()
