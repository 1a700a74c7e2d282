"""MaxEnt learning of constraint weights: distributed likelihood, a small optimiser on the driver.

A unit's candidates are its distinct violation vectors with multiplicities. One
aggregation per iteration gives the negative log-likelihood and its gradient
over all units; only these few numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.functions import text
from metrika.sources.scratch import written

from . import bounding, scansion, units
from . import constraints as C


@dataclass(frozen=True)
class MeterModel:
    """Learned non-negative weights by constraint, and how the fit ended."""

    weights: dict[str, float]
    loss: float
    iterations: int


def observed_share(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (text_id, scansion, ...) with `observed`: each text's annotated frequencies divided by their sum."""
    freq = annotations.groupBy("text_id", "scansion").agg(F.sum(F.coalesce("frequency", F.lit(1.0))).alias("frequency"))
    joined = candidates.join(freq, ["text_id", "scansion"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))
    total = joined.groupBy("text_id").agg(F.sum("frequency").alias("total__"))
    share = F.when(F.col("total__") > 0, F.col("frequency") / F.col("total__")).otherwise(0.0)
    return joined.join(total, "text_id").withColumn("observed", share).drop("total__")


def energy(names: list[str], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k in names:
        total = total + F.col(k) * float(weights.get(k, 0.0))
    return total


def predicted(vectors: DataFrame, key: list[str], names: list[str], weights: dict[str, float], size: str = "scansions") -> DataFrame:
    """Adds prob: exp(-energy) over the sum of its unit, each vector's scansions counted (prob is of one scansion)."""
    rows = vectors.withColumn("energy__", energy(names, weights))
    top = rows.groupBy(*key).agg(F.min("energy__").alias("least__"))
    rows = rows.join(top, key).withColumn("mass__", F.exp(F.col("least__") - F.col("energy__")))
    total = rows.groupBy(*key).agg(F.sum(F.col("mass__") * F.col(size)).alias("total__"))
    return rows.join(total, key).withColumn("prob", F.col("mass__") / F.col("total__")).drop("energy__", "least__", "mass__", "total__")


def loss(vectors: DataFrame, key: list[str], names: list[str], weights: dict[str, float]) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and gradient over rows (key, counts, scansions, observed, units).

    `observed` is the observed share of the vector's scansions in its unit,
    `units` how many units have the key. Two aggregations, both partial.
    """
    rows = vectors.withColumn("energy__", energy(names, weights))
    mass = F.exp(-F.col("energy__")) * F.col("scansions")
    per = rows.groupBy(*key).agg(
        F.max("units").alias("units"),
        F.sum("observed").alias("seen"),
        F.sum(mass).alias("z"),
        F.sum(F.col("observed") * F.col("energy__")).alias("own"),
        *(F.sum(mass * F.col(k)).alias(f"e_{k}") for k in names),
        *(F.sum(F.col("observed") * F.col(k)).alias(f"o_{k}") for k in names),
    )
    out = per.agg(
        F.sum(F.col("units") * (F.col("own") + F.col("seen") * F.log("z"))).alias("loss"),
        *(F.sum(F.col("units") * (F.col(f"o_{k}") - F.col("seen") * F.col(f"e_{k}") / F.col("z"))).alias(k) for k in names),
    ).first()
    return float(out["loss"] or 0.0), np.array([float(out[k] or 0.0) for k in names])


def fit(vectors: DataFrame, key: list[str], names: list[str], regularization: float = 100.0, rounds: int = 60, tolerance: float = 1e-4) -> MeterModel:
    """Weights >= 0 that minimise loss + |w|^2 / (2 * regularization), from rows of vectors (see `loss`)."""
    return _minimised(lambda w: loss(vectors, key, names, dict(zip(names, w.tolist(), strict=True))), names, regularization, rounds, tolerance)


def _minimised(
    sums: Callable[[np.ndarray], tuple[float, np.ndarray]], names: list[str], regularization: float, rounds: int, tolerance: float
) -> MeterModel:
    """Projected quasi-Newton steps from 0."""

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = sums(w)
        return f + float(w @ w) / (2 * regularization), g + w / regularization

    w = np.zeros(len(names))
    f, g = value(w)
    h = np.eye(len(names)) / max(float(np.abs(g).max()), 1.0)
    k = 0
    for k in range(1, rounds + 1):
        free = ~((w <= 0) & (g > 0))
        if float(np.abs(np.where(free, g, 0)).max(initial=0)) <= tolerance * max(1.0, abs(f)):
            break
        move = np.zeros(len(w))
        move[free] = -(h[np.ix_(free, free)] @ g[free])
        step = 1.0
        for _ in range(20):
            new = np.maximum(w + step * move, 0)
            nf, ng = value(new)
            if nf <= f + 1e-4 * float(g @ (new - w)):
                break
            step /= 2
        else:
            break
        s, y = new - w, ng - g
        if float(s @ y) > 1e-12:
            rho, eye = 1 / float(s @ y), np.eye(len(w))
            h = (eye - rho * np.outer(s, y)) @ h @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        w, f, g = new, nf, ng
    return MeterModel(dict(zip(names, w.tolist(), strict=True)), f, k)


# ---- sums over all scansions, without making them ----


def _forward_backward(n: np.ndarray, masks: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the sum of exp(-energy) over all scansions of each rhythm, and the expected counts (rhythms, constraints).

    masks are the columns of `bounding.costs`. Syllable by syllable over the pairs
    of neighbouring states, for a whole batch at once.
    """
    k, size = len(weight), int(n.max(initial=0))
    states, pairs = bounding.STATES, bounding.PAIRS
    bit = lambda p, i: np.stack([(masks[p * k + c] >> i) & 1 for c in range(k)], axis=1)
    rows = np.arange(len(n))
    forward = np.full((size + 1, len(states), len(n)), -np.inf)
    cost = {}
    for i in range(size):
        for p, (before, here) in enumerate(pairs):
            if (before is None) != (i == 0):
                continue
            cost[i, p] = -(bit(p, i) @ weight)
            to = states.index(here)
            came = 0.0 if before is None else forward[i - 1, states.index(before)]
            forward[i, to] = np.logaddexp(forward[i, to], came + cost[i, p])
    log_z = np.logaddexp.reduce(forward[n - 1, :, rows], axis=1)
    backward = np.full((size + 1, len(states), len(n)), -np.inf)
    expected = np.zeros((len(n), k))
    for i in range(size - 1, -1, -1):
        backward[i][:, n == i + 1] = 0.0
        for p, (before, here) in enumerate(pairs):
            if before is not None and i + 1 < size:
                come, go = states.index(before), backward[i + 1, states.index(here)] + cost[i + 1, p]
                backward[i, come] = np.logaddexp(backward[i, come], go)
        for p, (before, here) in enumerate(pairs):
            if (i, p) in cost:
                came = 0.0 if before is None else forward[i - 1, states.index(before)]
                share = np.exp(came + cost[i, p] + backward[i, states.index(here)] - log_z)
                expected += np.where(i < n, share, 0.0)[:, None] * bit(p, i)
    return log_z, expected


def expectations(rhythms: DataFrame, key: list[str], names: list[str], weights: dict[str, float]) -> DataFrame:
    """Distinct rhythms with their `bounding.costs` columns -> key, log_z and e_<name>, summed over all scansions of each.

    For local constraints and positions of at most two syllables; in time
    proportional to the syllables, not to the scansions.
    """
    weight = np.array([float(weights.get(k, 0.0)) for k in names])
    columns = [f"c{k}" for k in range(len(bounding.PAIRS) * len(names))]
    kinds = dict(rhythms.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                masks = [batch.column(len(key) + k).to_numpy() for k in range(len(columns))]
                log_z, expected = _forward_backward(batch.column(key.index("n")).to_numpy(), masks, weight)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(len(key))), pa.array(log_z), *(pa.array(expected[:, k]) for k in range(len(names)))],
                    names=[*key, "log_z", *(f"e_{k}" for k in names)],
                )

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "log_z double", *(f"e_{k} double" for k in names)])
    return rhythms.select(*key, *columns).mapInArrow(run, schema)


def fit_rhythms(rhythms: DataFrame, key: list[str], names: list[str], regularization: float = 100.0, rounds: int = 60, tolerance: float = 1e-4) -> MeterModel:
    """Weights learned from rhythms with costs, `units` (how many observations) and o_<name> (their counts of violations, summed).

    Each step is one pass over the distinct rhythms, each with its units in its
    own row, so that nothing is joined or shuffled; what was observed is summed
    once. Only the sums come to the driver.
    """
    first = rhythms.agg(*(F.sum(f"o_{k}").alias(f"o_{k}") for k in names)).first()
    seen = np.array([float(first[f"o_{k}"] or 0.0) for k in names])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray]:
        both = expectations(rhythms, [*key, "units"], names, dict(zip(names, w.tolist(), strict=True)))
        out = both.agg(F.sum(F.col("units") * F.col("log_z")).alias("z"), *(F.sum(F.col("units") * F.col(f"e_{k}")).alias(f"e_{k}") for k in names)).first()
        return float(out["z"] or 0.0) + float(seen @ w), seen - np.array([float(out[f"e_{k}"] or 0.0) for k in names])

    return _minimised(sums, names, regularization, rounds, tolerance)


def annotated_rhythms(annotations: DataFrame, names: list[str], longest: int = units.LONGEST) -> DataFrame:
    """(text, scansion, frequency) -> distinct rhythms for `fit_rhythms`: n and the masks, cost columns, units, o_<name>.

    A scansion has a sign a syllable: w, W or - weak, s, S or + strong, anything else left out.
    Each text weighs one: its scansions have their shares of its frequencies (a
    null one counts 1; below zero is refused). Scansions that the text's
    syllables cannot have are left out, and so are texts without any other.
    Texts are read by their first forms. Names may be zoned ones.
    """
    signs = F.regexp_replace(F.translate(F.lower("scansion"), "+-", "sw"), "[^ws]", "")
    often = F.coalesce(F.col("frequency").cast("double"), F.lit(1.0))
    often = F.when(often >= 0, often).otherwise(F.raise_error(F.lit("a frequency below zero")).cast("double"))
    rows = annotations.select("text", signs.alias("meter"), often.alias("often")).groupBy("text", "meter").agg(F.sum("often").alias("often"))
    words = rows.select("text").distinct().where(F.col("text").isNotNull()).select("text", text.word_array(F.col("text")).alias("words"))
    encoded = units.masked(units.rhythms(words, longest), ["text"])
    catalogue = scansion.scansions(annotations.sparkSession, longest)
    found = rows.join(encoded, "text").join(F.broadcast(catalogue), ["n", "meter"]).select("text", "often", "n", *units.MASKS, *C.counts(tuple(names)))
    total = found.groupBy("text").agg(F.sum("often").alias("all__")).where("all__ > 0")
    share = F.col("often") / F.col("all__")
    key = ["n", *units.MASKS]
    sums = found.join(total, "text").groupBy(*key).agg(F.sum(share).alias("units"), *(F.sum(share * F.col(k)).alias(f"o_{k}") for k in names))
    return sums.select(*key, *bounding.costs(tuple(names)), "units", *(f"o_{k}" for k in names))


def fit_annotations(
    annotations: DataFrame, names: tuple[str, ...] = C.DEFAULT, zones: str | int | None = None, regularization: float = 100.0, rounds: int = 60, longest: int = units.LONGEST
) -> tuple[MeterModel, DataFrame]:
    """Weights (by zone, if there are zones) learned from annotated scansions, and the rhythms they were learned from, written.

    The model's weights are a meter's: parse.Meter(model.weights).
    """
    every = list(C.zoned(names, zones, longest))
    rhythms = written(annotated_rhythms(annotations, every, longest), "annotated")
    return fit_rhythms(rhythms, ["n", *units.MASKS], every, regularization, rounds), rhythms


def violations(rhythms: DataFrame, key: list[str], names: list[str], weights: dict[str, float]) -> DataFrame:
    """(name, weight, observed, predicted): each constraint's violations as annotated and as the weights predict them, over all units."""
    seen = rhythms.select(*key, "units", *(f"o_{k}" for k in names))
    both = expectations(rhythms, key, names, weights).join(seen, key)
    sums = both.agg(*(F.sum(f"o_{k}").alias(f"o_{k}") for k in names), *(F.sum(F.col("units") * F.col(f"e_{k}")).alias(f"e_{k}") for k in names))
    one = lambda k: F.struct(F.lit(k).alias("name"), F.lit(float(weights.get(k, 0.0))).alias("weight"), F.col(f"o_{k}").cast("double").alias("observed"), F.col(f"e_{k}").alias("predicted"))
    return sums.select(F.inline(F.array(*map(one, names))))


def report(model: MeterModel, totals: DataFrame | None = None) -> str:
    """The learned weights, the heaviest first, with the `violations` observed and predicted if given, and how the fit ended."""
    width = max(map(len, model.weights), default=0)
    seen = {r.name: f"  observed {r.observed or 0:.2f}  predicted {r.predicted or 0:.2f}" for r in totals.collect()} if totals is not None else {}
    rows = sorted(model.weights.items(), key=lambda x: (-x[1], x[0]))
    return "\n".join([f"{name:<{width}}  {weight:.4f}{seen.get(name, '')}" for name, weight in rows] + [f"loss {model.loss:.4f} after {model.iterations} iterations"])


def accuracy(predictions: DataFrame, key: list[str]) -> DataFrame:
    """One row: n units with an observation, share whose likeliest scansion (ties to the first) is the most observed one."""
    rows = predictions.groupBy(*key).agg(
        F.max_by("scan_ord", F.struct("prob", -F.col("scan_ord"))).alias("guess"),
        F.max_by("scan_ord", F.struct("observed", -F.col("scan_ord"))).alias("truth"),
        F.sum("observed").alias("seen"),
    )
    return rows.where("seen > 0").agg(F.count("*").alias("n_units"), F.round(F.avg((F.col("guess") == F.col("truth")).cast("double")), 6).alias("accuracy"))
