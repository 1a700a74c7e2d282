"""Parsing: scansions of every distinct unit are scored; dominated ones are dropped; the rest are ranked.

Units are first reduced to distinct signatures (the masks that the constraints
read), so equal rhythms are parsed once. The best parse is found in one pass over a
unit's syllables, undominated scansions from left to right, both without making
all scansions; `scored` makes them where all are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import bounding, scansion, units
from . import constraints as C


@dataclass(frozen=True)
class Meter:
    """Constraints by weight and the sizes of positions."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(C.DEFAULT, 1.0))
    max_s: int = 2
    max_w: int = 2
    longest: int = units.LONGEST

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.weights)

    @property
    def key(self) -> list[str]:
        return ["n", *C.needs(self.names)]


DEFAULT = Meter()
MILLION = 1_000_000


def signatures(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """The distinct keys of a meter among encoded units."""
    return encoded.select(*meter.key).distinct()


def scored(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """signature x scansion with a count for each constraint and the weighted score."""
    table = F.broadcast(scansion.scansions(encoded.sparkSession, meter.longest, meter.max_s, meter.max_w))
    joined = signatures(encoded, meter).join(table, "n")
    return joined.select(*meter.key, "scan_ord", *C.counts(meter.names)).withColumn("score", C.score(meter.names, meter.weights))


def _code(meter: Meter, variant: Column | int = 0) -> Column:
    """Score (to a millionth), variant and order packed into a long, which aggregates in a hash map."""
    if min(meter.weights.values()) < 0:
        raise ValueError("weights must not be negative")
    score = F.round(F.col("score") * 1_000_000).cast("long")
    return (score * (1 << 21) + (F.lit(variant) if isinstance(variant, int) else variant).cast("long") * (1 << 20) + F.col("scan_ord")).alias("code")


def _decoded() -> list[Column]:
    last = lambda bits: F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    return [(F.shiftright("code", 21) / 1_000_000).alias("score"), F.shiftright(last(21), 20).cast("int").alias("variant"), last(20).cast("int").alias("scan_ord")]


def _candidates(encoded: DataFrame, meter: Meter) -> DataFrame:
    """Signatures with the scansions that may be their best parse.

    A dominated scansion never has the lowest score while all weights are
    positive; with a weight of zero it may tie, so only undominated ones compete.
    """
    if min(meter.weights.values()) > 0:
        return scored(encoded, meter)
    return undominated(encoded, meter).select(*meter.key, *meter.names, "score", "scan_ord")


def best(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """The best parse of every encoded unit: lowest score, then variant, then enumeration order."""
    per_signature = _candidates(encoded, meter).groupBy(*meter.key).agg(F.min(_code(meter)).alias("code"))
    per_signature = per_signature.select(*meter.key, *_decoded()).drop("variant")
    ids = [c for c in encoded.columns if c not in ("variant", "n", "words", *units.MASKS)]
    at = encoded.join(per_signature, meter.key).select(*ids, "variant", "n", *units.MASKS, "score", "scan_ord")
    others = [c for c in at.columns if c not in (*ids, "score", "variant")]
    pick = at.groupBy(*ids).agg(F.min_by(F.struct("score", "variant", *others), F.struct("score", "variant")).alias("p"))
    table = scansion.scansions(encoded.sparkSession, meter.longest, meter.max_s, meter.max_w)
    return pick.select(*ids, "p.*").join(F.broadcast(table), ["n", "scan_ord"])


def additive(meter: Meter) -> bool:
    """Whether one pass over a rhythm finds its best parse: neighbouring syllables decide, and weights are whole millionths above zero."""
    local = meter.max_s == meter.max_w == 2 and meter.longest <= 20 and all(C.REGISTRY[k].local for k in meter.names)
    return local and all(w > 0 and math.isclose(w * MILLION, round(w * MILLION), rel_tol=1e-12) for w in meter.weights.values())


def _lightest(meter: Meter):
    """An Arrow function of n and the cost masks of both variants (null without a second one) -> score in millionths, variant, scan_ord."""
    weights = np.array([round(w * MILLION) for w in meter.weights.values()], np.int64)
    kind = StructType([StructField("score", LongType()), StructField("variant", IntegerType()), StructField("scan_ord", IntegerType())])

    @F.arrow_udf(kind)
    def found(n: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        size = n.to_numpy().astype(np.int64)
        score, place = bounding.lightest(size, first.flatten().to_numpy(), weights, meter.longest)
        two = np.flatnonzero(second.is_valid().to_numpy(zero_copy_only=False))
        variant = np.zeros(len(size), np.int32)
        if len(two):
            other, at = bounding.lightest(size[two], second.drop_null().flatten().to_numpy(), weights, meter.longest)
            less = other < score[two]
            score[two[less]], place[two[less]], variant[two[less]] = other[less], at[less], 1
        return pa.StructArray.from_arrays([pa.array(score), pa.array(variant), pa.array(place.astype(np.int32))], names=["score", "variant", "scan_ord"])

    return found


def _both(rows: DataFrame, ids: list[str], meter: Meter) -> tuple[DataFrame, Column]:
    """Rows of n, he, wb, st, amb with c0__, the costs of the first variant, and masks for the second's; the second's costs, null without one."""
    costs = F.array(*bounding.costs(meter.names))
    one = units.masked(rows, [*ids, "amb"]).select(*ids, "amb", "n", "he", "wb", "st", costs.alias("c0__"))
    two = units.masked(one.withColumn("st", F.col("st").bitwiseOR(F.col("amb"))), [*ids, "amb", F.col("st").alias("st2__"), "c0__"])
    return two, F.when(F.col("amb") != 0, costs)


def fronts(rhythms: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """Distinct r1, r2 (packed rhythms, see `units.unpacked`) -> adds v, many, size and lead: each rhythm's undominated vectors of both variants.

    v: array of packed counts, see `bounding.sum_width`; many: how many scansions
    have each; size: how many have any; lead: the counts of the best one, the
    least by the meter's order among equals. For meters as `sums_local` has them.
    """
    if not sums_local(meter):
        raise ValueError("constraints are local and their counts fit a long")
    # Most rhythms that the constraints don't tell apart differ in heavy syllables alone: they come side by side.
    near = ["n", "wb", "st", "amb"]
    rows = rhythms.select("r1", "r2", *units.unpacked("r1", "r2"))
    rows = rows.repartition(int(rhythms.sparkSession.conf.get("spark.sql.shuffle.partitions")), *near).sortWithinPartitions(*near)
    rows, second = _both(rows, ["r1", "r2"], meter)
    names, weights = meter.names, list(meter.weights.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (first, other) = batch.column(2).to_numpy().astype(np.int64), (batch.column(k) for k in (3, 4))
            masks = [x.drop_null().flatten().to_numpy().reshape(-1, len(bounding.PAIRS) * len(names)) for x in (first, other)]
            offsets, v, many = bounding.fronts(n, *masks, other.is_valid().to_numpy(zero_copy_only=False), len(names), meter.longest)
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (v, many)]
            size, lead = np.add.reduceat(many, offsets[:-1]), bounding.leads(offsets, v, weights, meter.longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(size), pa.array(lead)], names=["r1", "r2", "v", "many", "size", "lead"])

    return rows.select("r1", "r2", "n", "c0__", second.alias("c1__")).mapInArrow(run, "r1 long, r2 long, v array<long>, many array<long>, size long, lead long")


def sums_local(meter: Meter) -> bool:
    """Whether fronts and their sums are told syllable by syllable, in packed counts."""
    return local(meter) and bounding.sums_fit(len(meter.names), meter.longest) and min(meter.weights.values()) >= 0


def kept_sums(meter: Meter):
    """An Arrow function of v and many of two fronts -> how many pairs of their scansions no other pair dominates."""

    @F.arrow_udf(LongType())
    def kept(va: pa.Array, ma: pa.Array, vb: pa.Array, mb: pa.Array) -> pa.Array:
        flat = lambda x: x.flatten().to_numpy()
        ends = lambda x: np.append(0, np.cumsum(pc.list_value_length(x).to_numpy().astype(np.int64)))
        return pa.array(bounding.kept_sums(ends(va), flat(va), flat(ma), ends(vb), flat(vb), flat(mb), len(meter.names), meter.longest))

    return kept


def likeliest(rhythms: DataFrame, meter: Meter) -> DataFrame:
    """Distinct rhythms (meter.key) -> adds least, the lowest score, and scan_ord, the first scansion that has it.

    One min-plus pass, for meters as in `best_of` (see `additive`).
    """
    if not additive(meter):
        raise ValueError("weights are whole millionths above zero, constraints local")
    found = _lightest(meter)("n", F.array(*bounding.costs(meter.names)), F.lit(None).cast("array<bigint>"))
    return rhythms.withColumn("b__", found).select(*rhythms.columns, (F.col("b__.score") / MILLION).alias("least"), "b__.scan_ord")


def best_of(lines: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """The best parse of every unit with `words`, as `best` gives it of the encoded units.

    Both variants of a unit are told by its rhythm (n, he, wb, st, amb). Each
    unit's scansions are weighed in one min-plus pass over its syllables, a batch
    of units at a time: one scan, no shuffle. Meters whose constraints need more
    than neighbouring syllables, or with weights of zero, are parsed once a
    distinct rhythm.
    """
    if set(meter.key) - {"n", *units.MASKS}:
        raise ValueError("the meter reads more than the words tell; encode the units and use best")
    rows = units.rhythms(lines, meter.longest).drop("words")
    ids = [c for c in lines.columns if c != "words"]
    both = F.when(F.col("variant") == 1, F.col("st").bitwiseOR(F.col("amb"))).otherwise(F.col("st"))
    if additive(meter):
        two, second = _both(rows, ids, meter)
        at = two.select(*ids, "n", "he", "wb", F.col("st").bitwiseAND(F.bitwise_not("amb")).alias("st"), "amb", _lightest(meter)("n", "c0__", second).alias("b__"))
        at = at.select(*ids, "n", "he", "wb", "st", "amb", (F.col("b__.score") / MILLION).alias("score"), "b__.variant", "b__.scan_ord")
    else:
        key = ["n", "he", "wb", "st", "amb"]
        distinct = rows.select(*key).distinct()
        encoded = units.variants(distinct.select(*key, *(F.col(c).alias(f"{c}_") for c in key)))
        of = [f"{c}_" for c in key]
        if min(meter.weights.values()) > 0:
            table = F.broadcast(scansion.scansions(lines.sparkSession, meter.longest, meter.max_s, meter.max_w))
            found = encoded.join(table, "n").select(*of, "variant", "scan_ord", *C.counts(meter.names)).withColumn("score", C.score(meter.names, meter.weights))
        else:
            found = encoded.join(_candidates(encoded, meter).select(*meter.key, "score", "scan_ord"), meter.key)
        per = found.groupBy(*of).agg(F.min(_code(meter, F.col("variant"))).alias("code")).select(*(F.col(f"{c}_").alias(c) for c in key), *_decoded())
        at = rows.join(per, key)
    chosen = units.masked(at.withColumn("st", both), [*ids, "variant", "score", "scan_ord"])
    return chosen.join(F.broadcast(scansion.scansions(lines.sparkSession, meter.longest, meter.max_s, meter.max_w)), ["n", "scan_ord"])


def vectors(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """Distinct violation vectors of every signature with how many scansions have them and the first."""
    return (
        scored(encoded, meter)
        .groupBy(*meter.key, *meter.names, "score")
        .agg(F.count("*").alias("scansions"), F.min("scan_ord").alias("scan_ord"))
    )


def unbounded(found: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """The vectors of `vectors` that no other of their signature dominates."""
    return undominated_of(found, meter.key, meter.names)


def undominated_of(found: DataFrame, key: list[str], names: tuple[str, ...]) -> DataFrame:
    """The rows that no other of their key dominates (as few of every violation, fewer of one), of any number of constraints.

    Each signature's vectors of least total and of least count in every
    constraint thin the rest first: what one of them dominates (everything, if
    one is perfect) is gone without a pair. The anti-join decides what is left.
    """
    total = sum((F.col(k) for k in names[1:]), F.col(names[0]))
    vector = F.struct(*names)
    firsts = [total, *(F.col(k) for k in names)]
    leads = found.groupBy(*key).agg(
        *(F.min(F.struct(first.alias("f"), total.alias("t"), vector.alias("v"))).alias(f"lead{j}") for j, first in enumerate(firsts))
    )
    kept = F.lit(True)
    for j in range(len(firsts)):
        worse, same = F.lit(True), F.lit(True)
        for k in names:
            own = F.col(f"lead{j}.v.{k}")
            worse &= own <= F.col(k)
            same &= own == F.col(k)
        kept &= ~worse | same
    left = found.join(leads, key).where(kept).drop(*(f"lead{j}" for j in range(len(firsts))))
    a, b = left.alias("a"), left.select(*key, *names).alias("b")
    on, less = F.lit(True), F.lit(False)
    for k in key:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    for k in names:
        on &= F.col(f"b.{k}") <= F.col(f"a.{k}")
        less |= F.col(f"b.{k}") < F.col(f"a.{k}")
    return a.join(b, on & less, "left_anti")


def undominated(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """signature, counts, score, scansions (how many share the counts), scan_ord (the first) and places (all, ascending).

    Where all constraints are local and positions have at most two syllables, a
    distinct signature is walked once from left to right (see `bounding`); else
    all scansions are scored and compared.
    """
    if meter.max_s == meter.max_w == 2 and all(C.REGISTRY[k].local for k in meter.names):
        found = _walked(encoded, meter)
    else:
        kept = unbounded(vectors(encoded, meter), meter).select(*meter.key, *meter.names)
        rows = scored(encoded, meter).join(kept, [*meter.key, *meter.names], "left_semi")
        found = rows.groupBy(*meter.key, *meter.names).agg(F.array_sort(F.collect_list("scan_ord")).alias("places"))
    return found.select(
        *meter.key, *meter.names, C.score(meter.names, meter.weights).alias("score"), F.size("places").cast("long").alias("scansions"),
        F.col("places")[0].alias("scan_ord"), "places",
    )


def _walked(encoded: DataFrame, meter: Meter) -> DataFrame:
    spark, key, names, longest = encoded.sparkSession, meter.key, meter.names, meter.longest
    rows = signatures(encoded, meter)
    kinds = dict(rows.dtypes)
    # Signatures are few bytes but much work each: as many parts as a shuffle has, not as few as their size suggests.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).select(*key, *bounding.costs(names))

    together = bounding.fits(len(names), longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, bounding.TOGETHER):
                part = batch.slice(first, bounding.TOGETHER)
                n = part.column(0).to_numpy().astype(np.int64)
                masks = [part.column(k).to_numpy() for k in range(len(key), part.num_columns)]
                if together:
                    row, counts, offsets, places = bounding.walk_together(n, masks, len(names), longest)
                    columns = [pa.array(counts[:, k].astype(np.int32)) for k in range(len(names))]
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32)))
                else:
                    found = list(bounding.walk(n, masks, len(names), longest))
                    row = [r for r, _, _ in found]
                    columns = [pa.array([c[k] for _, c, _ in found], pa.int32()) for k in range(len(names))]
                    lists = pa.array([p for _, _, p in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row, pa.int64())) for k in range(len(key))), *columns, lists], names=[*key, *names, "places"])

    schema = [f"{k} {kinds[k]}" for k in key] + [f"`{k}` int" for k in names] + ["places array<int>"]
    return rows.mapInArrow(run, ", ".join(schema))


def _per_rhythm(encoded: DataFrame, meter: Meter, tell, names: list[str]) -> DataFrame:
    """Distinct signatures -> their key and the longs that tell(n, cost masks) gives of a batch of them, each in its own row."""
    spark, key = encoded.sparkSession, meter.key
    rows = signatures(encoded, meter)
    kinds = dict(rows.dtypes)
    # Most rhythms that the constraints don't tell apart differ in heavy syllables alone: they come side by side.
    near = [k for k in key if k != "he"]
    near = near if len(near) > 1 else key
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *near).sortWithinPartitions(*near).select(*key, *bounding.costs(meter.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, bounding.TOGETHER):
                part = batch.slice(first, bounding.TOGETHER)
                masks = [part.column(k).to_numpy() for k in range(len(key), part.num_columns)]
                told = tell(part.column(0).to_numpy().astype(np.int64), masks)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(key))), *(pa.array(x) for x in told)], names=[*key, *names])

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), *(f"`{k}` long" for k in names)]))


def local(meter: Meter) -> bool:
    """Whether neighbouring syllables decide all constraints, so that scansions need not be made."""
    return meter.max_s == meter.max_w == 2 and meter.longest <= 20 and all(C.REGISTRY[k].local for k in meter.names)


def totals(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """signature, n_scansions and each constraint's violations, summed over all scansions of every distinct signature.

    Local constraints are summed by syllables, with how many scansions have each
    pair of neighbouring states there; else all scansions are made.
    """
    if not local(meter):
        return scored(encoded, meter).groupBy(*meter.key).agg(F.count("*").alias("n_scansions"), *(F.sum(k).alias(k) for k in meter.names))

    def tell(n, masks):
        many, sums = bounding.summed(n, masks, len(meter.names), meter.longest)
        return [many, *sums.T]

    return _per_rhythm(encoded, meter, tell, ["n_scansions", *meter.names])


def score_range(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """signature, least and mean: the lowest and the average score over all scansions of every distinct signature.

    For local constraints and weights as in `additive` the lowest comes from a
    min-plus pass and the average from sums by syllables; else all scansions are made.
    """
    if not additive(meter):
        return scored(encoded, meter).groupBy(*meter.key).agg(F.min("score").alias("least"), F.avg("score").alias("mean"))
    names = list(meter.names)
    weights = np.array([round(w * MILLION) for w in meter.weights.values()], np.int64)

    def tell(n, masks):
        least, _ = bounding.lightest(n, np.column_stack(masks), weights, meter.longest)
        many, sums = bounding.summed(n, masks, len(names), meter.longest)
        return [least, many, *sums.T]

    rows = _per_rhythm(encoded, meter, tell, ["least__", "many__", *names])
    return rows.select(*meter.key, (F.col("least__") / MILLION).alias("least"), (C.score(meter.names, meter.weights) / F.col("many__")).alias("mean"))


def relations(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """n, relation, n_pairs: how undominated vectors stand to all vectors of their signature, over all distinct signatures.

    Vectors of local constraints are made syllable by syllable, equal ones once,
    and compared within the signature's row; else all scansions are made.
    """
    if not (local(meter) and bounding.fits(len(meter.names), meter.longest)):
        v = vectors(encoded, meter).select(*meter.key, *meter.names)
        a = undominated(encoded, meter).select(*meter.key, *(F.col(k).alias(f"a_{k}") for k in meter.names))
        kind = relation([f"a_{k}" for k in meter.names], list(meter.names)).alias("relation")
        return a.join(v, meter.key).groupBy("n", kind).agg(F.count("*").alias("n_pairs"))
    kinds = ["equal", "bounds", "unequal"]
    rows = _per_rhythm(encoded, meter, lambda n, masks: bounding.relations(n, masks, len(meter.names), meter.longest).T, kinds)
    each = F.array(*(F.struct(F.lit(k).alias("relation"), F.col(k).alias("n_pairs")) for k in kinds))
    sums = rows.groupBy("n").agg(*(F.sum(k).alias(k) for k in kinds))
    return sums.select("n", F.inline(each)).where("n_pairs > 0")


def ranked(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """signature, counts, score, scan_ord, parse_rank: the undominated scansions of every signature, one row each.

    A signature's undominated scansions are one array in its row, so ranking needs no window.
    """
    each = F.transform("places", lambda p: F.struct(F.col("score").alias("score"), p.alias("scan_ord"), F.struct(*meter.names).alias("v")))
    rows = undominated(encoded, meter).groupBy(*meter.key).agg(F.array_sort(F.flatten(F.collect_list(each))).alias("r"))
    return rows.select(*meter.key, F.posexplode("r").alias("at", "x")).select(
        *meter.key, *(F.col(f"x.v.{k}") for k in meter.names), "x.score", "x.scan_ord", (F.col("at") + 1).alias("parse_rank")
    )


def ambiguity(encoded: DataFrame, meter: Meter = DEFAULT) -> DataFrame:
    """How many undominated scansions each signature has."""
    return undominated(encoded, meter).groupBy(*meter.key).agg(F.sum("scansions").alias("n_unbounded"))


def relation(u: list[str], v: list[str]) -> Column:
    """How vector u stands to v: 'bounds', 'bounded', 'equal' or 'unequal'."""
    low = high = F.lit(True)
    for a, b in zip(u, v, strict=True):
        low &= F.col(a) <= F.col(b)
        high &= F.col(a) >= F.col(b)
    return F.when(low & high, "equal").when(low, "bounds").when(high, "bounded").otherwise("unequal")


# ---- properties of a parse, over columns positions ('w|s|ww'), meter ('wsww'), n ----


def position_array() -> Column:
    return F.split("positions", r"\|")


def feet() -> Column:
    """Positions in pairs, an odd last one left out; a single position is a foot."""
    return units.let(
        position_array(),
        lambda p: F.when(F.size(p) == 1, p).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")),
                lambda i: F.concat(F.element_at(p, i * 2 - 1), F.element_at(p, i * 2)),
            )
        ),
    )


def nary_feet() -> Column:
    """The median foot size, cut to a whole number."""

    def median(sizes: Column) -> Column:
        s = F.array_sort(sizes)
        half = F.floor((F.size(s) + 1) / 2).cast("int")
        other = F.floor(F.size(s) / 2).cast("int") + 1
        return F.floor((F.element_at(s, half) + F.element_at(s, other)) / 2).cast("int")

    return units.let(F.transform(feet(), lambda f: F.length(f)), median)


def is_rising(nary: Column, meter: Column) -> Column:
    """By the fourth syllable of binary and ternary feet, else whether the first is weak."""
    fourth = F.substring(meter, 4, 1)
    first = F.substring(meter, 1, 1) == "w"
    return (
        F.when((F.length(meter) >= 4) & (nary == 3), fourth != "s")
        .when((F.length(meter) >= 4) & (nary == 2), fourth == "s")
        .otherwise(first)
    )


def foot_type(nary: Column, rising: Column) -> Column:
    return (
        F.when((nary == 2) & rising, "iambic")
        .when(nary == 2, "trochaic")
        .when((nary == 3) & rising, "anapestic")
        .when(nary == 3, "dactylic")
        .otherwise("")
    )


def with_properties(parses: DataFrame) -> DataFrame:
    """Adds meter_str (+-), feet, nary_feet, is_rising, foot_type, num_peaks, num_positions, average_position_size, stress_str."""
    bits = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.when(F.call_function("shiftright", F.col("st"), i).bitwiseAND(F.lit(1)) == 1, "+").otherwise("-"),
    )
    out = parses.withColumn("meter_str", F.translate("meter", "ws", "-+")).withColumn("feet", F.array_join(feet(), " "))
    out = out.withColumn("nary_feet", nary_feet()).withColumn("is_rising", is_rising(F.col("nary_feet"), F.col("meter")))
    return (
        out.withColumn("foot_type", foot_type(F.col("nary_feet"), F.col("is_rising")))
        .withColumn("num_peaks", F.col("n_strong"))
        .withColumn("num_positions", F.col("n_pos"))
        .withColumn("average_position_size", F.round(F.col("n") / F.col("n_pos"), 6))
        .withColumn("stress_str", F.array_join(bits, ""))
    )


def syllables_of(parses: DataFrame, names: tuple[str, ...] = C.TEXTUAL) -> DataFrame:
    """One row per syllable of every parse: line_syll_idx, pos_idx, pos_size, meter_val, is_stressed and a 0/1 column per constraint."""
    m = C.Masks()
    keep = [c for c in parses.columns if c in ("text_id", "line_num", "linepart", "variant", "score", "n", "parse_rank")]
    masks = parses.select(*keep, "positions", "meter", "st", "cont", *(C.REGISTRY[k].mask(m).alias(f"*{k}") for k in names))
    rows = masks.withColumn("line_syll_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c: F.call_function("shiftright", F.col(f"`{c}`"), F.col("line_syll_idx")).bitwiseAND(F.lit(1)).cast("int")
    low = F.call_function("shiftleft", F.lit(2).cast("long"), F.col("line_syll_idx")) - 1
    pos = F.col("line_syll_idx") - F.bit_count(F.col("cont").bitwiseAND(low))
    return rows.withColumn("pos_idx", pos.cast("int")).select(
        *keep,
        "line_syll_idx",
        "pos_idx",
        F.length(F.element_at(position_array(), (F.col("pos_idx") + 1).cast("int"))).alias("pos_size"),
        F.substring("meter", F.col("line_syll_idx") + 1, F.lit(1)).alias("meter_val"),
        (at("st") == 1).alias("is_stressed"),
        *(at(f"*{k}").alias(f"*{k}") for k in names),
    )
