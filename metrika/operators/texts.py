"""From texts to parses: one entry with modes, bulk parsing with resume, export of lines, products of parts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from metrika.sources import corpus, scratch

from . import bounding, parse, scansion, tokens, units
from . import constraints as C

RHYTHM = ["n", "he", "wb", "st", "amb"]
UNIT = ["text_id", "line_num", "linepart"]


def _counts(names: tuple[str, ...]) -> Column:
    return F.struct(*(F.col(f"`{k}`") for k in names))


def parse_lists(lines: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """RHYTHM -> parses: each distinct rhythm of units with `words` with all its undominated scansions, best first.

    parses: array<struct<score, variant, scan_ord, v (counts)>>. The variants of a
    unit compete: a scansion of one that a scansion of the other dominates is
    dropped. Equal counts never drop each other.
    """
    return lists_of(units.rhythms(lines, meter.longest).select(*RHYTHM).distinct(), meter)


def lists_of(distinct: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """`parse_lists` of a table of distinct RHYTHM."""
    encoded = units.variants(distinct.select(*RHYTHM, *(F.col(c).alias(f"{c}_") for c in RHYTHM)))
    of = [f"{c}_" for c in RHYTHM]
    found = encoded.join(parse.undominated(encoded, meter), meter.key)
    each = F.struct(_counts(meter.names).alias("v"), "score", "variant", "places")
    rows = found.groupBy(*of).agg(F.collect_list(each).alias("all"))

    def below(y: Column, x: Column) -> Column:
        low = less = None
        for k in meter.names:
            a, b = y["v"][k], x["v"][k]
            low = a <= b if low is None else low & (a <= b)
            less = a < b if less is None else less | (a < b)
        return (y["variant"] != x["variant"]) & low & less

    kept = F.when(F.col("amb_") == 0, F.col("all")).otherwise(F.filter("all", lambda x: ~F.exists("all", lambda y: below(y, x))))
    one = lambda x: F.transform(x["places"], lambda p: F.struct(x["score"].alias("score"), x["variant"].alias("variant"), p.alias("scan_ord"), x["v"].alias("v")))
    return rows.select(*(F.col(f"{c}_").alias(c) for c in RHYTHM), F.array_sort(F.flatten(F.transform(kept, one))).alias("parses"))


def parse_texts(
    texts: DataFrame, meter: parse.Meter = parse.DEFAULT, mode: str = "best", lim: int | None = None, by: str = "linepart", text_id: str = "doc_id"
) -> DataFrame:
    """Texts (text_id, text) to parses, one row for each unit and parse.

    mode 'best' gives each unit's first parse, 'unbounded' all undominated ones,
    'all' every scansion of both variants; `lim` keeps parses up to that rank.
    Units are line parts or, with by='line', whole lines; those outside 2 to
    `longest` syllables have no parse. Columns: text_id, line_num, linepart,
    parse_rank (null for dominated ones), is_best, is_bounded, variant, score,
    counts by constraint, n and the masks, scan_ord, positions, meter and the
    other columns of the catalogue.
    """
    if mode not in ("best", "unbounded", "all"):
        raise ValueError(f"unknown mode: {mode}")
    lines = tokens.line_parts(texts, text_id) if by == "linepart" else tokens.whole_lines(texts, text_id).withColumn("linepart", F.lit(1))
    rows = units.rhythms(lines, meter.longest).select(*UNIT, *RHYTHM)
    catalogue = F.broadcast(scansion.scansions(texts.sparkSession, meter.longest, meter.max_s, meter.max_w))
    if mode == "best" and parse.additive(meter):
        # The first undominated parse is the lightest one, which one pass over each unit's own row finds.
        first = parse.best_of(lines, meter).select(*UNIT, F.lit(1).alias("parse_rank"), "variant", "scan_ord", "n", *units.MASKS)
        return _counted(first.join(catalogue, ["n", "scan_ord"]), meter)
    lists = parse_lists(lines, meter)
    most = 1 if mode == "best" else lim
    if most is not None:
        lists = lists.withColumn("parses", F.slice("parses", 1, most))
    ranked = lists.select(*RHYTHM, F.posexplode("parses").alias("at", "p")).select(*RHYTHM, (F.col("at") + 1).alias("parse_rank"), "p.variant", "p.scan_ord")
    if mode == "all":
        variant = F.explode(F.when(F.col("amb") != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        every = lists.select(*RHYTHM, variant.alias("variant")).join(catalogue.select("n", "scan_ord"), "n")
        ranked = every.join(ranked, [*RHYTHM, "variant", "scan_ord"], "left")
        ranked = ranked if lim is None else ranked.where(F.col("parse_rank") <= lim)
    at = rows.join(ranked, RHYTHM)
    at = at.withColumn("st", F.when(F.col("variant") == 1, F.col("st").bitwiseOR(F.col("amb"))).otherwise(F.col("st")))
    return _counted(units.masked(at, [*UNIT, "parse_rank", "variant", "scan_ord"]).join(catalogue, ["n", "scan_ord"]), meter)


def _counted(out: DataFrame, meter: parse.Meter) -> DataFrame:
    """Parses with the catalogue's columns -> adds counts, score, is_best and is_bounded."""
    counted = out.select("*", *C.counts(meter.names)).withColumn("score", C.score(meter.names, meter.weights))
    return counted.withColumn("is_best", F.coalesce(F.col("parse_rank") == 1, F.lit(False))).withColumn("is_bounded", F.col("parse_rank").isNull())


def export_lines(lines: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """One row a line of units with `words`: sums over the best parses of its parts and over all undominated ones.

    num_parses is the product of the parts' numbers of undominated parses (null
    where it leaves the whole numbers of a double); *_unbounded are sums over
    them. Sums are made once a distinct rhythm.
    """
    names = meter.names
    add = lambda f: F.aggregate("parses", F.lit(0.0), lambda a, p: a + f(p))
    viols = lambda p: sum((p["v"][k] for k in names[1:]), p["v"][names[0]])
    lists = parse_lists(lines, meter)
    sums = lists.select(
        *RHYTHM, F.col("parses")[0].alias("best"), F.size("parses").alias("many"), add(lambda p: p["score"]).alias("score_u"),
        *(add(lambda p, k=k: p["v"][k].cast("double")).cast("long").alias(f"{k}_u") for k in names),
    )
    rows = units.rhythms(lines, meter.longest).select(*UNIT, *RHYTHM).join(sums, RHYTHM)
    catalogue = F.broadcast(scansion.scansions(lines.sparkSession, meter.longest, meter.max_s, meter.max_w).select("n", "scan_ord", "meter"))
    rows = rows.withColumn("scan_ord", F.col("best.scan_ord")).join(catalogue, ["n", "scan_ord"])
    product = F.product(F.col("many").cast("double"))
    shown = F.array_sort(F.collect_list(F.struct("linepart", F.translate("meter", "ws", "-+").alias("m"))))
    out = rows.groupBy("text_id", "line_num").agg(
        F.count("*").alias("n_parts"),
        F.sum("n").alias("n_sylls"),
        F.round(F.sum("best.score"), 6).alias("score"),
        F.sum(viols(F.col("best"))).alias("num_viols"),
        F.when(product < float(1 << 50), product.cast("long")).alias("num_parses"),
        F.round(F.sum("score_u"), 6).alias("score_unbounded"),
        F.sum(F.col("n") * F.col("many")).alias("num_sylls_unbounded"),
        *(F.sum(f"{k}_u").alias(f"{k}_unbounded") for k in names),
        shown.alias("shown"),
    )
    return out.withColumn("meter_str", F.array_join(F.transform("shown", lambda x: x["m"]), " | ")).drop("shown")


def combined(lines: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """Neighbouring parts of a line parsed as one: the product of their parse lists, bounded and ranked again.

    text_id, line_num, linepart (the first part), n_product (how many pairs of
    parses), n_kept (those that no other pair dominates), best_score, and the
    counts of the best pair. Rhythms with the same counts, each with how many
    parses have them, share a front (told apart by 128 bits), and work goes by
    distinct pairs of fronts, whichever comes first, each in a row of its own.
    Meters whose fronts are told syllable by syllable need no lists of parses:
    see `combined_neighbours`, which takes the pairs of parts as they are.
    """
    if parse.sums_local(meter):
        at = scratch.written(units.rhythms(lines, meter.longest).select(*UNIT, *units.packed()), "rhythms")
        after = at.select("text_id", "line_num", (F.col("linepart") - 1).alias("linepart"), F.col("r1").alias("b1"), F.col("r2").alias("b2"))
        return combined_neighbours(at.withColumnsRenamed({"r1": "a1", "r2": "a2"}).join(scratch.dealt(after), UNIT), meter)
    names = meter.names
    rows = scratch.written(units.rhythms(lines, meter.longest).select(*UNIT, F.struct(*RHYTHM).alias("r")), "rhythms")
    lists = lists_of(rows.select("r.*").distinct(), meter)
    each = lists.select(F.struct(*RHYTHM).alias("r"), F.explode("parses").alias("p")).groupBy("r", *(F.col(f"p.v.{k}").cast("long").alias(k) for k in names)).agg(F.count("*").alias("many"))
    fronts = each.groupBy("r").agg(F.array_sort(F.collect_list(F.array(*names, "many"))).alias("f"))
    fronts = scratch.written(fronts.select("r", "f", F.unhex(F.md5(F.to_json("f"))).alias("h")), "fronts")
    at = scratch.written(rows.join(scratch.dealt(fronts.select("r", "h")), "r").select(*UNIT, "h"), "units")
    after = at.select("text_id", "line_num", (F.col("linepart") - 1).alias("linepart"), F.col("h").alias("h2"))
    pairs = at.join(scratch.dealt(after), UNIT).select(*UNIT, F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b"))
    kinds = fronts.groupBy("h").agg(F.first("f").alias("f"))
    met = pairs.select("a", "b").distinct()
    for k in ("a", "b"):
        met = met.join(scratch.dealt(kinds.select(F.col("h").alias(k), F.col("f").alias(f"f{k}"))), k)
    kept = F.transform(_front_sums("fa", "fb"), lambda v: F.struct(*(v[k].alias(x) for k, x in enumerate((*names, "many")))))
    many = lambda f: F.aggregate(f, F.lit(0).cast("long"), lambda s, v: s + v[len(names)])
    found = met.select("a", "b", (many("fa") * many("fb")).alias("n_product"), F.inline(kept)).withColumn("score", C.score(names, meter.weights))
    best = found.groupBy("a", "b").agg(F.first("n_product").alias("n_product"), F.sum("many").alias("n_kept"), F.min(F.struct(F.col("score").alias("best_score"), *(F.col(k).cast("int").alias(k) for k in names))).alias("best"))
    return pairs.join(scratch.dealt(best), ["a", "b"]).select(*UNIT, "n_product", "n_kept", "best.*")


def combined_neighbours(pairs: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """What `combined` gives, of pairs of neighbouring parts: any columns, and the packed rhythms a1, a2 and b1, b2 (see `units.neighbours_of`).

    Each distinct rhythm has its front made once and met by both sides of the
    pairs. Scores and the order of counts add up, so the best pair is the pair of
    the best; only what is dominated needs the sums, made in the pair's own row.
    """
    ids = [c for c in pairs.columns if c not in ("a1", "a2", "b1", "b2")]
    pairs = scratch.written(pairs, "neighbours")
    sides = F.array(*(F.struct(F.col(f"{k}1").alias("r1"), F.col(f"{k}2").alias("r2")) for k in "ab"))
    fronts = scratch.written(parse.fronts(pairs.select(F.inline(sides)).distinct(), meter), "fronts")
    for k in "ab":
        own = fronts.select(F.col("r1").alias(f"{k}1"), F.col("r2").alias(f"{k}2"), *(F.col(c).alias(f"{c}_{k}") for c in ("v", "many", "size", "lead")))
        pairs = pairs.join(scratch.dealt(own), [f"{k}1", f"{k}2"]).drop(f"{k}1", f"{k}2")
    width = bounding.sum_width(meter.longest)
    rows = pairs.select(*ids, (F.col("size_a") * F.col("size_b")).alias("n_product"), parse.kept_sums(meter)("v_a", "many_a", "v_b", "many_b").alias("n_kept"), (F.col("lead_a") + F.col("lead_b")).alias("lead"))
    counts = [F.shiftright("lead", width * j).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias(k) for j, k in enumerate(meter.names)]
    rows = rows.select(*ids, "n_product", "n_kept", *counts)
    return rows.select(*ids, "n_product", "n_kept", C.score(meter.names, meter.weights).alias("best_score"), *meter.names)


def _sums(left: pa.Array, right: pa.Array) -> pa.Array:
    """Sums of two fronts (counts, then how many have them): equal ones added up, dominated ones dropped."""

    def added(f: list[list[int]], g: list[list[int]]) -> np.ndarray:
        x, y = np.asarray(f, np.int64), np.asarray(g, np.int64)
        every = (x[:, None, :-1] + y[None, :, :-1]).reshape(-1, x.shape[1] - 1)
        vectors, place = np.unique(every, axis=0, return_inverse=True)
        many = np.zeros(len(vectors), np.int64)
        np.add.at(many, place.ravel(), np.outer(x[:, -1], y[:, -1]).ravel())
        # No two vectors are equal, so what is nowhere greater is less somewhere.
        kept = np.zeros(len(vectors), bool)
        for first in range(0, len(vectors), 256):
            part = vectors[first : first + 256]
            below = np.ones((len(part), len(vectors)), bool)
            for k in range(vectors.shape[1]):
                below &= vectors[None, :, k] <= part[:, None, k]
            kept[first : first + 256] = below.sum(axis=1) == 1
        return np.column_stack([vectors, many])[kept]

    found = [added(f, g) for f, g in zip(left.to_pylist(), right.to_pylist(), strict=True)]
    return pa.array([f.tolist() for f in found], pa.list_(pa.list_(pa.int64())))


_front_sums = F.arrow_udf(_sums, ArrayType(ArrayType(LongType())))


def parse_corpus(
    rows: DataFrame, path: str, meter: parse.Meter = parse.DEFAULT, mode: str = "best", on_error: str = "log", most_errors: int = 100
) -> dict[str, int]:
    """Parse the items (id, text) that `path` does not have yet, save their parses there, and count what happened.

    Returns n_done, n_skipped (done before) and n_failed (empty, without a word,
    or raising an error when read or parsed; kept with their status, so that they
    are not tried again). An item that raises doesn't stop the others: the items
    are halved by a hash of their ids until it stands alone, and it goes to the
    side table `errors` with its message. More than `most_errors` of them are no
    accident and raise, as any bad item does with on_error='raise'; then nothing
    of the run counts. Each part writes its parses to a folder of its own and
    then, in one write, the status of its items with that folder's name: a run
    that dies leaves nothing that `load_parses` or a later run would see.
    """
    spark = rows.sparkSession
    found = corpus.items(rows, rows.columns[0])
    before = statuses(spark, path)
    left = found if before is None else corpus.pending(found, before)
    errors: list[tuple[str, str]] = []
    batches: list[str] = []

    def work(items: DataFrame) -> None:
        batch = uuid.uuid4().hex
        checked = corpus.with_status(items)
        good = checked.where("status = 'ok'").select(F.col("text_id").alias("doc_id"), "text")
        parse_texts(good, meter, mode).write.parquet(f"{path}/parses/batch={batch}")
        checked.select("text_id", "status", F.lit(batch).alias("batch")).write.parquet(f"{path}/tried/{batch}")
        batches.append(batch)

    def isolated(items: DataFrame, depth: int) -> None:
        try:
            work(items)
        except Exception as error:
            alone = items.select("text_id").distinct().limit(2).collect()
            if len(alone) < 2:
                errors.extend((r.text_id, str(error).splitlines()[0][:500]) for r in alone)
                if len(errors) > most_errors:
                    raise
                return
            side = F.shiftright(F.xxhash64("text_id"), depth).bitwiseAND(F.lit(1))
            for half in (0, 1):
                isolated(items.where(side == half), depth + 1)

    if on_error == "raise":
        corpus.with_status(left, on_error).write.format("noop").mode("overwrite").save()
        work(left)
    else:
        isolated(left, 0)
    batch = uuid.uuid4().hex
    kind = dict(found.dtypes)["text_id"]
    failed = spark.createDataFrame(errors, f"text_id {kind}, error string")
    failed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/errors")
    now = failed.select("text_id", F.lit("error").alias("status"), F.lit(batch).alias("batch"))
    if batches:
        now = now.unionByName(spark.read.parquet(*(f"{path}/tried/{b}" for b in batches)))
    now.write.mode("append").parquet(f"{path}/status")
    scratch.delete(spark, f"{path}/tried")
    now = statuses(spark, path).where(F.col("batch").isin([*batches, batch]))
    done, bad = (now.where(test).count() for test in ("status = 'ok'", "status <> 'ok'"))
    return {"n_done": done, "n_skipped": found.select("text_id").count() - done - bad, "n_failed": bad}


def errors(spark, path: str) -> DataFrame:
    """text_id, error of the items below `path` that raised one."""
    return spark.read.parquet(f"{path}/errors").select("text_id", "error")


def statuses(spark, path: str) -> DataFrame | None:
    """text_id, status, batch of the items that `path` has; None if there is nothing yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/status")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(f"{path}/status") if there else None


def load_parses(spark, path: str) -> DataFrame:
    """The parses of all finished runs below `path`."""
    batches = statuses(spark, path).select("batch").distinct()
    return spark.read.parquet(f"{path}/parses").join(F.broadcast(batches), "batch", "left_semi").drop("batch")
