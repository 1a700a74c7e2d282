"""Units parsed piece by piece: the product of any number of pieces' parses, bounded and ranked again.

The counts of a concatenation are the sums of the pieces' counts, and what is
dominated in a piece stays dominated in every concatenation. So pieces are
merged two by two: sums of two fronts, equal ones added up, dominated ones
dropped; after log2(pieces) rounds every unit has one front. Work goes by
distinct pairs of fronts, and no combination of parses is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.sources.scratch import discard, written

from . import constraints as C
from . import parse, texts, units

# Words that open a clause or a conjunct (where no parser marks them).
OPENERS = [
    "and", "but", "or", "nor", "that", "which", "who", "whom", "whose", "because", "if", "when", "while", "though", "although", "since", "unless",
    "und", "aber", "oder", "dass", "weil", "wenn", "während", "obwohl", "et", "mais", "ou", "que", "qui", "dont", "car", "lorsque", "quand",
    "y", "pero", "o", "porque", "cuando", "mientras", "aunque", "si",
]


def clause_pieces(rows: DataFrame, openers: list[str] = OPENERS) -> DataFrame:
    """Units with `words`, cut before every word that opens a clause: the units' columns, piece (from 1) and the piece's words.

    A unit whose first word alone is an opener is not cut there; one without
    words has no piece. With a parser, cut at its clause marks instead: any table
    of pieces will do for `combined`.
    """
    opened = F.transform("words", lambda w, k: F.when((k > 0) & F.lower(w).isin(openers), F.concat(F.lit("\u0001"), w)).otherwise(w))
    cut = F.split(F.array_join(opened, "\u0002"), "\u0002?\u0001")
    keys = [c for c in rows.columns if c != "words"]
    found = rows.where(F.size("words") > 0).select(*keys, F.posexplode(cut).alias("k__", "p__"))
    return found.select(*keys, (F.col("k__") + 1).alias("piece"), F.split("p__", "\u0002").alias("words"))


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("+", *parts))


def combined(pieces: DataFrame, meter: parse.Meter = parse.DEFAULT) -> DataFrame:
    """Pieces (any id columns, piece, words) -> one row a unit: n_pieces, n, n_product, n_kept, best_score and the best counts.

    n_product is the number of combinations of the pieces' undominated parses and
    n_kept of those that no other combination dominates, both as doubles (whole
    up to 2**53). Pieces outside the meter's syllables have no parse and are
    passed over, as are units without any. Equal scores rank by the counts in the
    meter's order.
    """
    names = list(meter.names)
    ids = [c for c in pieces.columns if c not in ("piece", "words")]
    lists = texts.parse_lists(pieces, meter).select(_key(*texts.RHYTHM).alias("r"), F.explode("parses").alias("p"))
    fronts = written(lists.groupBy("r", *(F.col(f"p.v.{k}").alias(k) for k in names)).agg(F.count("*").cast("double").alias("many")), "fronts")
    sizes = fronts.groupBy("r").agg(F.sum("many").alias("size"))
    rows = units.rhythms(pieces, meter.longest).select(*ids, "piece", "n", _key(*texts.RHYTHM).alias("r")).join(sizes, "r")
    order = F.array_sort(F.collect_list(F.struct("piece", "r")))
    state = rows.groupBy(*ids).agg(
        F.count("*").cast("int").alias("n_pieces"), F.sum("n").cast("int").alias("n"), F.product("size").alias("n_product"), F.transform(order, lambda x: x["r"]).alias("rs")
    )
    state = written(state, "units")
    while (state.agg(F.max(F.size("rs"))).first()[0] or 0) > 1:
        # Neighbours two by two; the odd one at the end waits.
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("rs") - 1) / 2).cast("int")), lambda k: F.struct(F.get("rs", 2 * k).alias("a"), F.get("rs", 2 * k + 1).alias("b")))
        met = state.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct().withColumn("r", F.when(F.col("b").isNull(), F.col("a")).otherwise(_key(F.col("a"), F.col("b"))))
        left, right = fronts.withColumnRenamed("r", "a"), fronts.select(F.col("r").alias("b"), *(F.col(k).alias(f"{k}_2") for k in names), F.col("many").alias("many_2"))
        sums = met.where("b is not null").join(left, "a").join(right, "b")
        sums = sums.groupBy("r", *((F.col(k) + F.col(f"{k}_2")).alias(k) for k in names)).agg(F.sum(F.col("many") * F.col("many_2")).alias("many"))
        sums = written(sums, "sums")
        merged = parse.undominated_of(sums, ["r"], tuple(names)).select("r", *names, "many")
        waiting = fronts.join(met.where("b is null").select("r").distinct(), "r", "left_semi")
        old, fronts = (fronts, state, sums), written(merged.unionByName(waiting), "fronts")
        state = written(state.withColumn("rs", F.transform(pairs, lambda p: F.when(p["b"].isNull(), p["a"]).otherwise(_key(p["a"], p["b"])))), "units")
        discard(*old)
    scored = fronts.withColumn("score", C.score(tuple(names), meter.weights))
    best = scored.groupBy("r").agg(F.sum("many").alias("n_kept"), F.min(F.struct(F.col("score").alias("best_score"), *names)).alias("b"))
    return state.withColumn("r", F.col("rs")[0]).join(best, "r").select(*ids, "n_pieces", "n", "n_product", "n_kept", "b.*")
