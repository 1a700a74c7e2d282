"""Aggregations over parses, and ranking statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import constraints as C


def parse_stats(parses: DataFrame, by: list[str], names: tuple[str, ...] = C.DEFAULT) -> DataFrame:
    """Sums of violations (raw), per syllable (_norm), and their totals, by the given columns."""
    total = sum((F.col(k) for k in names[1:]), F.col(names[0]))
    sylls = F.sum("n")
    return parses.groupBy(*by).agg(
        F.count("*").alias("n_parses"),
        sylls.cast("long").alias("n_sylls"),
        *(F.sum(k).alias(k) for k in names),
        *(F.round(F.sum(k) / sylls, 6).alias(f"{k}_norm") for k in names),
        F.sum(total).alias("total"),
        F.round(F.avg(total), 6).alias("mean_total"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    """value, n, share: a frequency distribution."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.log(value)))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The Mann-Whitney AUC of `score` for the 0/1 `label`, ties averaged.

    Counts by distinct score first, then running sums over the distinct scores
    alone: a range-partitioned prefix sum, so no single task sees all rows.
    """
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(score).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")
    )
    # Distinct scores fall into 64 ranges between approximate percentiles.
    cut = counts.agg(F.percentile_approx("s", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
    dealt = counts.crossJoin(F.broadcast(cut)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    whole = dealt.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.withColumn("before", F.coalesce(F.sum("part_n").over(before), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("before") + F.col("n") / 2))
    return ranked.agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.round(wins / (F.sum("p") * F.sum("n")), 6).alias("auc")
    )


def roc(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, tpr, fpr, precision, f1 of `score <= threshold` as the positive prediction (a distance)."""
    table = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    hit = (F.col(score) <= F.col("threshold")).cast("long")
    pos, neg = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    counts = rows.where(F.col(score).isNotNull()).crossJoin(F.broadcast(table)).groupBy("threshold").agg(
        F.sum(hit * pos).alias("tp"), F.sum(hit * neg).alias("fp"), F.sum(pos).alias("p"), F.sum(neg).alias("n")
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return counts.select(
        "threshold",
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
        ratio(F.col("fp"), F.col("n")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"),
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins; 0 below, bins + 1 from high on) and n."""
    return rows.where(F.col(value).isNotNull()).groupBy(
        F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact interpolated quantiles q25, q50, ... by groups."""
    return rows.groupBy(*by).agg(*(F.round(F.percentile(value, q), 6).alias(f"q{round(100 * q)}") for q in at))


def siblings(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds num (from 1), and prev_num and next_num of the neighbours under the same parent."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("num", F.row_number().over(w))
    return rows.withColumn("prev_num", F.lag("num").over(w)).withColumn("next_num", F.lead("num").over(w))
