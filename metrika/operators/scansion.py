"""The catalogue of scansions: every way to cut n syllables into alternating weak and strong positions.

A bounded dimension (22,000 rows up to 18 syllables with positions of at most
two), made once on the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "n int, scan_ord int, positions string, meter string, s bigint, cont bigint, big bigint, n_pos int, n_strong int"
)


def positions(n: int, max_s: int = 2, max_w: int = 2, after: str = "") -> Iterator[list[str]]:
    """Scansions of n syllables in enumeration order: at each step a position that ends the unit comes first, then w, ww, ..., s, ss, ..."""
    kinds = [k * size for k, most in (("w", max_w), ("s", max_s)) if k != after for size in range(1, most + 1)]
    for p in kinds:
        if len(p) == n:
            yield [p]
    for p in kinds:
        if len(p) < n:
            for rest in positions(n - len(p), max_s, max_w, p[0]):
                yield [p, *rest]


def masks(parts: list[str]) -> tuple[int, int, int]:
    """Strong syllables, syllables that continue a position, syllables of positions longer than two."""
    s = cont = big = at = 0
    for p in parts:
        for k in range(len(p)):
            bit = 1 << (at + k)
            s |= bit * (p[0] == "s")
            cont |= bit * (k > 0)
            big |= bit * (len(p) > 2)
        at += len(p)
    return s, cont, big


@lru_cache(maxsize=8)
def catalogue(longest: int = 18, max_s: int = 2, max_w: int = 2, shortest: int = 1) -> list[tuple]:
    """Rows of SCHEMA for shortest..longest syllables."""
    rows = []
    for n in range(shortest, longest + 1):
        for k, parts in enumerate(positions(n, max_s, max_w)):
            strong = sum(p[0] == "s" for p in parts)
            rows.append((n, k, "|".join(parts), "".join(parts), *masks(parts), len(parts), strong))
    return rows


def scansions(spark: SparkSession, longest: int = 18, max_s: int = 2, max_w: int = 2) -> DataFrame:
    """The catalogue as a DataFrame."""
    return spark.createDataFrame(catalogue(longest, max_s, max_w), SCHEMA)


def iambic(n: Column) -> Column:
    """wsws... of n syllables."""
    return F.substring(F.repeat(F.lit("ws"), n), F.lit(1), n)


def split_scansion(meter: Column) -> Column:
    """A `+-` or `ws` string as an array of runs of w and s."""
    return F.regexp_extract_all(F.translate(meter, "+-", "sw"), F.lit("w+|s+"), F.lit(0))


def position_types(max_s: int = 2, max_w: int = 2) -> list[str]:
    return [k * size for k, most in (("w", max_w), ("s", max_s)) for size in range(1, most + 1)]
