"""The constraint registry. A constraint is a mask of violating syllables, a Column expression over bit masks.

`register` adds one: Columns in, a Column out, so user constraints stay inside
generated code. Counts are bit_count of the mask.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Masks:
    """The masks of a unit and a scansion as Columns: f full, U unstressed, S strong, W weak, and those of the tables.

    The scansion's masks may be given instead (S strong syllables, cont those
    that continue a position, big those of positions longer than two).
    """

    def __init__(self, S: Column | None = None, cont: Column | None = None, big: Column | None = None):
        col = F.col
        self.n, self.st, self.he, self.sg = col("n"), col("st"), col("he"), col("sg")
        self.wk, self.fn, self.wb = col("wk"), col("fn"), col("wb")
        self.S, self.cont, self.big = (col(c) if given is None else given for c, given in (("s", S), ("cont", cont), ("big", big)))
        self.f = F.call_function("shiftleft", F.lit(1).cast("long"), self.n) - 1
        self.U = self.f.bitwiseAND(F.bitwise_not(self.st))
        self.W = self.f.bitwiseAND(F.bitwise_not(self.S))
        self.nf = self.f.bitwiseAND(F.lit(-2).cast("long"))
        self.ph_hi, self.ph_lo = col("ph_hi"), col("ph_lo")


def both(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out.bitwiseAND(m)
    return out


def up(mask: Column) -> Column:
    """Every bit moved to the next syllable."""
    return F.shiftleft(mask, 1)


@dataclass(frozen=True)
class Constraint:
    name: str
    says: str
    mask: Callable[[Masks], Column]
    needs: tuple[str, ...]
    scope: str = "position"
    local: bool = False


REGISTRY: dict[str, Constraint] = {}


def register(
    name: str, says: str, mask: Callable[[Masks], Column], needs: tuple[str, ...] = (), scope: str = "position", local: bool = False
) -> Constraint:
    """Add or replace a constraint; `needs` are the unit masks it reads (st, he, sg, wk, fn, wb, ph_hi, ph_lo).

    A `local` one decides each syllable by itself and its predecessor alone
    (whether they are strong, and continue a position), so that bounding can work
    from left to right; others are bounded over all scansions.
    """
    REGISTRY[name] = Constraint(name, says, mask, needs, scope, local)
    return REGISTRY[name]


def _local(name: str, says: str, mask: Callable[[Masks], Column], needs: tuple[str, ...] = ()) -> None:
    register(name, says, mask, needs, local=True)


_local("w_stress", "no stressed syllable in a weak position", lambda m: both(m.st, m.W), ("st",))
_local("s_unstress", "no unstressed syllable in a strong position", lambda m: both(m.U, m.S), ("st",))
_local("w_peak", "no strong syllable of a polysyllable in a weak position", lambda m: both(m.sg, m.W), ("sg",))
_local("s_trough", "no weak syllable of a polysyllable in a strong position", lambda m: both(m.wk, m.S), ("wk",))
_local(
    "unres_within",
    "two syllables of a word share a position only if the first is light and stressed",
    lambda m: both(m.cont, m.nf, F.bitwise_not(m.wb), up(m.he.bitwiseOR(m.U)), m.f),
    ("st", "he", "wb"),
)
_local(
    "unres_across",
    "two words share a position only if it is weak and both are function words",
    lambda m: both(m.cont, m.wb, m.S.bitwiseOR(both(m.f, F.bitwise_not(both(m.fn, up(m.fn)))))),
    ("fn", "wb"),
)
_local("foot_size", "no position of more than two syllables", lambda m: m.big)
_local(
    "clash", "no neighbouring stressed syllables with one in a weak position",
    lambda m: both(m.st, up(m.st), m.W.bitwiseOR(up(m.W)), m.f), ("st",),
)
_local(
    "lapse", "no neighbouring unstressed syllables with one in a strong position",
    lambda m: both(m.U, up(m.U), m.S.bitwiseOR(up(m.S)), m.nf), ("st",),
)
_local("w_heavy", "no heavy syllable in a weak position", lambda m: both(m.he, m.W), ("he",))
_local("s_light", "no light syllable in a strong position", lambda m: both(m.f, F.bitwise_not(m.he), m.S), ("he",))
_local("s_func", "no function word in a strong position", lambda m: both(m.fn, m.S), ("fn",))
_local("word_foot", "no word boundary inside a position", lambda m: both(m.wb, m.cont), ("wb",))
_local("w_prom", "no phrasally prominent syllable in a weak position", lambda m: both(m.ph_hi, m.W), ("ph_hi",))
_local("s_demoted", "no phrasally demoted syllable in a strong position", lambda m: both(m.ph_lo, m.S), ("ph_lo",))
register("pentameter", "five strong positions", lambda m: (F.col("n_strong") != 5).cast("long"), scope="line")
register("iambic", "begins weak, strong", lambda m: (both(m.S, F.lit(3).cast("long")) != 2).cast("long"), scope="line")

DEFAULT = ("w_peak", "w_stress", "s_unstress", "unres_across", "unres_within", "foot_size")
TEXTUAL = tuple(k for k, c in REGISTRY.items() if c.scope == "position" and k not in ("w_prom", "s_demoted"))


def counts(names: tuple[str, ...]) -> list[Column]:
    """A count column for each constraint, of the same name."""
    m = Masks()
    return [F.bit_count(REGISTRY[k].mask(m)).cast("int").alias(k) for k in names]


def score(names: tuple[str, ...], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of counts; a missing weight is 1."""
    total = F.lit(0.0)
    for k in names:
        total = total + F.col(k) * float((weights or {}).get(k, 1.0))
    return total


def needs(names: tuple[str, ...]) -> list[str]:
    """The unit masks that the constraints read."""
    return sorted({x for k in names for x in REGISTRY[k].needs})


def parse_weight(text: str) -> tuple[str, float]:
    """`name/weight` or `name` (weight 1)."""
    name, _, weight = text.partition("/")
    return name, float(weight) if weight else 1.0


def zones_of(n: Column, zones: str | int | None, longest: int = 18) -> list[tuple[str, Column]]:
    """(suffix, mask) of the zones: None, 'initial' (first two, rest), 'foot' (pairs of syllables), or a number of equal steps (the last takes the rest)."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    if zones is None:
        return [("", full)]
    if zones == "initial":
        return [("_init", both(full, F.lit(3).cast("long"))), ("_rest", both(full, F.lit(-4).cast("long")))]
    if zones == "foot":
        return [(f"_f{k + 1}", both(full, F.lit(3 << (2 * k)).cast("long"))) for k in range((longest + 1) // 2)]
    step = F.greatest(F.lit(1), F.floor(n / zones)).cast("int")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")) - 1
    out = []
    for z in range(zones):
        low, high = bit(F.least(step * z, n)), full if z == zones - 1 else bit(F.least(step * (z + 1), n))
        out.append((f"_z{z + 1}", both(high, F.bitwise_not(low))))
    return out


def zone_counts(names: tuple[str, ...], zones: str | int | None) -> list[Column]:
    """Counts by zone, named constraint + suffix, zone-major."""
    m = Masks()
    return [
        F.bit_count(both(REGISTRY[k].mask(m), mask)).cast("int").alias(f"{k}{suffix}")
        for suffix, mask in zones_of(F.col("n"), zones)
        for k in names
    ]


def zoned(names: tuple[str, ...], zones: str | int | None, longest: int = 18) -> tuple[str, ...]:
    """Registers the constraints by zone and gives their names, constraint + suffix, zone-major.

    A zoned constraint is one like any other: it has a weight of its own in
    scores, bounding, best parses and learning, and is local if the whole one is.
    """
    out = []
    for at, suffix in enumerate(zone_suffixes(zones, longest)):
        for k in names:
            whole = REGISTRY[k]
            if suffix:
                mask = lambda m, whole=whole, at=at: both(whole.mask(m), zones_of(m.n, zones, longest)[at][1])
                register(k + suffix, f"{whole.says} (zone {suffix[1:]})", mask, whole.needs, whole.scope, whole.local)
            out.append(k + suffix)
    return tuple(out)


def zone_suffixes(zones: str | int | None, longest: int = 18) -> list[str]:
    if zones is None:
        return [""]
    if zones == "initial":
        return ["_init", "_rest"]
    if zones == "foot":
        return [f"_f{k + 1}" for k in range((longest + 1) // 2)]
    if isinstance(zones, int) and zones > 0:
        return [f"_z{z + 1}" for z in range(zones)]
    raise ValueError(f"unknown zones: {zones!r}")
