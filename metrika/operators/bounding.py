"""Undominated scansions of a rhythm, position by position.

Every constraint decides a syllable by itself and its predecessor, so a partial
scansion that another one with the same last position dominates stays dominated
however both go on, and is dropped at once. What each pair of neighbouring
syllable states costs comes in as bit masks, made by Spark from the constraints'
own expressions (`costs`); a batch of rhythms is walked through here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constraints as C
from . import scansion

#: States of a syllable: strong or weak, first in its position or second.
STATES = ("w1", "w2", "s1", "s2")
#: State pairs of neighbouring syllables (None: the first syllable).
PAIRS = (
    (None, "w1"), (None, "s1"), ("w1", "w2"), ("s1", "s2"), ("s1", "w1"), ("s2", "w1"), ("w1", "s1"), ("w2", "s1"),
)
#: Positions by their place in the enumeration of scansions.
POSITIONS = (("w1",), ("w1", "w2"), ("s1",), ("s1", "s2"))
EVEN, ODD = 0x5555555555555555, 0x2AAAAAAAAAAAAAAA


def costs(names: tuple[str, ...]) -> list[Column]:
    """For each pair of states and constraint, the mask of the syllables that violate it in the second state."""
    out = []
    for before, here in PAIRS:
        masks = []
        for mine, other in ((EVEN, ODD), (ODD, EVEN)):
            pattern = lambda test: F.lit((mine if test(here) else 0) | (other if before and test(before) else 0))  # noqa: B023, E731
            m = C.Masks(pattern(lambda x: x[0] == "s"), pattern(lambda x: x[1] == "2"), F.lit(0).cast("long"))
            masks.append([C.REGISTRY[k].mask(m).bitwiseAND(F.lit(mine)) for k in names])
        out += [a.bitwiseOR(b).bitwiseAND(m.f).alias(f"c{len(out) + k}") for k, (a, b) in enumerate(zip(*masks, strict=True))]
    return out


@lru_cache(maxsize=4)
def places(longest: int) -> dict[tuple[int, int], int]:
    """(n, path) -> place in the catalogue; paths are left-aligned digits of three bits, 4 + position but for the last."""
    shift = 3 * (longest - 1)
    kind = {"w": 0, "ww": 1, "s": 2, "ss": 3}
    out = {}
    for n, k, positions, *_ in scansion.catalogue(longest):
        digits = [kind[p] for p in positions.split("|")]
        path = sum((d + 4 * (j < len(digits) - 1)) << (shift - 3 * j) for j, d in enumerate(digits))
        out[n, path] = k
    return out


def undominated(n: int, cost: list[list[int]], guard: int, longest: int) -> dict[int, list[int]]:
    """Packed violations -> paths of all undominated scansions of n syllables.

    cost[i][pair] are the packed violations of syllable i; `guard` has the bit
    above each count, so that one subtraction compares all counts.
    """
    pair = {p: k for k, p in enumerate(PAIRS)}
    shift = 3 * (longest - 1)
    table: list[list[dict[int, list[tuple[int, int]]]]] = [[{} for _ in POSITIONS] for _ in range(n + 1)]
    for end in range(1, n + 1):
        for p, states in enumerate(POSITIONS):
            begin = end - len(states)
            if begin < 0:
                continue
            inside = sum(cost[begin + k][pair[states[k - 1], states[k]]] for k in range(1, len(states)))
            digit = p + 4 * (end < n)
            found: dict[int, list[tuple[int, int]]] = {}
            if begin == 0:
                found[cost[0][pair[None, states[0]]] + inside] = [(digit << shift, 1)]
            else:
                for q, before in enumerate(POSITIONS):
                    if before[0][0] == states[0][0] or not table[begin][q]:
                        continue
                    step = cost[begin][pair[before[-1], states[0]]] + inside
                    for total, paths in table[begin][q].items():
                        grown = [(path | digit << (shift - 3 * j), j + 1) for path, j in paths]
                        found.setdefault(total + step, []).extend(grown)
            table[end][p] = {t: found[t] for t in _minimal(found, guard)}
    last: dict[int, list[int]] = {}
    for found in table[n]:
        for total, paths in found.items():
            last.setdefault(total, []).extend(path for path, _ in paths)
    return {t: last[t] for t in _minimal(last, guard)}


def _minimal(totals, guard: int) -> list[int]:
    """The packed counts that no other is at most equal to in every count."""
    kept: list[int] = []
    # A vector that dominates another is also the smaller number, so it comes first.
    for t in sorted(totals):
        high = t | guard
        if not any((high - k) & guard == guard for k in kept):
            kept.append(t)
    return kept


def walk(n: np.ndarray, masks: list[np.ndarray], constraints: int, longest: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(rhythm, counts, places in the catalogue) of every undominated violation vector of a batch of rhythms.

    masks: the columns of `costs`, pair by pair.
    """
    width = longest.bit_length() + 1
    guard = sum(1 << (width * k + width - 1) for k in range(constraints))
    low = (1 << (width - 1)) - 1
    at = np.arange(longest, dtype=np.int64)
    place = places(longest)
    each = 60 // width  # constraints that a long holds
    packed = []
    for first in range(0, constraints, each):
        part = np.zeros((len(n), longest, len(PAIRS)), np.int64)
        for p in range(len(PAIRS)):
            for k in range(first, min(constraints, first + each)):
                bits = (masks[p * constraints + k][:, None] >> at[None, :]) & 1
                part[:, :, p] += bits << (width * (k - first))
        packed.append(part)
    for row in range(len(n)):
        size = int(n[row])
        cost = packed[0][row, :size].tolist()
        for g, part in enumerate(packed[1:], 1):
            more = part[row, :size].tolist()
            cost = [[a + (b << (width * each * g)) for a, b in zip(x, y, strict=True)] for x, y in zip(cost, more, strict=True)]
        for total, paths in undominated(size, cost, guard, longest).items():
            yield row, [(total >> (width * k)) & low for k in range(constraints)], sorted(place[size, path] for path in paths)


# ---- undominated scansions of a batch ----------------------------------

#: Rhythms that are walked together.
TOGETHER = 4_096


def _packed(masks: list[np.ndarray], rows: int, constraints: int, longest: int, width: int) -> np.ndarray:
    """rhythm x syllable x pair: the counts of all constraints in one long."""
    at = np.arange(longest, dtype=np.int64)
    out = np.zeros((rows, longest, len(PAIRS)), np.int64)
    for p in range(len(PAIRS)):
        for k in range(constraints):
            out[:, :, p] += ((masks[p * constraints + k][:, None] >> at[None, :]) & 1) << (width * k)
    return out


def _kept(group: np.ndarray, total: np.ndarray, bits: int, guard: int) -> np.ndarray:
    """Which rows no other of their group dominates; equal ones all stay."""
    key = group << bits | total
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    kept = _front(key[fresh] & ((1 << bits) - 1), key[fresh] >> bits, guard)
    out = np.zeros(len(order), bool)
    out[order] = kept[np.cumsum(fresh) - 1]
    return out


def _front(value: np.ndarray, of: np.ndarray, guard: int) -> np.ndarray:
    """Which of the distinct packed counts of each group (both ascending) no other of its group dominates."""
    kept, left = np.zeros(len(value), bool), np.arange(len(value))
    # The smallest number of a group that is left is dominated by none: what dominates is the smaller number.
    while len(left):
        first = np.ones(len(left), bool)
        first[1:] = of[left[1:]] != of[left[:-1]]
        leads = left[first]
        kept[leads] = True
        lead = value[leads][np.cumsum(first) - 1]
        left = left[((value[left] | guard) - lead) & guard != guard]
    return kept


def walk_together(n: np.ndarray, masks: list[np.ndarray], constraints: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `walk` finds, for all rhythms together: (rhythm, counts) of every undominated vector, offsets and places.

    The places of vector v are places[offsets[v]:offsets[v + 1]], ascending. For
    counts that fit a long beside the rhythm's number, see `fits`.
    """
    width = longest.bit_length() + 1
    bits = width * constraints
    guard = sum(1 << (width * k + width - 1) for k in range(constraints))
    cost = _packed(masks, len(n), constraints, longest, width)
    shift = 3 * (longest - 1)
    last = np.array([s[-1][0] == "s" for s in POSITIONS])
    none = np.zeros(0, np.int64)
    # Rows (rhythm, packed counts, path, number of positions, kind of the last position) that end one and two syllables before.
    ends: list[tuple[np.ndarray, ...]] = [(none,) * 5]
    done = []
    for end in range(1, int(n.max(initial=0)) + 1):
        parts = []
        for p, states in enumerate(POSITIONS):
            begin = end - len(states)
            if begin < 0:
                continue
            if begin == 0:
                row = np.flatnonzero(n >= end)
                total, path, many = cost[row, 0, _PAIR[None, states[0]]], np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            else:
                own = np.flatnonzero((last[ends[begin][4]] != last[p]) & (n[ends[begin][0]] >= end))
                row, total, path, many, kind = (x[own] for x in ends[begin])
                step = np.array([_PAIR.get((other[-1], states[0]), 0) for other in POSITIONS])
                total = total + cost[row, begin, step[kind]]
            if len(states) == 2:
                total = total + cost[row, begin + 1, _PAIR[states]]
            digit = np.where(n[row] > end, p + 4, p)
            parts.append((row, total, path | digit << (shift - 3 * many), many + 1, np.full(len(row), p)))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        kept = np.flatnonzero(_kept(found[0] * len(POSITIONS) + found[4], found[1], bits, guard))
        found = tuple(x[kept] for x in found)
        whole = n[found[0]] == end
        done.append(tuple(x[whole] for x in found[:3]))
        ends.append(tuple(x[~whole] for x in found))
        ends[end - 2 if end >= 2 else 0] = (none,) * 5
    row, total, path = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (none,) * 3
    kept = _kept(row, total, bits, guard)
    row, total, path = row[kept], total[kept], path[kept]
    place = np.zeros(len(row), np.int64)
    for size, (paths, order) in _sorted_places(longest).items():
        own = n[row] == size
        place[own] = order[np.searchsorted(paths, path[own])]
    order = np.lexsort((place, total, row))
    row, total, place = row[order], total[order], place[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    begins = np.flatnonzero(fresh)
    counts = (total[begins][:, None] >> (width * np.arange(constraints))[None, :]) & ((1 << (width - 1)) - 1)
    return row[begins], counts, np.append(begins, len(row)), place


def _unique(row: np.ndarray, kind: np.ndarray, total: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (rhythm, kind of the last position, packed counts)."""
    key = np.unique((row * len(POSITIONS) + kind) << bits | total)
    group = key >> bits
    return group // len(POSITIONS), group % len(POSITIONS), key & ((1 << bits) - 1)


def vectors_together(n: np.ndarray, masks: list[np.ndarray], constraints: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(rhythm, packed counts) of all distinct violation vectors of a batch, in order; equal partial ones go on as one. See `fits`."""
    width = longest.bit_length() + 1
    bits = width * constraints
    cost = _packed(masks, len(n), constraints, longest, width)
    last = np.array([s[-1][0] == "s" for s in POSITIONS])
    none = np.zeros(0, np.int64)
    ends: list[tuple[np.ndarray, ...]] = [(none,) * 3]
    done = [(none,) * 2]
    for end in range(1, int(n.max(initial=0)) + 1):
        parts = []
        for p, states in enumerate(POSITIONS):
            begin = end - len(states)
            if begin < 0:
                continue
            if begin == 0:
                row = np.flatnonzero(n >= end)
                total = cost[row, 0, _PAIR[None, states[0]]]
            else:
                own = np.flatnonzero((last[ends[begin][1]] != last[p]) & (n[ends[begin][0]] >= end))
                row, kind, total = (x[own] for x in ends[begin])
                step = np.array([_PAIR.get((other[-1], states[0]), 0) for other in POSITIONS])
                total = total + cost[row, begin, step[kind]]
            if len(states) == 2:
                total = total + cost[row, begin + 1, _PAIR[states]]
            parts.append((row, np.full(len(row), p), total))
        row, kind, total = _unique(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
        whole = n[row] == end
        done.append((row[whole], total[whole]))
        ends.append((row[~whole], kind[~whole], total[~whole]))
        if end >= 2:
            ends[end - 2] = (none,) * 3
    row, total = (np.concatenate(x) for x in zip(*done, strict=True))
    row, _, total = _unique(row, np.zeros_like(row), total, bits)
    return row, total


_ONE, _TWO = ("w1", "s1"), ("w2", "s2")


def _alike(cost: np.ndarray) -> bool:
    """Whether no syllable's cost depends on where in its position the one before it stands, but for whether that is strong."""
    return all(np.array_equal(cost[:, :, _PAIR[_ONE[1 - k], _ONE[k]]], cost[:, :, _PAIR[_TWO[1 - k], _ONE[k]]]) for k in (0, 1))


def _merged(parts: list[np.ndarray], many: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct keys of all parts, ascending, and the sums of what they stand for."""
    key = np.concatenate(parts)
    if many is None:
        key.sort()
    else:
        order = np.argsort(key)
        key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(fresh)
    return key[begins], None if many is None else np.add.reduceat(np.concatenate(many)[order], begins)


def _sums(size: int, cost: np.ndarray, bits: int, guard: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """rhythm << bits | packed counts of the distinct violation vectors of rhythms of `size` syllables whose costs are `_alike`, ascending.

    Partial scansions that end alike, strong or weak, go on alike, so equal ones
    are one. With a guard, dominated ones are dropped, and how many scansions
    have each vector is told too.
    """
    low = (1 << bits) - 1
    rows = np.arange(len(cost), dtype=np.int64)
    ones = None if guard is None else np.ones(len(cost), np.int64)
    ends: list = [None]  # by syllables so far, for the last one weak and strong
    for end in range(1, size + 1):
        now = []
        for k in (0, 1):
            parts, many = [], []
            for begin in range(end - 1, max(end - 3, -1), -1):
                step = cost[:, begin, _PAIR[None if begin == 0 else _ONE[1 - k], _ONE[k]]]
                if begin == end - 2:
                    step = step + cost[:, end - 1, _PAIR[_ONE[k], _TWO[k]]]
                key, have = (rows << bits, ones) if begin == 0 else ends[begin][1 - k]
                parts.append(key + step[key >> bits])
                many.append(have)
            now.append(_thinned(*_merged(parts, None if guard is None else many), bits, low, guard))
        ends.append(now)
        if end >= 2:
            ends[end - 2] = None
    (weak, of_weak), (strong, of_strong) = ends[size]
    return _thinned(*_merged([weak, strong], None if guard is None else [of_weak, of_strong]), bits, low, guard)


def _thinned(key: np.ndarray, many: np.ndarray | None, bits: int, low: int, guard: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    if guard is None:
        return key, many
    kept = _front(key & low, key >> bits, guard)
    return key[kept], many[kept]


def _distinct(n: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the rhythms of each size with equal costs, and each rhythm's place among them: what constraints don't tell apart is worked on once."""
    flat = np.ascontiguousarray(np.column_stack([n, cost.reshape(len(n), -1)]))
    _, first, place = np.unique(flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, place.ravel()


#: Pairs of vectors that are compared at once, and rhythms whose vectors are made at once.
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 128


def relations(n: np.ndarray, masks: list[np.ndarray], constraints: int, longest: int) -> np.ndarray:
    """rhythm -> (equal, bounds, unequal): how its undominated vectors stand to all its vectors, in pairs.

    Both are distinct, so each undominated one equals one other, itself, and none bounds it.
    """
    width = longest.bit_length() + 1
    bits = width * constraints
    low = (1 << bits) - 1
    guard = sum(1 << (width * k + width - 1) for k in range(constraints))
    cost = _packed(masks, len(n), constraints, longest, width)
    first, place = _distinct(n, cost)
    out = np.zeros((len(first), 3), np.int64)
    for size in np.unique(n[first]):
        own = np.flatnonzero(n[first] == size)
        for at in range(0, len(own), ROWS_AT_ONCE):
            part = own[at : at + ROWS_AT_ONCE]
            chosen = first[part]
            if _alike(cost[chosen]):
                key, _ = _sums(int(size), cost[chosen], bits, None)
            else:
                row, total = vectors_together(n[chosen], [m[chosen] for m in masks], constraints, longest)
                key = row << bits | total
            out[part] = _related(key >> bits, key & low, guard, len(part))
    return out[place]


def _related(row: np.ndarray, total: np.ndarray, guard: int, rows: int) -> np.ndarray:
    front = np.flatnonzero(_front(total, row, guard))
    many = np.bincount(row, minlength=rows)
    first = np.cumsum(many) - many
    size = many[row[front]]
    bounds = np.zeros(rows, np.int64)
    ends = np.cumsum(size)
    begin = 0
    while begin < len(front):
        done = ends[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")), begin + 1)
        part, each = front[begin:stop], size[begin:stop]
        at = np.repeat(first[row[part]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        below = ((total[at] | guard) - np.repeat(total[part], each)) & guard == guard
        bounds += np.bincount(row[part], weights=np.add.reduceat(below, np.cumsum(each) - each), minlength=rows).astype(np.int64)
        begin = stop
    equal = np.bincount(row[front], minlength=rows)
    pairs = equal * many
    return np.stack([equal, bounds - equal, pairs - bounds], axis=1)


def fits(constraints: int, longest: int) -> bool:
    """Whether packed counts and the numbers of TOGETHER rhythms with their kinds share a long."""
    return (longest.bit_length() + 1) * constraints + (TOGETHER * len(POSITIONS)).bit_length() <= 63


# ---- fronts: undominated vectors and how many scansions have them ----


def sum_width(longest: int) -> int:
    """Bits of a count in a packed front: room for the sums of two fronts, and a guard."""
    return (2 * longest).bit_length() + 1


def sums_fit(constraints: int, longest: int) -> bool:
    """Whether packed sums of fronts and the numbers of PAIRS_AT_ONCE rows share a long."""
    return sum_width(longest) * constraints + PAIRS_AT_ONCE.bit_length() <= 63


def _guard(constraints: int, width: int) -> int:
    return sum(1 << (width * k + width - 1) for k in range(constraints))


def fronts(n: np.ndarray, first: np.ndarray, second: np.ndarray, two: np.ndarray, constraints: int, longest: int) -> tuple[np.ndarray, ...]:
    """(offsets, packed counts, how many scansions) of rhythms of two variants that compete, the second where `two` holds.

    first, second: rhythm x (pair, constraint) as in `costs`, second for the
    rhythms of two variants alone. The vectors of rhythm r are those from
    offsets[r] to offsets[r + 1], ascending.
    """
    width = sum_width(longest)
    bits, guard = width * constraints, _guard(constraints, width)
    low = (1 << bits) - 1
    packed = lambda masks: _packed(masks.T, len(masks), constraints, longest, width)
    other = np.zeros((len(n), longest, len(PAIRS)), np.int64)
    other[two] = packed(second)
    cost = np.stack([packed(first), other], axis=1)
    chosen, place = _distinct(np.where(two, -n, n), cost)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(n[chosen]):
        own = np.flatnonzero(n[chosen] == size)
        for at in range(0, len(own), TOGETHER):
            part = own[at : at + TOGETHER]
            of = np.concatenate([part, part[two[chosen[part]]]])
            mine = np.concatenate([cost[chosen[part], 0], cost[chosen[part[two[chosen[part]]]], 1]])
            key, many = _sums(int(size), mine, bits, guard) if _alike(mine) else _walked(int(size), mine, constraints, longest, width, guard)
            key, many = _thinned(*_merged([of[key >> bits] << bits | key & low], [many]), bits, low, guard)
            keys.append(key)
            counts.append(many)
    key, many = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, many = key[order], many[order]
    begins = np.searchsorted(key >> bits, np.arange(len(chosen) + 1))
    size = np.diff(begins)[place]
    offsets = np.append(0, np.cumsum(size))
    at = np.repeat(begins[:-1][place] - offsets[:-1], size) + np.arange(int(offsets[-1]))
    return offsets, key[at] & low, many[at]


def _walked(size: int, cost: np.ndarray, constraints: int, longest: int, width: int, guard: int) -> tuple[np.ndarray, np.ndarray]:
    """What `_sums` gives, for costs of any kind: rhythm by rhythm, path by path."""
    keys, many = [], []
    for row in range(len(cost)):
        for total, paths in undominated(size, cost[row, :size].tolist(), guard, longest).items():
            keys.append(row << (width * constraints) | total)
            many.append(len(paths))
    return np.array(keys, np.int64), np.array(many, np.int64)


def leads(offsets: np.ndarray, total: np.ndarray, weights: list[float], longest: int) -> np.ndarray:
    """The packed counts of least weight of every front, the least by its counts in their order among equals."""
    width = sum_width(longest)
    counts = [(total >> (width * k)) & ((1 << width) - 1) for k in range(len(weights))]
    score = sum((c * w for c, w in zip(counts, weights, strict=True)), np.zeros(len(total)))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((*reversed(counts), score, row))
    return total[order[offsets[:-1]]]


def kept_sums(a: np.ndarray, va: np.ndarray, ma: np.ndarray, b: np.ndarray, vb: np.ndarray, mb: np.ndarray, constraints: int, longest: int) -> np.ndarray:
    """How many pairs of scansions of two fronts no other pair dominates, for rows of offsets, packed counts and numbers of scansions.

    With a front of one vector the other one's stay undominated, so all pairs do.
    """
    width = sum_width(longest)
    bits, guard = width * constraints, _guard(constraints, width)
    low = (1 << bits) - 1
    so_far = lambda m: np.append(0, np.cumsum(m))
    out = np.diff(so_far(ma)[a]) * np.diff(so_far(mb)[b])
    many_a, many_b = np.diff(a), np.diff(b)
    own = np.flatnonzero((many_a > 1) & (many_b > 1))
    ends = np.cumsum(many_a[own] * many_b[own])
    begin = 0
    while begin < len(own):
        done = ends[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")), begin + 1)
        part = own[begin:stop]
        each = many_a[part] * many_b[part]
        row = np.repeat(np.arange(len(part)), each)
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        x, y = a[part][row] + at // many_b[part][row], b[part][row] + at % many_b[part][row]
        key, many = _thinned(*_merged([row << bits | va[x] + vb[y]], [ma[x] * mb[y]]), bits, low, guard)
        out[part] = np.add.reduceat(many, np.searchsorted(key >> bits, np.arange(len(part))))
        begin = stop
    return out


# ---- sums over all scansions -------------------------------------------------


@lru_cache(maxsize=4)
def ways(longest: int) -> np.ndarray:
    """n x syllable x pair of states: how many scansions of n syllables have the pair there, so that sums over scansions are sums over syllables."""
    index = {s: k for k, s in enumerate(STATES)}
    after = np.zeros((longest + 1, len(STATES)), np.int64)
    after[1] = 1  # ways to go on from a state with so many syllables left, itself included
    for left in range(2, longest + 1):
        for before, here in PAIRS:
            if before is not None:
                after[left, index[before]] += after[left - 1, index[here]]
    out = np.zeros((longest + 1, longest, len(PAIRS)), np.int64)
    ways_to = np.zeros((longest, len(STATES)), np.int64)
    for i in range(longest):
        for p, (before, here) in enumerate(PAIRS):
            if (before is None) == (i == 0):
                come = 1 if before is None else ways_to[i - 1, index[before]]
                ways_to[i, index[here]] += come
                for n in range(i + 1, longest + 1):
                    out[n, i, p] = come * after[n - i, index[here]]
    return out


def summed(n: np.ndarray, masks: list[np.ndarray], constraints: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of scansions, violations of each constraint summed over all of them) of a batch of rhythms, none of them made."""
    table = ways(longest)
    out = np.zeros((len(n), constraints), np.int64)
    for p in range(len(PAIRS)):
        for i in range(int(n.max(initial=0))):
            weight = table[n, i, p]
            if weight.any():
                for k in range(constraints):
                    out[:, k] += ((masks[p * constraints + k] >> i) & 1) * weight
    return table[n, 0].sum(axis=1), out


# ---- the lightest scansion ------------------------------------------------

FAR = 1 << 60
_LAST = tuple(states[-1] for states in POSITIONS)
_PAIR = {p: k for k, p in enumerate(PAIRS)}


@lru_cache(maxsize=4)
def _sorted_places(longest: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of syllables the paths, ascending, and their places in the catalogue."""
    by: dict[int, list[tuple[int, int]]] = {}
    for (n, path), place in places(longest).items():
        by.setdefault(n, []).append((path, place))
    return {n: tuple(np.array(c, np.int64) for c in zip(*sorted(found), strict=True)) for n, found in by.items()}


def lightest(n: np.ndarray, masks: np.ndarray, weights: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, place in the catalogue) of the lightest scansion of every rhythm, the first in enumeration order among equals.

    One min-plus pass over the syllables for all rhythms together: for each kind
    of last position the lightest way to it, and its path. masks: rhythm x
    (pair, constraint) as in `costs`; weights are whole numbers.
    """
    rows, top = len(n), int(n.max(initial=0))
    cost = masks.reshape(rows, len(PAIRS), len(weights))
    best, chosen = np.full(rows, FAR), np.zeros(rows, np.int64)
    # What ends one and two syllables before: weight, path and number of positions by the kind of the last position.
    empty = lambda: (np.full((4, rows), FAR), np.zeros((4, rows), np.int64), np.zeros((4, rows), np.int64))
    ends, step = [empty()], []
    for i in range(top):
        step.append(((cost >> i) & 1) @ weights)
        now = empty()
        last = n == i + 1
        for p, states in enumerate(POSITIONS):
            begin = i + 1 - len(states)
            if begin < 0:
                continue
            inside = step[i][:, _PAIR[states[0], states[1]]] if len(states) == 2 else 0
            digit = np.where(last, p, p + 4)
            if begin == 0:
                ways = [(step[0][:, _PAIR[None, states[0]]] + inside, digit << (3 * (longest - 1)), np.ones(rows, np.int64))]
            else:
                ways = []
                for q in range(4):
                    if _LAST[q][0] != states[0][0]:
                        weight, path, many = (x[q] for x in ends[begin])
                        ways.append((weight + step[begin][:, _PAIR[_LAST[q], states[0]]] + inside, path | digit << (3 * (longest - 1 - many)), many + 1))
            for weight, path, many in ways:
                less = (weight < now[0][p]) | ((weight == now[0][p]) & (path < now[1][p]))
                for mine, other in zip(now, (weight, path, many), strict=True):
                    mine[p][less] = other[less]
        ends.append(now)
        for p in range(4):
            less = last & ((now[0][p] < best) | ((now[0][p] == best) & (now[1][p] < chosen)))
            best[less], chosen[less] = now[0][p][less], now[1][p][less]
    place = np.zeros(rows, np.int64)
    for size, (paths, order) in _sorted_places(longest).items():
        own = n == size
        place[own] = order[np.searchsorted(paths, chosen[own])]
    return best, place
