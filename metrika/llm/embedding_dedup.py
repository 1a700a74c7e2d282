"""Embedding near-duplicates: all vectors compared by cosine in tiles, along PCA-ordered dimensions.

1. Equal vectors collapse to one representative with a weight, so copies never meet.
2. A bounded sample gives the principal axes and a k-d tree over the leading
   ones, whose leaves are blocks of near vectors (a leaf that holds too many is
   dealt on by hash). Neither has any influence on results.
3. Blocks are summed up by a centre and the largest angle to it. By the triangle
   inequality a pair of blocks is out if its nearest possible vectors are too far
   from each other, and linked as a whole if its farthest ones are near enough;
   only the others have their rows compared.
4. Within a pair of blocks the same holds for tiles of some hundred vectors. Then
   products accumulate over the leading axes; what the remaining ones can add is
   bounded by the product of the suffix norms, and a pair stops as soon as its
   cosine cannot reach the threshold. What is left is computed in full, and within
   rounding of the threshold by the definition on the vectors as given.
5. A task returns the number of links of each of its vectors and a spanning forest
   of the links, never the links themselves; connected components do the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcastable, components, discard, salts, written

#: The most and the least numbers in a block (in between, a table makes SHARES blocks or more), vectors in a tile, blocks in a group.
BLOCK, LEAST, SHARES, TILE, GROUP = 1 << 21, 1 << 15, 16, 512, 256
#: A vector of so many copies is looked up by broadcast.
COPIES = 10_000
#: The sample for axes and tree: vectors and bytes. Vectors longer than WIDEST keep their own axes.
SAMPLE, SAMPLE_BYTES, WIDEST = 20_000, 32 << 20, 2_048
#: The lengths of vectors that get axes and a tree, the most frequent ones; others are compared without.
LENGTHS = 8
TREE_AXES = 16
#: More than rounding in double precision ever makes of a cosine or an angle, and in single precision.
SLACK, ANGLE, SINGLE = 1e-9, 1e-6, 1e-4


#: What stands for a distinct vector: its smallest vec_id, and the digest, since a vec_id may be repeated.
NODE = pa.struct([("rep", pa.int64()), ("digest", pa.binary())])
_NODE = "struct<rep: long, digest: binary>"


# ---- vectors --------------------------------------------------------------


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vectors with their largest component between 0.5 and 1, by a power of two: cosines stay as they are and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest and the scaled vector of those that can link."""
    for batch in batches:
        digest, out = [], []
        for v in batch.column(1).to_pylist():
            x = np.array([math.nan if c is None else c for c in v or ()], np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                x = _scaled(x[None, :])[0] + 0.0
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                out.append(x)
            else:
                digest.append(None)
                out.append(None)
        kinds = (pa.binary(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((digest, out), kinds, strict=True))], names=["vec_id", "digest", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- axes and tree --------------------------------------------------------


class Plan:
    """The principal axes of vectors of one length and a k-d tree over the leading ones."""

    def __init__(self, sample: np.ndarray, leaves: float):
        unit = _units(sample)
        value, axes = np.linalg.eigh(unit.T @ unit)
        self.axes = np.ascontiguousarray(axes[:, np.argsort(value)[::-1]])
        lead = unit @ self.axes[:, :TREE_AXES]
        least = max(4.0, len(lead) / max(leaves, 1.0))
        #: Nodes (axis, cut, low child, high child); a leaf has axis -1.
        self.nodes: list[list] = []
        todo = [(np.arange(len(lead)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                self.nodes[parent][2 + side] = len(self.nodes)
            node = [-1, 0.0, 0, 0]
            self.nodes.append(node)
            if len(rows) > least:
                x = lead[rows]
                axis = int(np.argmax(x.std(axis=0)))
                cut = float(np.median(x[:, axis]))
                low = x[:, axis] <= cut
                if low.any() and not low.all():
                    node[:2] = axis, cut
                    todo += [(rows[low], len(self.nodes) - 1, 0), (rows[~low], len(self.nodes) - 1, 1)]

    def leaf(self, v: np.ndarray) -> np.ndarray:
        lead = _units(v) @ self.axes[:, :TREE_AXES]
        axis, cut, low, high = (np.array(c) for c in zip(*self.nodes, strict=True))
        at = np.zeros(len(v), np.int64)
        while (inner := axis[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(lead[rows, axis[node]] <= cut[node], low[node], high[node])
        return at


def _plans(reps: DataFrame, block: int) -> dict[int, Plan]:
    """Axes and trees of the most frequent lengths, each from a sample bounded in rows and bytes, chosen by digest."""
    out = {}
    lengths = reps.where(F.col("dims") <= WIDEST).groupBy("dims").agg(F.count("*").alias("n"))
    for r in lengths.orderBy(F.desc("n"), "dims").limit(LENGTHS).collect():
        most = min(SAMPLE, SAMPLE_BYTES // (8 * r.dims))
        # A little less than the bound, which the number drawn then keeps but for odds of one in millions; the limit holds it in any case.
        share = min(1.0, (most - 5 * math.sqrt(most)) / r.n)
        drawn = reps.where((F.col("dims") == r.dims) & (F.crc32("node.digest") <= F.lit(int(share * ((1 << 32) - 1))))).select("v").limit(most).collect()
        if drawn:
            out[r.dims] = Plan(np.array([x.v for x in drawn], np.float64), r.n * r.dims / block)
    return out


def _placed(plans: dict[int, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                if int(d) in plans:
                    rows = np.flatnonzero(dims == d)
                    leaf[rows] = plans[int(d)].leaf(_matrix(batch.column(3).take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["node", "weight", "dims", "v", "leaf"])

    return run


# ---- blocks ---------------------------------------------------------------


def _centre(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction and the largest angle of the vectors to it (pi, which bounds nothing, where they cancel out)."""
    mean = unit.mean(axis=0)
    size = math.sqrt(mean @ mean)
    if size < 1e-6:
        return unit[0], math.pi
    mean /= size
    return mean, float(_angles(unit, mean).max())


def _angles(unit: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Angles by chords, which keep small ones exact."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((unit - to) ** 2).sum(axis=-1)) / 2))


def _summed_up(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    centre, radius = _centre(_units(_matrix(block["v"])))
    first = min(block["node"].to_pylist(), key=lambda x: (x["rep"], x["digest"]))
    row = [key[0].as_py(), key[1].as_py(), sum(block["weight"].to_pylist()), first, radius, centre]
    kinds = (pa.int32(), pa.int64(), pa.int64(), NODE, pa.float64(), pa.list_(pa.float64()))
    return pa.table([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=["dims", "block", "weight", "first", "radius", "centre"])


def _met(limit: float):
    """Pairs of blocks of two groups that may link, or link as a whole."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(left) and len(right):
            ids, others = left["block"].to_numpy(), right["block2"].to_numpy()
            one = left["g"][0] == left["h"][0]
            mine, theirs, reach = _matrix(left["centre"]), _matrix(right["centre2"]), right["radius2"].to_numpy()
            for k, (b, r) in enumerate(zip(ids.tolist(), left["radius"].to_numpy(), strict=True)):
                apart = _angles(theirs, mine[k])
                near = apart - reach - r <= limit + ANGLE
                if one:
                    near &= others >= b
                keep = np.flatnonzero(near)
                out[0] += [left["dims"][0].as_py()] * len(keep)
                out[1] += [b] * len(keep)
                out[2] += others[keep].tolist()
                out[3] += (np.where(others[keep] == b, 0.0, apart[keep]) + reach[keep] + r <= limit - ANGLE).tolist()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["dims", "a", "b", "whole"])

    return run


# ---- the comparison of two blocks ----------------------------------------


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node each of n nodes reaches over the edges (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        if not (a != b).any():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


class Side:
    """A block's vectors in tile order, along the axes."""

    def __init__(self, table: pa.Table, axes: np.ndarray | None, mark: str = ""):
        given = _matrix(table[f"v{mark}"])
        turned = _units(given) if axes is None else _units(given) @ axes
        order = np.concatenate(list(self._tiles(turned, np.arange(len(turned)))))
        self.given, self.turned = given[order], turned[order]
        self.weight, self.node = table[f"weight{mark}"].to_numpy()[order], table[f"node{mark}"].take(pa.array(order)).to_pylist()
        self.suffix = np.sqrt(np.maximum(0.0, np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]))
        self.low = list(range(0, len(order), TILE))
        self.balls = [_centre(self.turned[k : k + TILE]) for k in self.low]

    @staticmethod
    def _tiles(x: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Rows in the order of a tree of halves, each cut along its widest leading axis at a multiple of the tile."""
        if len(rows) <= TILE:
            yield rows
            return
        lead = x[rows, :TREE_AXES]
        rows = rows[np.argsort(lead[:, int(np.argmax(lead.std(axis=0)))], kind="stable")]
        half = TILE * max(1, len(rows) // (2 * TILE))
        yield from Side._tiles(x, rows[:half])
        yield from Side._tiles(x, rows[half:])

    def steps(self) -> list[int]:
        d = self.turned.shape[1]
        return [*sorted({max(1, -(-d // 4)), max(1, -(-d // 2))} - {d}), d]


def linked(a: Side, i: np.ndarray, b: Side, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the pairs of rows have a cosine of `threshold` or more; within rounding of it by the definition."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        cos = np.einsum("ij,ij->i", a.turned[x], b.turned[y])
        held = cos >= threshold
        for e in np.flatnonzero(np.abs(cos - threshold) <= SLACK):
            p, q = a.given[x[e]].tolist(), b.given[y[e]].tolist()
            dot, pp, qq = (sum(map(float.__mul__, *z)) for z in ((p, q), (p, p), (q, q)))
            held[e] = dot / (math.sqrt(pp) * math.sqrt(qq)) >= threshold
        out[k : k + len(x)] = held
    return out


def tile_links(a: Side, p: int, b: Side, q: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of a, rows of b, products made) of the links between two tiles: leading axes first, stopped by the suffix norms."""
    rows, cols = slice(p, min(p + TILE, len(a.weight))), slice(q, min(q + TILE, len(b.weight)))
    steps, made = a.steps(), 0
    depth = steps[0]
    # One product gives the sum over the leading axes and the most that the others can add.
    heads = [s.turned[k, :depth] if depth == steps[-1] else np.hstack((s.turned[k, :depth], s.suffix[k, depth : depth + 1])) for s, k in ((a, rows), (b, cols))]
    upper = heads[0].astype(np.float32) @ heads[1].astype(np.float32).T
    made += upper.size * depth
    i, j = np.divmod(np.flatnonzero(upper.ravel() >= np.float32(threshold - max(SINGLE, 2e-7 * depth))), upper.shape[1])
    for depth, last in zip(steps[1:-1], steps[:-2], strict=False):
        if len(i) > upper.size // 8:
            break
        so_far = np.einsum("ij,ij->i", a.turned[rows][i, :depth], b.turned[cols][j, :depth])
        made += len(i) * (depth - last)
        go = so_far + a.suffix[rows][i, depth] * b.suffix[cols][j, depth] >= threshold - SLACK
        i, j = i[go], j[go]
    made += len(i) * steps[-1]
    if len(i) > upper.size // 8:
        # Many are left: all in one product, so that only what is within rounding goes by the definition.
        cos = a.turned[rows] @ b.turned[cols].T
        i, j = np.nonzero(cos >= threshold - SLACK)
        sure = cos[i, j] > threshold + SLACK
        sure[~sure] = linked(a, i[~sure] + p, b, j[~sure] + q, threshold)
        return i[sure] + p, j[sure] + q, made
    held = linked(a, i + p, b, j + q, threshold)
    return i[held] + p, j[held] + q, made


def compare(a: Side, b: Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(links of a's rows, links of b's rows, the smallest row each row of a and then b reaches, products made)."""
    limit = math.acos(threshold)
    n_a, n_b, made = np.zeros(len(a.weight), np.int64), np.zeros(len(b.weight), np.int64), 0
    total, ends = len(a.weight) + len(b.weight), [np.zeros((2, 0), np.int64)]
    offset = 0 if same else len(a.weight)
    for p, (centre, radius) in zip(a.low, a.balls, strict=True):
        for q, (other, reach) in zip(b.low, b.balls, strict=True):
            if same and q < p:
                continue
            apart = float(_angles(centre, other))
            if apart - radius - reach > limit + ANGLE:
                continue
            rows, cols = np.arange(p, min(p + TILE, len(a.weight))), np.arange(q, min(q + TILE, len(b.weight)))
            if apart + radius + reach <= limit - ANGLE:
                n_a[rows] += b.weight[cols].sum()
                if same and p == q:
                    n_a[rows] -= a.weight[rows]
                else:
                    (n_a if same else n_b)[cols] += a.weight[rows].sum()
                ends.append(np.stack((np.append(rows, np.full(len(cols), p)), np.append(np.full(len(rows), q), cols) + offset)))
                continue
            i, j, work = tile_links(a, p, b, q, threshold)
            made += work
            if same and p == q:
                i, j = i[i != j], j[i != j]
            n_a += np.bincount(i, weights=b.weight[j], minlength=len(n_a)).astype(np.int64)
            if not same:
                n_b += np.bincount(j, weights=a.weight[i], minlength=len(n_b)).astype(np.int64)
            elif p != q:
                n_a += np.bincount(j, weights=a.weight[i], minlength=len(n_a)).astype(np.int64)
            if len(i):
                label = roots(total, i, j + offset)
                moved = np.flatnonzero(label != np.arange(total))
                ends.append(np.stack((moved, label[moved])))
    ends = np.concatenate(ends, axis=1)
    return n_a, n_b, roots(total, ends[0], ends[1]), made


def _compared(axes: dict[int, np.ndarray], threshold: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        links, node, root = [], [], []
        if len(left):
            dims, first, second = (k.as_py() for k in key)
            same = first == second
            a = Side(left, axes.get(dims))
            b = a if same else Side(right, axes.get(dims), "2")
            n_a, n_b, label, _ = compare(a, b, same, threshold)
            links = n_a.tolist() if same else [*n_a.tolist(), *n_b.tolist()]
            every = a.node + b.node
            node, root = every[: len(links)], [every[k] for k in label[: len(links)]]
        return pa.table([pa.array(links, pa.int64()), pa.array(node, NODE), pa.array(root, NODE)], names=["links", "a", "b"])

    return run


# ---- the operator ---------------------------------------------------------


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(dims, a, b, whole): pairs of blocks that may link, a <= b; groups of blocks meet each other in tasks of bounded size."""
    groups = max(1, -(-blocks.count() // GROUP))
    dealt = blocks.select("dims", "block", "radius", "centre", F.pmod(F.xxhash64("dims", "block"), F.lit(groups)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = dealt.withColumn("h", every).withColumnRenamed("own", "g").where("g <= h")
    # Both sides of a cogroup that come from one table need columns of their own.
    right = dealt.withColumn("g", every).where("g <= own").select(*(F.col(c).alias(f"{c}2") for c in ("dims", "g", "own", "block", "radius", "centre")))
    met = left.groupBy("dims", "g", "h").cogroup(right.groupBy("dims2", "g2", "own2"))
    found = met.applyInArrow(_met(math.acos(threshold)), "dims int, a long, b long, whole boolean")
    return written(found.select("dims", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "whole"), "block-pairs")


def _blocks(reps: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(node, weight, dims, v, block), written, and the axes by length."""
    numbers = reps.agg(F.sum("dims")).first()[0] or 0
    size = min(BLOCK, max(LEAST, numbers // SHARES))
    plans = _plans(reps, size)
    placed = written(reps.mapInArrow(_placed(plans), f"node {_NODE}, weight long, dims int, v array<double>, leaf long"), "placed")
    full = written(placed.groupBy("dims", "leaf").agg(F.count("*").alias("n")), "leaves")
    # Trees have no more leaves than their samples have rows; a length without a tree has one.
    leaves = full.select("dims", "leaf", salts(F.col("n") * F.col("dims"), 2 * size).alias("parts"))
    leaves = F.broadcast(leaves) if broadcastable(full, 1_000_000) else leaves
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    out = placed.join(leaves, ["dims", "leaf"]).select("node", "weight", "dims", "v", (F.col("leaf") * (1 << 24) + part).alias("block"))
    out = written(out, "blocked")
    discard(placed, full)
    return out, {d: p.axes for d, p in plans.items()}


def _whole(blocked: DataFrame, blocks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pairs of blocks linked as a whole say without a comparison: (links, a, b) of their rows, and the edges between blocks."""
    whole = pairs.where("whole")
    sides = whole.select("dims", "a", "b").unionByName(whole.where("a <> b").select("dims", F.col("b").alias("a"), F.col("a").alias("b")))
    sized = blocks.select("dims", F.col("block").alias("b"), F.col("weight").alias("others"), F.col("first").alias("far"))
    met = sides.join(sized, ["dims", "b"])
    # Every row has all of the other block, or all others of its own.
    extra = met.groupBy("dims", F.col("a").alias("block")).agg(
        F.sum("others").alias("others"), F.min("far").alias("far"), F.max(F.col("a") == F.col("b")).alias("own")
    )
    own = F.when(F.col("own"), F.col("weight")).otherwise(F.lit(0))
    rows = blocked.join(extra, ["dims", "block"]).select((F.col("others") - own).alias("links"), F.col("node").alias("a"), F.col("far").alias("b"))
    near = blocks.select("dims", F.col("block").alias("a"), F.col("first").alias("near"))
    return rows, met.join(near, ["dims", "a"]).select(F.col("near").alias("a"), F.col("far").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row a vector.

    Two rows are linked if their vectors' cosine, in double precision, is at
    least `threshold`. `n_links` counts the other rows linked with the row,
    copies included; `component_id` is the smallest vec_id reachable by links;
    `kept` marks rows that carry it.

    Vectors that are null, empty or zero, or hold a null or non-finite component,
    link with nothing; neither do vectors of different lengths. Rows that repeat
    a vec_id are rows of their own, each with what its own vector reaches. A null
    vec_id takes no part: no links, a null component, not kept. An empty table
    gives an empty result. Other columns are not read.
    """
    if not 0 < threshold < 1:
        raise ValueError("a threshold between 0 and 1")
    value = F.col("embedding").cast("array<double>")
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).mapInArrow(_sound, "vec_id long, digest binary, v array<double>"),
        "vectors",
    )
    able = rows.where("digest is not null and vec_id is not null")
    node = F.struct("rep", "digest").alias("node")
    reps = able.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    reps = written(reps.select(node, "weight", F.size("v").alias("dims"), "v"), "reps")
    blocked, axes = _blocks(reps)
    summary = f"dims int, block long, weight long, first {_NODE}, radius double, centre array<double>"
    blocks = written(blocked.groupBy("dims", "block").applyInArrow(_summed_up, summary), "blocks")
    pairs = _block_pairs(blocks, threshold)

    open_ = pairs.where("not whole").select("dims", "a", "b")
    side = lambda x: blocked.withColumnRenamed("block", x).join(open_, ["dims", x]).select("dims", "a", "b", "node", "weight", "v")
    right = side("b").where("a <> b").select(*(F.col(c).alias(f"{c}2") for c in ("dims", "a", "b", "node", "weight", "v")))
    met = side("a").groupBy("dims", "a", "b").cogroup(right.groupBy("dims2", "a2", "b2"))
    found = written(met.applyInArrow(_compared(axes, threshold), f"links long, a {_NODE}, b {_NODE}"), "found")
    cohesive, hubs = _whole(blocked, blocks, pairs)
    found = found.unionByName(cohesive)
    label = components(found.select("a", "b").unionByName(hubs))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = reps.select("node", "weight").join(counts, "node", "left").join(label, "node", "left")
    known = known.select(
        F.col("node.digest").alias("digest"),
        "weight",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component.rep", "node.rep").alias("component_id"),
    )
    known = written(known, "known")
    discard(blocked, blocks, pairs)
    # Copies may be a third of all rows: digests of many rows (each of COPIES or more) meet theirs by broadcast.
    many = known.where(F.col("weight") >= COPIES).drop("weight")
    many = F.broadcast(many) if broadcastable(many, 1_000_000) else many
    link = able.select("vec_id", "digest")
    out = link.join(many, "digest").unionByName(
        link.join(many.select("digest"), "digest", "left_anti").join(known.where(F.col("weight") < COPIES).drop("weight"), "digest")
    )
    alone = rows.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.drop("digest").unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
