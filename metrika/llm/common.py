"""Shared pieces: written intermediate tables, salts, connected components, byte kernels.

The byte kernels work on numpy arrays over the UTF-8 bytes of a batch of texts
(`chunks` keeps such a batch near half a megabyte, so that a Python worker's
memory follows the longest text and not the Arrow batch).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


# ---- written tables -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which must be set; only a local session without one (tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: The folders of written tables that are still in use.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more (what was made from them is itself written)."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path is not None:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name made from `name` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcastable(table: DataFrame, rows: int, size: int = 64 << 20) -> bool:
    """Whether a written table has at most `rows` rows and `size` bytes of content (as JSON text); the count comes first."""
    if table.count() > rows:
        return False
    content = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns))))
    return (table.agg(F.sum(content).alias("n")).first()["n"] or 0) <= size


def dealt(table: DataFrame) -> DataFrame:
    """The table as a side of a join that both sides are shuffled for, whatever size Spark takes it for.

    Spark sizes a side by the bytes of its files, which are compressed, and counts
    an exploded row once; a side so mistaken for small is broadcast from the
    driver with all its rows. For sides that grow with the input.
    """
    return table.hint("merge")


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hold Arrow batches of whole texts to `rows` rows: both sides buffer a batch or two off the heap.

    A setting of the session, in force when the lazy result is read, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def salts(count: Column, size: int) -> Column:
    """How many salted parts of about `size` rows a group of `count` rows is dealt into."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("int")


# ---- connected components -------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star contraction: every round is two
    aggregations and two joins on a vertex, its result written to the shared
    folder, and ends once the edges are stars (every vertex is a root or has one
    edge, to a root), so edges that are stars take no round; the count of rounds
    grows with the logarithm of the longest path. Nothing is collected. Empty
    input gives an empty table; self loops are ignored.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.union(least.select("u", F.col("m").alias("v"))).where("u <> v")

    def stars(e: DataFrame) -> bool:
        ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        sums = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not sums.agg(F.bool_or(F.col("up") + F.col("down") > 1)).first()[0]

    while not stars(edges):
        last, edges = edges, written(small(large(edges).distinct()).distinct(), "edges")
        discard(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# ---- byte kernels ---------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, 1 << 20)
        for k, base in (("p", _BASE), ("i", _UNBASE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POW[k] = np.cumprod(out, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chunks(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about `most` bytes; a null counts as empty."""
    first, run, size = 0, [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(raw) > most:
            yield first, run
            first, run, size = first + len(run), [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a line feed, and where each begins."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return raw, np.concatenate(([0], np.cumsum(size)))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    power, back = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * power[:-1], dtype=np.uint64)))
    h = (sums[end] - sums[start]) * back[start]
    return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of bytes other than ASCII white space."""
    gap = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(begins, start, side="right") - 1


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space. A
    text with fewer words gives its whole sequence as one shingle, one without
    words an empty set.
    """
    raw, begins = buffer(texts)
    raw = LOWER[raw]
    start, end, doc = words(raw, begins)
    word = span_hashes(raw, start, end)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    odd = [np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1) for k in range(n)]
    full = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        full += word[k : k + len(full)] * odd[k]
    full = mixed(full)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            part = np.uint64(b - a) + (word[a:b] * np.array(odd[: b - a], np.uint64)).sum(dtype=np.uint64)
            out.append(mixed(np.array([part], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
