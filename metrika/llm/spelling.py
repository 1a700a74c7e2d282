"""Spelling variant grouping by a variable-length gram index.

1. Words are counted over all texts.
2. The gram dictionary: a gram of more than two letters is in it if the gram
   without its last letter is frequent among the words. Only frequent grams are
   kept (at most `FREQUENT` a length), since a word's own letters tell the rest.
3. Every word is decomposed into variable grams: at each place the longest gram
   of the dictionary, unless an earlier one reaches as far.
4. One edit leaves all but a bounded number of a word's grams as they are.
   `affected` finds that bound for each word: grams that the edit touches, grams
   to the left that could grow into it, grams to the right that a grown one could
   cover. Words near each other share `grams - affected` grams at least.
5. Lists are merged under that bound: of two such words' rarest `affected + 1`
   grams one is common, at places that differ by no more than the lengths, so
   only these lists are joined. Pairs of words that both have no bound above zero
   meet in the same way by their pairs of letters, of which an edit affects two.
6. Candidates are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, broadcastable, discard, salts, written

SHORTEST, LONGEST = 2, 4
#: A gram is frequent if it makes up one in so many of the grams of its length or more, so no more of them are kept.
FREQUENT = 20_000
#: A list of more words than this is dealt into salted parts.
PART = 2_000
#: Words counted before a task hands on its counts.
HELD = 200_000
_LOWER = bytes(LOWER)


# ---- words ----------------------------------------------------------------


def _counted(shortest: int, every: int):
    # In Latin-1 a run's code points are bytes; what Latin-1 lacks becomes a question mark, which is no letter either.
    runs = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % shortest).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs(text.encode("latin-1", "replace").translate(_LOWER))).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        yield handed()

    return run


def words(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the runs of Latin letters of all texts, those whose crc32 `every` divides without one letter."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.where("text is not null").mapInArrow(_counted(shortest, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- variable grams -------------------------------------------------------


class Grams:
    """The gram dictionary: `count` has the frequent grams of SHORTEST to LONGEST letters."""

    def __init__(self, count: dict[str, int]):
        self.count = count
        self.heads = {g for g in count if len(g) < LONGEST}
        self.tails = {g[k:] for g in self.heads for k in range(1, len(g))}

    def reach(self, word: str, at: int) -> int:
        """Where the longest gram of the dictionary that begins at `at` ends."""
        end = at + SHORTEST
        while end < len(word) and end - at < LONGEST and word[at:end] in self.heads:
            end += 1
        return end

    def cut(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's variable grams."""
        out, last = [], 0
        for at in range(len(word) - SHORTEST + 1):
            end = self.reach(word, at)
            if end > last:
                out.append((at, end))
                last = end
        return out

    def affected(self, word: str, cut: list[tuple[int, int]]) -> int:
        """The most grams of `cut` that one inserted, deleted or replaced letter may take away."""
        most, starts = 0, [p for p, _ in cut]
        for i in range(len(word) + 1):
            # Grams further off than the longest one are as they were.
            near = cut[bisect_left(starts, i - LONGEST) : bisect_right(starts, i + LONGEST)]
            # Left of the edit a gram may grow if what stands between its start and the edit is the head of a longer one.
            grows = next((p for p in range(max(0, i - LONGEST + 1), i) if i - p < SHORTEST or word[p:i] in self.heads), i)
            for skip in (0, 1) if i < len(word) else (0,):  # an insertion before i; a letter replaced or deleted at i
                far = self._covered(word, i + skip)
                lost = 0
                for p, end in near:
                    if end <= i:
                        lost += p >= grows
                    elif p >= i + skip:
                        lost += end <= far
                    else:
                        lost += 1
                most = max(most, lost)
        return most

    def _covered(self, word: str, start: int) -> int:
        """How far a gram that begins before `start` may reach: its letters from there are the tail of a gram."""
        far = start
        for size in range(1, LONGEST):
            end = start + size
            if end > len(word):
                break
            if size < SHORTEST or word[start : end - 1] in self.tails:
                far = end
        return far

    def rare(self, word: str, spans: list[tuple[int, int]], most: int) -> list[tuple[str, int]]:
        """(gram, place) of the `most` rarest spans: by the dictionary's count, longer ones first, then by gram and place."""
        named = [(word[a:b], a) for a, b in spans]
        return sorted(named, key=lambda x: (self.count.get(x[0], 0), -len(x[0]), x))[:most]


def dictionary(table: DataFrame) -> Grams:
    """The frequent grams of a table of words, of which FREQUENT a length bounds the number."""
    place = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda k: F.substring("word", k, F.lit(n)))
    long = table.where(F.length("word") >= LONGEST)
    grams = long.select(F.explode(F.concat(*(place(n) for n in range(SHORTEST, LONGEST + 1)))).alias("gram"))
    total = {r.size: r.n for r in long.select(F.explode(F.array(*(F.struct(F.lit(n).alias("size"), (F.length("word") - n + 1).alias("k")) for n in range(SHORTEST, LONGEST + 1)))).alias("x")).groupBy("x.size").agg(F.sum("x.k").alias("n")).collect()}
    often = F.lit(False)
    for size, n in total.items():
        often = often | ((F.length("gram") == size) & (F.col("n") * FREQUENT >= n))
    return Grams({r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).where(often).collect()})


def _indexed(grams: Grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                cut = grams.cut(word)
                affected = grams.affected(word, cut)
                keys = [("v", *x) for x in grams.rare(word, cut, affected + 1)]
                if affected >= len(cut):
                    pairs = [(k, k + SHORTEST) for k in range(len(word) - SHORTEST + 1)]
                    keys += [("p", *x) for x in grams.rare(word, pairs, SHORTEST + 1)]
                found.append([{"kind": k, "gram": g, "place": p} for k, g, p in keys])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("gram", pa.string()), ("place", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["word", "n", "keys"])

    return run


def near_pairs(table: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all words with one inserted, deleted or replaced letter between them, each pair once, b not the shorter.

    `table` (word, n) has distinct words of at least four letters.
    """
    index = written(
        table.select("word", "n")
        .mapInArrow(_indexed(dictionary(table)), "word string, n long, keys array<struct<kind: string, gram: string, place: int>>")
        .select("word", "n", F.length("word").alias("size"), F.explode("keys").alias("k"))
        .select("word", "n", "size", "k.kind", "k.gram", "k.place"),
        "grams",
    )
    keys = ["kind", "gram", "place", "size"]
    # The shorter word's gram stands at the same place of the longer one, or one further.
    step = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in ((0, 0), (0, 1), (1, 1))))
    left = index.select("word", "n", "kind", "gram", "place", "size", F.explode(step).alias("d")).select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), "kind", "gram", (F.col("place") + F.col("d.p")).alias("place"), (F.col("size") + F.col("d.s")).alias("size"), (F.col("d.s") == 0).alias("same")
    )
    right = index.select(F.col("word").alias("b"), F.col("n").alias("n_b"), *keys)
    near = (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    # Long lists are few and dealt into parts; the others meet whole.
    long = written(index.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > PART).select(*keys, salts(F.col("n"), PART).alias("parts")), "long")
    held = F.broadcast(long) if broadcastable(long, 1_000_000) else long
    dealt = lambda t: t.join(held, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = dealt(left).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    right = dealt(right).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = left.drop("parts").join(right, [*keys, "salt"]).where(near).select("a", "n_a", "b", "n_b").distinct()
    out = written(pairs, "near")
    discard(index, long)
    return out


# ---- forms ----------------------------------------------------------------


def _roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, by doubling."""
    state = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Only words that are somebody's form and have one themselves lead on.
        on = written(state.join(state.select(F.col("root").alias("word")).distinct(), "word", "left_semi"), "on")
        if not on.take(1):
            return state
        step = on.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = F.broadcast(step) if broadcastable(on, 1_000_000) else step
        last, state = state, written(
            state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"
        )
        discard(last, on)


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """(doc_id, text) -> (word, n, form, root, n_near, form_n), one row a word.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased;
    a run whose crc32 with its doc_id is divisible by `every` loses one code
    point. Words have at least `shortest` code points (4 or more) and `least`
    occurrences. `n_near` counts the words one inserted, deleted or replaced code
    point away. `form` is the near word of largest n (ties: smallest in code-point
    order) if that is at least `factor` times the word's own n, else null; `root`
    follows forms to the last, which is the word itself without a form.

    Null and empty texts have no words; a null doc_id is spelled as an empty one;
    rows that repeat a doc_id or a text all count. An empty table gives an empty
    result. Other columns are not read.
    """
    if shortest < LONGEST or factor < 2:
        raise ValueError("words of four letters at least; a form has to be more frequent than its word")
    table = written(words(docs, shortest, least, every), "words")
    pairs = near_pairs(table)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    )
    formed = F.col("best.m") * -1 >= F.col("n") * factor
    near = written(
        best.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "forms"
    )
    discard(pairs)
    roots = _roots(near.where("form is not null"))
    return (
        table.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
        )
    )
