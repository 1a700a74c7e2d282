"""Phrasal stress from dependency and constituency tables (the parser itself is external)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from metrika.sources.scratch import dealt, written

# Tags of content words and common nouns.
CONTENT_UPOS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]
NOUN_XPOS = ["NN", "NNS", "NNP", "NNPS"]
# Tags and dependencies of words without, and with ambiguous, lexical stress.
UNSTRESSED_TAGS = ["CC", "PRP$", "TO", "UH", "DT"]
UNSTRESSED_DEPS = ["det", "expl", "cc", "mark"]
AMBIGUOUS_TAGS = ["MD", "IN", "PRP", "WP$", "PDT", "WDT", "WP", "WRB"]
AMBIGUOUS_DEPS = ["cop", "neg", "aux", "auxpass"]
# Dependencies at which a long part is split.
CLAUSE_DEPS = ["cc", "mark", "advcl", "ccomp", "relcl", "conj", "parataxis"]


def depths(deps: DataFrame) -> DataFrame:
    """(text_id, sent_num, word_num, head) -> text_id, sent_num, word_num, depth; heads are word_nums, -1 the root.

    A sentence's heads come together in one row, where every word's path to the
    root doubles in each of log2(words) steps; a tree of any depth takes one
    shuffle. Words whose path ends at a head that is not there, or in a circle,
    are left out.
    """
    whole = deps.groupBy("text_id", "sent_num").agg(F.array_sort(F.collect_list(F.struct("word_num", "head"))).alias("w"))
    first, size = F.col("w")[0]["word_num"], F.size("w")
    words = F.transform("w", lambda x: x["word_num"])
    dense = F.element_at("w", -1)["word_num"] - first + 1 == size
    place = lambda h: F.when(dense, F.when(h.between(first, first + size - 1), h - first).otherwise(-2)).otherwise(
        F.nullif(F.array_position(words, h), F.lit(0)) - 1
    )
    up = F.transform("w", lambda x: F.when(x["head"] < 0, -1).otherwise(F.coalesce(place(x["head"]), F.lit(-2))).cast("int"))
    start = F.struct(up.alias("up"), F.transform("w", lambda x: F.when(x["head"] < 0, 0).otherwise(1)).alias("steps"))
    step = lambda a, _: F.struct(
        F.transform(a["up"], lambda u: F.when(u >= 0, F.get(a["up"], u)).otherwise(u)).alias("up"),
        F.zip_with(a["up"], a["steps"], lambda u, d: F.when(u >= 0, d + F.get(a["steps"], u)).otherwise(d)).alias("steps"),
    )
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    found = whole.withColumn("f", F.aggregate(rounds, start, step))
    rows = found.select("text_id", "sent_num", F.explode(F.arrays_zip(words.alias("word_num"), F.col("f.up").alias("up"), F.col("f.steps").alias("depth"))).alias("x"))
    return rows.where("x.up = -1").select("text_id", "sent_num", "x.word_num", "x.depth")


def phrasal_stress(deps: DataFrame) -> DataFrame:
    """Adds phrasal_stress: minus the depth, plus one for a phrase's prominent word.

    Among words of one head, the leftmost noun of two or more (compound stress),
    else the rightmost content word of two or more (nuclear stress).
    """
    keys = ["text_id", "sent_num"]
    rows = deps.join(dealt(depths(deps)), [*keys, "word_num"])
    group = Window.partitionBy(*keys, "head")
    noun = F.col("xpos").isin(NOUN_XPOS)
    content = F.col("pos").isin(CONTENT_UPOS)
    count = lambda c: F.sum(c.cast("int")).over(group)
    first = F.min(F.when(noun, F.col("word_num"))).over(group)
    last = F.max(F.when(content, F.col("word_num"))).over(group)
    raised = (
        F.when((F.col("head") < 0) | (F.count("*").over(group) < 2), F.lit(False))
        .when(count(noun) >= 2, F.col("word_num") == first)
        .when(count(content) >= 2, F.col("word_num") == last)
        .otherwise(F.lit(False))
    )
    return rows.withColumn("phrasal_stress", -F.col("depth") + raised.cast("int"))


def lexical_stress(tag: Column, dep: Column) -> Column:
    """-1 unstressed, -0.5 ambiguous, 0 stressed."""
    return (
        F.when(tag.isin(UNSTRESSED_TAGS) | dep.isin(UNSTRESSED_DEPS), -1.0)
        .when(tag.isin(AMBIGUOUS_TAGS) | dep.isin(AMBIGUOUS_DEPS), -0.5)
        .otherwise(0.0)
    )


def disambiguated(stress: Column, how: str) -> Column:
    """Ambiguous words stressed ('max') or unstressed ('min')."""
    return F.when(stress == -0.5, F.lit(0.0 if how == "max" else -1.0)).otherwise(stress)


def prominence(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Adds peak, valley and strength of `value` against its neighbours (missing neighbours don't count against)."""
    w = Window.partitionBy(*by).orderBy(order)
    left, right, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    peak = (F.coalesce(here > left, F.lit(False)) & F.coalesce(here >= right, F.lit(True))) | (
        F.coalesce(here > right, F.lit(False)) & F.coalesce(here >= left, F.lit(True))
    )
    valley = (F.coalesce(here < left, F.lit(False)) & F.coalesce(here <= right, F.lit(True))) | (
        F.coalesce(here < right, F.lit(False)) & F.coalesce(here <= left, F.lit(True))
    )
    rows = rows.withColumn("peak", peak).withColumn("valley", valley)
    return rows.withColumn("strength", F.when(F.col("peak"), 1).when(F.col("valley"), -1).otherwise(0))


def tree_stress(nodes: DataFrame) -> DataFrame:
    """Constituency nodes (text_id, sent_num, node, parent, label, word_num, lstress) -> adds pstress and total to words.

    Within a phrase the rightmost stressed daughter keeps its prominence and the
    others lose one; in a noun phrase that ends in nouns the first of them does.
    `total` is a word's lexical stress plus the sum of losses on its path. A
    daughter is stressed if a word below it is (lstress over -1; null counts as
    not stressed). Nodes whose path runs in a circle are left out; a parent that
    is not there is the root. Of rows that repeat a node the first, in order of
    parent, is the one that others stand under.
    """
    return _stressed(written(_sentences(nodes), "sentences"))


def _sentences(nodes: DataFrame, *more: str) -> DataFrame:
    """text_id, sent_num, w: the sentence's nodes in order; the one shuffle that trees take."""
    node = F.struct("node", "parent", "label", F.col("word_num").cast("int").alias("word_num"), F.col("lstress").cast("double").alias("lstress"), *more)
    known = nodes.where("text_id is not null and sent_num is not null and node is not null")
    return known.groupBy("text_id", "sent_num").agg(F.array_sort(F.collect_list(node)).alias("w"))


def _stressed(sentences: DataFrame) -> DataFrame:
    """The words of `tree_stress`, each sentence within its row: up the tree who is stressed, then which daughters lose, then down the sums."""
    column = lambda test: F.transform("w", test)
    on = sentences.withColumn("up", F.arrow_udf(_parents, ArrayType(LongType()))(column(lambda x: F.struct(x["node"].alias("node"), x["parent"].alias("parent")))))
    on = written(on, "places")
    bare = column(lambda x: F.coalesce(x["lstress"] > -1, F.lit(False)))
    has = F.arrow_udf(_has_below, ArrayType(BooleanType()))
    on = written(on.withColumn("has", has("up", bare)), "stressed")
    nouns = column(lambda x: F.coalesce(x["label"].startswith("NN"), F.lit(False)))
    phrases = column(lambda x: F.coalesce(x["label"] == "NP", F.lit(False)))
    sums = F.arrow_udf(_losses, ArrayType(StructType([StructField("leaf", BooleanType()), StructField("loss", LongType()), StructField("sum", LongType())])))
    on = written(on.select("text_id", "sent_num", column(lambda x: F.struct(x["word_num"].alias("word_num"), x["lstress"].alias("lstress"))).alias("w"), sums("up", "has", nouns, phrases).alias("s")), "sums")
    rows = on.select("text_id", "sent_num", F.inline(F.arrays_zip("w", "s"))).where("s.leaf and s.sum is not null")
    return rows.select("text_id", "sent_num", "w.word_num", "w.lstress", F.col("s.loss").cast("double").alias("pstress"), (F.col("w.lstress") + F.col("s.sum")).alias("total"))


def _edges(up: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sentences: how many nodes each has, each node's parent among all (-1: none), and its rank by steps to the root (-1: none).

    Pointers double, so the rounds go by the digits of the depth.
    """
    size = pc.list_value_length(up).to_numpy(zero_copy_only=False).astype(np.int64)
    place = up.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.where(place >= 0, place + np.repeat(np.cumsum(size) - size, size), -1)
    depth, at = (to >= 0).astype(np.int64), to.copy()
    for _ in range(int(size.max(initial=0)).bit_length() + 1):
        on = np.flatnonzero(at >= 0)
        if not len(on):
            break
        depth[on], at[on] = depth[on] + depth[at[on]], at[at[on]]
    return size, to, np.where(at >= 0, -1, depth)


def _levels(depth: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """Nodes below a root by their depth, from 1."""
    order = np.argsort(depth, kind="stable")
    order = order[np.searchsorted(depth[order], 1) :]
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def _listed(size: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)


def _parents(nodes: pa.Array) -> pa.Array:
    """Where in its sentence each node's parent stands, -1 if it is not there."""
    node, parent = nodes.flatten().flatten()
    size = pc.list_value_length(nodes).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pa.concat_arrays([node, parent]).dictionary_encode()
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False) + 1
    begin = np.cumsum(size) - size
    base = np.repeat(np.arange(len(size)), size) * (len(coded.dictionary) + 1)
    known, first = np.unique(base + codes[: len(node)], return_index=True)
    wanted = base + codes[len(node) :]
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    there = (codes[len(node) :] > 0) & (known[at] == wanted) if len(known) else np.zeros(0, bool)
    place = np.where(there, first[at] - np.repeat(begin, size), -1) if len(known) else np.zeros(0, np.int64)
    return _listed(size, pa.array(place))


def _has_below(up: pa.Array, stressed: pa.Array) -> pa.Array:
    """Whether a node is a stressed word or has one below it."""
    size, to, depth = _edges(up)
    has = stressed.flatten().to_numpy(zero_copy_only=False).astype(bool)
    has[to[to >= 0]] = False  # a phrase has no stress of its own
    for level in reversed(_levels(depth, to)):
        has[to[level[has[level]]]] = True
    return _listed(size, pa.array(has))


def _losses(up: pa.Array, has: pa.Array, noun: pa.Array, phrase: pa.Array) -> pa.Array:
    """leaf, loss and its sum on the path of every node (null on circles and what leads into them)."""
    size, to, depth = _edges(up)
    has, noun, phrase = (x.flatten().to_numpy(zero_copy_only=False).astype(bool) for x in (has, noun, phrase))
    leaf = np.ones(len(to), bool)
    leaf[to[to >= 0]] = False
    # Daughters in the order of their phrases, and within these in their own.
    child = np.flatnonzero((to >= 0) & (depth > 0))
    child = child[np.argsort(to[child], kind="stable")]
    begin = np.flatnonzero(np.diff(to[child], prepend=-1))
    many = np.diff(begin, append=len(child))
    place = np.arange(len(child)) - np.repeat(begin, many)
    last = lambda test: np.maximum.reduceat(np.where(test, place, -1), begin) if len(child) else begin
    other, able = last(~noun[child]), last(has[child])
    tail = phrase[to[child[begin]]] & (many - 1 - other > 1)
    head = np.where(tail, other + 1, np.where(able >= 0, able, many - 1))
    loss = np.zeros(len(to), np.int64)
    loss[child] = -(place != np.repeat(head, many)).astype(np.int64)
    sums = loss.copy()
    for level in _levels(depth, to):
        sums[level] += sums[to[level]]
    columns = [pa.array(leaf), pa.array(loss), pa.array(sums, mask=depth < 0)]
    return _listed(size, pa.StructArray.from_arrays(columns, names=["leaf", "loss", "sum"]))


def sentence_grid(words: DataFrame) -> DataFrame:
    """Adds grid: stress shifted so that a sentence's least is 1, and grid_i from 1."""
    w = Window.partitionBy("text_id", "sent_num")
    shifted = (F.col("total") - F.min("total").over(w) + 1).alias("grid")
    return words.select("*", shifted, F.row_number().over(w.orderBy("word_num")).alias("grid_i"))


def normalized(words: DataFrame, value: str) -> DataFrame:
    """Adds norm_<value>: min-max scaled within the sentence (0 where all are equal), and the relative index."""
    w = Window.partitionBy("text_id", "sent_num")
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
    at = F.row_number().over(w.orderBy("word_num"))
    return words.select("*", F.round(scaled, 6).alias(f"norm_{value}"), F.round(at / F.count("*").over(w), 6).alias("relative_index"))


def pause_split(text: Column) -> Column:
    """Clauses of a text: broken after : ; -- and dashes, then after sentence ends."""
    return F.split(F.regexp_replace(text, r"((?:--|[:;–—]|[.!?]))(\s+)", "$1\u0001"), "\u0001")


def heads(nodes: DataFrame) -> DataFrame:
    """Constituency nodes (text_id, sent_num, node, parent, word_num) -> phrases with head_word, their last word, and n_words."""
    whole = nodes.groupBy("text_id", "sent_num").agg(F.collect_list(F.struct("node", "parent", "word_num")).alias("w"))
    return heads_of(whole)


def heads_of(sentences: DataFrame) -> DataFrame:
    """Sentences (text_id, sent_num, w: their nodes as node, parent, word_num) -> text_id, sent_num, node, head_word, n_words.

    Words are counted upwards, a node once all below it are counted, so the work
    goes by nodes and not by the length of their paths. Parents that are not
    there have no row, nor has what stands on a circle.
    """
    kind = {f.name: f.dataType for f in sentences.schema["w"].dataType.elementType}
    out = ArrayType(StructType([StructField("node", kind["node"]), StructField("head_word", kind["word_num"]), StructField("n_words", LongType())]))
    return sentences.select("text_id", "sent_num", F.inline(F.arrow_udf(_words_below, out)("w")))


def _words_below(sentences: pa.Array) -> pa.Array:
    """The nodes of each sentence that have words below them, with the last of these and their number; a batch of sentences at a time."""
    node, parent, word = sentences.flatten().flatten()
    size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy().astype(np.int64)
    coded = pa.concat_arrays([node, parent]).dictionary_encode()
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy() + 1
    kinds = len(coded.dictionary) + 1
    first = np.repeat(np.arange(len(size)), size) * kinds
    known, own = np.unique(first + codes[: len(node)], return_inverse=True)
    up = first + codes[len(node) :]
    to = np.minimum(np.searchsorted(known, up), len(known) - 1)
    to = np.where((codes[len(node) :] > 0) & (known[to] == up), to, -1) if len(known) else up
    order = np.argsort(own, kind="stable")
    rows = np.bincount(own, minlength=len(known))
    begin = np.cumsum(rows) - rows
    least = np.iinfo(np.int64).min
    has = word.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    value = np.where(has > 0, pc.fill_null(word.cast(pa.int64()), 0).to_numpy(), least)
    many, last = np.zeros(len(known), np.int64), np.full(len(known), least)
    waits = np.bincount(to[to >= 0], minlength=len(known))
    ready = np.flatnonzero(waits == 0)
    done = np.zeros(len(known), bool)
    while len(ready):
        done[ready] = True
        n = rows[ready]
        edges = order[np.repeat(begin[ready] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        edges = edges[to[edges] >= 0]
        above, below = to[edges], own[edges]
        np.add.at(many, above, many[below] + has[edges])
        np.maximum.at(last, above, np.maximum(last[below], value[edges]))
        np.subtract.at(waits, above, 1)
        ready = np.unique(above)
        ready = ready[waits[ready] == 0]
    found = np.flatnonzero(done & (many > 0))
    sentence, code = np.divmod(known[found], kinds)
    ends = np.cumsum(np.bincount(sentence, minlength=len(size)))
    columns = [coded.dictionary.take(pa.array(code - 1)), pa.array(last[found]).cast(word.type), pa.array(many[found])]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays(columns, names=["node", "head_word", "n_words"]))


def arto(total: Column, lexical: Column) -> Column:
    """The alternative scale of prominence: one less the stress, 0 for words without lexical stress."""
    return F.when(lexical == -1, F.lit(0.0)).otherwise(-(total - 1))


def joined_features(deps: DataFrame, constituents: DataFrame) -> DataFrame:
    """Dependency and constituency features of the words that have both."""
    return deps.join(dealt(constituents), ["text_id", "sent_num", "word_num"])


def clause_starts(deps: DataFrame) -> DataFrame:
    """Adds clause (from 1 in each sentence): a new one begins at every word that opens a clause or a conjunct but the first."""
    begins = F.col("dep").isin(CLAUSE_DEPS) & (F.row_number().over(Window.partitionBy("text_id", "sent_num").orderBy("word_num")) > 1)
    w = Window.partitionBy("text_id", "sent_num").orderBy("word_num").rowsBetween(Window.unboundedPreceding, 0)
    return deps.withColumn("begins__", begins.cast("int")).withColumn("clause", (1 + F.sum("begins__").over(w)).cast("int")).drop("begins__")


def statistics(nodes: DataFrame) -> DataFrame:
    """Constituency nodes with n_syll -> a row a word with its stress under three disambiguations, as in `tree_stress`.

    m1 takes ambiguous words (lstress -0.5) as stressed, m2b as unstressed, m2a
    as unstressed if they have one syllable; `mean` is theirs. norm_<m> is scaled
    between the least and greatest of the sentence (null where all are equal or
    a word has no stress). word_index counts from 1 and relative_index is its
    part of the sentence; lexstress is yes, ambig or no; ambig_words and
    ambig_monosyll count the sentence's ambiguous words; contour writes the means
    in order. A null n_syll counts as several syllables.
    """
    keys = ["text_id", "sent_num"]
    how = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for k, m in enumerate(("m1", "m2a", "m2b")))))
    mono = F.coalesce(F.col("n_syll") == 1, F.lit(False))

    def own_stress(x):
        low = (F.col("how.m") == "m2b") | ((F.col("how.m") == "m2a") & x["mono"])
        return F.when(x["lstress"] == -0.5, F.when(low, -1.0).otherwise(0.0)).otherwise(x["lstress"])

    # The disambiguations are trees of their own, made of a sentence once its nodes are together.
    three = written(_sentences(nodes.withColumn("mono", mono), "mono"), "sentences").withColumn("how", how)
    three = three.select(F.struct("text_id", "how.m").alias("text_id"), "sent_num", F.transform("w", lambda x: x.withField("lstress", own_stress(x))).alias("w"))
    found = _stressed(three).select("text_id.*", "sent_num", "word_num", "total")
    pick = lambda m: F.max(F.when(F.col("m") == m, F.col("total"))).alias(m)
    wide = found.groupBy(*keys, "word_num").agg(*map(pick, ("m1", "m2a", "m2b")))
    wide = wide.withColumn("mean", (F.col("m1") + F.col("m2a") + F.col("m2b")) / 3)
    own = nodes.where("word_num is not null").select(*keys, F.col("word_num").cast("int").alias("word_num"), F.col("lstress").alias("lexical"), mono.alias("mono"))
    rows = wide.join(dealt(own), [*keys, "word_num"])
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("word_num")
    ambiguous = F.col("lexical") == -0.5
    scaled = lambda m: ((F.col(m) - F.min(m).over(w)) / F.nullif(F.max(m).over(w) - F.min(m).over(w), F.lit(0.0))).alias(f"norm_{m}")
    means = F.array_sort(F.collect_list(F.struct("word_num", F.format_string("%.2f", F.col("mean")).alias("x"))).over(w))
    return rows.select(
        *keys, "word_num", F.row_number().over(ordered).alias("word_index"), (F.row_number().over(ordered) / F.count("*").over(w)).alias("relative_index"),
        F.when(F.col("lexical") == 0, "yes").when(ambiguous, "ambig").when(F.col("lexical") == -1, "no").alias("lexstress"),
        "m1", "m2a", "m2b", "mean", *map(scaled, ("m1", "m2a", "m2b", "mean")),
        F.sum(ambiguous.cast("int")).over(w).alias("ambig_words"), F.sum((ambiguous & F.col("mono")).cast("int")).over(w).alias("ambig_monosyll"),
        F.array_join(F.transform(means, lambda x: x["x"]), " ").alias("contour"),
    )
