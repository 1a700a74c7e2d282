"""Operators 11 to 13 against brute force, and on nulls, empty and long values, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.llm import embedding_dedup, queries, spelling, vector_codes

SF = "/root/testdata/sf0.001"
EMBEDDED = "vec_id long, embedding array<double>, label string, digest string, v int, node int, weight int, block int, n int, rows int, label_ int"


def vectors(spark, rows):
    """Rows (vec_id, embedding[, label]) with columns whose names clash with the operators' own."""
    full = [(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]], r[2] if len(r) > 2 else None, "own", *range(7)) for r in rows]
    return spark.createDataFrame(full, EMBEDDED)


# ---- op11 ----


def cosine(x, y):
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    big = lambda a: [c / max(map(abs, a)) for c in a]
    x, y = big(x), big(y)
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


def brute_links(rows, threshold):
    able = [v is not None and k is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for k, v in rows]
    near = [[j for j in range(len(rows)) if i != j and able[i] and able[j] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min((rows[k][0] for k in seen), default=None) if rows[i][0] is not None else None
    return Counter((rows[i][0], len(near[i]), label[i], rows[i][0] is not None and label[i] == rows[i][0]) for i in range(len(rows)))


def found_links(spark, rows, threshold=0.95):
    return Counter(map(tuple, embedding_dedup.near_duplicates(vectors(spark, rows), threshold).collect()))


def clustered(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return [(int(k) * 3 + 1, (centres[rng.integers(8)] + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.35])).tolist()) for k in rng.permutation(n)]


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST", 64)
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    monkeypatch.setattr(embedding_dedup, "GROUP", 3)
    rows = clustered(0, 150, 6) + [(2 + 3 * k, [1.0 + 1e-9 * k, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(60)]
    assert found_links(spark, rows) == brute_links(rows, 0.95)


def test_embedding_hard_cases(spark):
    exact = [20.0, 0, 0, 0, 0], [19.0, 6, 1, 1, 1]  # 380 / (20 * 20): at the threshold by definition
    rows = [
        (1, exact[0]), (0, exact[1]), (2, None), (3, []), (4, [0.0] * 5), (5, [1.0, None, 2, 3, 4]), (6, [float("nan")] * 5), (7, [float("inf"), 0, 0, 0, 0]),
        (8, [1e200, 0, 0, 0, 0]), (9, [-0.0, 5e-324, 0, 0, 0]), (9, [-3.0, 0, 0, 0, 0]), (None, [20.0, 0, 0, 0, 0]), (10, [20.0, 0, 0, 0, 0]), (10, [20.0, 0, 0, 0, 0]),
        (11, [2.0]), (12, [3.0]), (13, [-3.0]), (14, [1.0] * 3000), (15, [1.0] * 3000), (16, [0.0, 1.0, 0, 0, 0]),
    ]
    assert found_links(spark, rows) == brute_links(rows, 0.95)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(vectors(spark, [(1, None)])).collect()[0][1:] == (0, 1, True)


def side(x, tile=16):
    import pyarrow as pa

    return embedding_dedup.Side(
        pa.table([pa.array(x.tolist()), pa.array([1] * len(x)), pa.array([{"rep": k, "digest": b""} for k in range(len(x))], embedding_dedup.NODE)], names=["v", "weight", "node"]),
        np.linalg.qr(np.random.default_rng(5).normal(size=(x.shape[1],) * 2))[0],
    )


def test_embedding_comparison_stops_early():
    x = np.random.default_rng(1).normal(size=(1_000, 64)) / np.sqrt(1 + np.arange(64))
    a = side(x)
    n, _, label, made = embedding_dedup.compare(a, a, True, 0.95)
    assert made < 0.4 * 1_000 * 1_000 / 2 * 64 and n.sum() == 0 and (label[:1_000] == np.arange(1_000)).all()
    near = side(1 + 0.01 * x)  # all within a ball: no product at all
    n, _, label, made = embedding_dedup.compare(near, near, True, 0.95)
    assert made == 0 and (n == 999).all() and not label[:1_000].any()


def test_roots():
    i, j = np.array([5, 3, 9, 1]), np.array([3, 8, 1, 9])
    assert embedding_dedup.roots(10, i, j).tolist() == [0, 1, 2, 3, 4, 3, 6, 7, 3, 1]
    k = np.arange(5_000)
    assert not embedding_dedup.roots(5_001, k + 1, k).any()


# ---- op12 ----


def brute_words(docs, least_length=6, least=5, every=199):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def brute_near(words):
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for v in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))]:
            for o in holes[v] - {w}:
                # One edit: equal but for one place, or one of them without one letter.
                if len(o) == len(w) and sum(x != y for x, y in zip(o, w, strict=True)) == 1 or abs(len(o) - len(w)) == 1:
                    near[w].add(o)
    return near


def brute_variants(docs, **how):
    words = brute_words(docs, **how)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, form[w], root, len(near[w]), words[form[w]] if form[w] else None))
    return out


def documents(spark, rows):
    clash = "word long, n long, form long, root long, a long, b long, kind long, gram long, size long"
    return spark.createDataFrame([(*r, *range(9)) for r in rows], f"doc_id long, text string, {clash}")


def test_spelling_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_spelling(spark, SF).collect()
    assert {tuple(r) for r in got} == brute_variants(rows) and len(got) > 500 and any(r.form for r in got)


def test_spelling_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 20)
    rng = random.Random(0)
    made = set()
    for _ in range(150):  # few letters: much alike, so that grams grow and cover each other
        word = "".join(rng.choice("aabbcé") for _ in range(rng.randint(6, 12)))
        made.add(word)
        for _ in range(4):
            k = rng.randrange(len(word) + 1)
            made.add(rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcéz") + word[k:], word[:k] + rng.choice("abcéz") + word[k + 1 :]]))
    made = {w for w in made if len(w) >= 6}
    for often in (3, 50, 20_000):
        monkeypatch.setattr(spelling, "FREQUENT", often)
        got = spelling.near_pairs(spark.createDataFrame([(w, 7) for w in made], "word string, n long")).collect()
        near = brute_near(made)
        assert {frozenset((r.a, r.b)) for r in got} == {frozenset((w, o)) for w in made for o in near[w]} and len(got) == sum(map(len, near.values())) // 2


def test_affected_grams_bound_one_edit():
    rng = random.Random(1)
    words = ["".join(rng.choice("aabbc") for _ in range(rng.randint(6, 11))) for _ in range(300)]
    for least in (2, 30, 200):
        count = Counter(w[k : k + n] for w in words for n in (2, 3, 4) for k in range(len(w) - n + 1))
        grams = spelling.Grams({g: n for g, n in count.items() if n >= least})
        useful = 0
        for w in words[:120]:
            cut = grams.cut(w)
            keep = len(cut) - grams.affected(w, cut)
            useful += keep > 0
            for k in range(len(w) + 1):
                for other in [w[:k] + w[k + 1 :], *(w[:k] + c + w[k:] for c in "abcz"), *(w[:k] + c + w[k + 1 :] for c in "abcz")]:
                    if k == len(w) and len(other) < len(w):
                        continue
                    step = (0, 1) if len(other) > len(w) else (-1, 0) if len(other) < len(w) else (0,)
                    theirs = {(other[a:b], a) for a, b in grams.cut(other)}
                    assert sum(any((w[a:b], a + s) in theirs for s in step) for a, b in cut) >= keep
        assert useful > 0


def test_spelling_hard_cases(spark):
    filler = " ".join(["elephant"] * 30 + ["elephan"] * 6 + ["elephent"] * 5 + ["ELEPHÄNT"] * 5 + ["giraffe"] * 4 + ["straße"] * 5 + ["×÷×÷×÷"] * 5)
    long = "x" * 2_000
    rows = [(1, filler), (1, filler), (None, "elephant " * 3), (2, None), (3, ""), (4, " \n"), (5, f"{long} {long} {long} {long} {long} y{long} y{long} y{long} y{long} y{long}"), (6, "日本語日本語日 elephantŁelephant")]
    got = {tuple(r) for r in spelling.variants(documents(spark, rows)).collect()}
    assert got == brute_variants(rows) and ("x" * 2_000) in {r[0] for r in got}
    every = {tuple(r) for r in spelling.variants(documents(spark, rows), every=3).collect()}
    assert every == brute_variants(rows, every=3)
    assert spelling.variants(documents(spark, [])).count() == 0
    # A chain of forms: each five times as frequent as the one before.
    chain = ["planeta", "planetab", "planetabc", "planetabcd"]
    rows = [(9, " ".join(" ".join([w] * (5 * 6**k)) for k, w in enumerate(chain)))]
    found = {r.word: r for r in spelling.variants(documents(spark, rows), every=1 << 40).collect()}
    assert [found[w].root for w in chain] == [chain[-1]] * 4 and [found[w].form for w in chain] == [*chain[1:], None]


# ---- op13 ----


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Every row's code and error, and the digest of the codebooks, in Python's integers."""
    able = [r for r in rows if r[1] is not None and len(r[1]) > 0 and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    able.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    able = [r for r in able if len(r[1]) == len(able[0][1])]
    size = len(able[0][1]) // parts
    whole = [[math.floor(Fraction(x) * 256) for x in r[1]] for r in able]
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda c, p: min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e))
    for _ in range(rounds):
        held = defaultdict(list)
        for c in cut:
            for p in range(parts):
                held[p, near(c, p)].append(c[p])
        for (p, e), own in held.items():
            books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = [[near(c, p) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][e]) for p, e in enumerate(code)) for c, code in zip(cut, codes, strict=True)]
    by = Counter()
    for r, e in zip(able, errors, strict=True):
        by[r[2] if len(r) > 2 else None] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    return Counter((r[0], "".join(f"{e:02x}" for e in code), fit(err), fit(by[r[2] if len(r) > 2 else None]), sha) for r, code, err in zip(able, codes, errors, strict=True))


def found_codes(spark, rows):
    return Counter(map(tuple, vector_codes.compressed(vectors(spark, rows)).collect()))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), (rng.normal(size=32) / 6).tolist(), None if k % 7 == 0 else f"l{k % 3}") for k in rng.permutation(200)]
    rows += [(300 + k, [0.25 * (k % 2)] * 32, "l1") for k in range(40)]
    assert found_codes(spark, rows) == brute_codes(rows)


def test_codes_hard_cases(spark):
    rows = [
        (5, [0.1 * k for k in range(16)], "a"), (5, [0.2 * k for k in range(16)], "b"), (6, None), (7, []), (8, [1.0] * 15), (9, [None] * 16), (10, [float("nan")] * 16),
        (11, [float("-inf")] * 16), (12, [1.0] * 32), (13, [3e38] * 16, "big"), (14, [-1e300] * 16, "a"), (None, [-0.001] * 16, None), (2, [1.0] * 17),
        (15, [2.0**52 + 0.5, 2.0**40 + 1 / 512, *[0.0] * 14], "b"),
    ]
    assert found_codes(spark, rows) == brute_codes(rows)
    assert vector_codes.compressed(vectors(spark, [])).count() == 0
    assert vector_codes.compressed(vectors(spark, [(1, None)]).drop("label")).count() == 0
    plain = vector_codes.compressed(vectors(spark, rows[:1]).select("vec_id", "embedding")).collect()
    assert plain[0].code == "00" * 16 and plain[0].error == plain[0].label_error == 0


def test_equal_average_search_is_exact_and_stops():
    rng = np.random.default_rng(3)
    parts, book = rng.integers(-60, 60, (3_000, 4)), rng.integers(-60, 60, (64, 4))
    book[10] = book[3]
    far = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    entry, best, seen = vector_codes.nearest(parts, book)
    assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and seen < 0.6 * far.size
    assert (vector_codes.nearest(parts.astype(object), book.astype(object))[0] == entry).all()


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op13_vector_codes"])
def test_whole_table(spark, name):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    if "op13" in name:
        assert got == brute_codes(rows)
    else:  # no two vectors of this table are near
        x = np.array([r[1] for r in rows], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert ((x @ x.T >= 0.95).sum(axis=1) == 1).all() and got == Counter((r[0], 0, r[0], True) for r in rows)
