"""Words below phrases are counted once a node: by the paths of all words, deep trees take the square of their words."""

from metrika.operators import trees

SCHEMA = "text_id string, sent_num int, node int, parent int, word_num int"


def plain(nodes):
    """(sentence, node) -> last word and number of words below it, by walking up from every word."""
    up = {(t, s, n): p for t, s, n, p, _ in nodes}
    out = {}
    for t, s, _, p, w in nodes:
        while w is not None and (t, s, p) in up:
            last, many = out.get((t, s, p), (w, 0))
            out[t, s, p] = max(last, w), many + 1
            p = up[t, s, p]
    return out


def test_heads_equal_walks_up(spark):
    nodes = [("a", 1, 1, None, None), ("a", 1, 2, 1, 1), ("a", 1, 3, 1, None), ("a", 1, 4, 3, 2), ("a", 1, 5, 3, None), ("a", 2, 7, 99, None), ("a", 2, 8, 7, 5), ("a", 2, 9, 8, 4), ("b", 1, 1, -1, 1)]
    got = {(r.text_id, r.sent_num, r.node): (r.head_word, r.n_words) for r in trees.heads(spark.createDataFrame(nodes, SCHEMA)).collect()}
    assert got == plain(nodes) and len(got) == 4
    assert trees.heads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_circles_are_left_out(spark):
    nodes = [("a", 1, 1, 2, None), ("a", 1, 2, 1, None), ("a", 1, 3, 1, 1), ("a", 1, 4, None, None), ("a", 1, 5, 4, 2)]
    got = [(r.node, r.head_word, r.n_words) for r in trees.heads(spark.createDataFrame(nodes, SCHEMA)).collect()]
    assert got == [(4, 2, 1)]


def test_a_deep_tree(spark):
    # A chain of 4,000 phrases, each with a word: eight million steps by paths.
    n = 4_000
    nodes = [("a", 1, k, k - 1, None) for k in range(n)] + [("a", 1, n + k, k, k) for k in range(n)]
    found = {r.node: (r.head_word, r.n_words) for r in trees.heads(spark.createDataFrame(nodes, SCHEMA)).collect()}
    assert found == {k: (n - 1, n - k) for k in range(n)}
