"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import ball_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, items, k):
    vectors = [(i, v) for i, v in ((i, terms(t)) for i, t in docs) if v]
    n_docs, total = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        found = []
        for i, v in vectors:
            m = 100 - 75 + 75 * sum(v.values()) * n_docs // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 8 * m)) for t, q in terms(text).items() if t in v)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(ball_search, "BLOCK_DOCS", 40)
    if seed == 1:
        monkeypatch.setattr(ball_search, "QUERY_BYTES", 100)  # many blocks of queries
    if seed == 2:
        monkeypatch.setattr(ball_search, "N_GROUPS", 3)
    if seed == 3:
        monkeypatch.setattr(ball_search, "CENTROID_BYTES", 2000)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünter", "ß", "数", "A9"]
    text = lambda n: rng.choice([" ", "-", "\x7f"]).join(rng.choice(words[: rng.randrange(1, 65)]) for _ in range(rng.randrange(n)))
    docs = [(k, text(40)) for k in range(250)] + [(250, None), (251, ""), (252, "-- \x00"), (None, "w1 w2 w1"), (None, "w1 w2 w1")]
    docs += [(k, docs[3][1]) for k in range(300, 340)] + [docs[5], docs[5]] + [(400, "w1 " * 5000)]
    items = [(k, text(12)) for k in range(25)] + [(25, None), (26, ""), (27, "unheard of"), (28, docs[3][1]), (29, "w1 w1 w2"), (29, "w1 w1 w2"), (None, "w3")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit(0)).withColumn("item_id", F.lit("x")).withColumn("rank", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = ball_search.ranked_search(table, asked, 10, leaf_docs=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 10)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_search.ranked_search(none, items).collect() == []
    assert ball_search.ranked_search(one, items.limit(0)).collect() == []
    assert [tuple(r) for r in ball_search.ranked_search(one, items).collect()] == plain([(1, "a b")], [(1, "a")], 10)


def test_bounds_hold_at_every_node():
    """No document below a node scores more than the node's bound, and copies make it tight enough to prune by id."""
    rng = np.random.default_rng(0)
    width, docs = 80, 300
    group = np.arange(width) // 4
    sizes = rng.integers(1, 20, docs)
    own = [np.sort(rng.choice(width, k, replace=False)) for k in sizes]
    values = [rng.integers(1, 10**6, k) for k in sizes]
    own[100:200], values[100:200] = [own[0]] * 100, [values[0]] * 100
    ends = np.append(0, np.cumsum([len(x) for x in own]))
    tree = ball_search.BallTree(np.arange(docs), ends, np.concatenate(own), np.concatenate(values), np.ones(width), group, 4)
    for _ in range(50):
        t = np.sort(rng.choice(width, 9, replace=False))
        query, dense = ball_search.Query(t, w := rng.integers(1, 30_000, 9), group), np.zeros(width, np.int64)
        dense[t] = w
        scores = np.add.reduceat(dense[tree.terms] * tree.values, tree.ends[:-1])
        for node, (a, b) in enumerate(tree.spans):
            assert tree.bound(node, query) >= scores[a:b].max()
        top = ball_search.Top(10)
        seen = tree.search(query, dense, top)
        want = sorted(zip((-scores).tolist(), tree.ids.tolist(), strict=True))[:10]
        assert sorted((-s, -i) for s, i in top.heap) == [(s, i) for s, i in want if s < 0] and seen <= docs
