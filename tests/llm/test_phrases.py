"""Phrase mining against plain Python, and quotient filters as exact counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import phrases
from gradeloom.llm.quotient_filter import CountingQuotientFilter, Grams, collapse

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_words, min_count, cover, top):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= cover * a for q, b in cands.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "max_words", "min_count", "cover", "top"), [(0, 5, 5, 100, 2000), (1, 4, 2, 60, 7), (2, 5, 30, 100, 3), (3, 2, 1, 100, 10)])
def test_phrases_against_plain_python(spark, monkeypatch, seed, max_words, min_count, cover, top):
    # small shards, blocks and holds, so that filters are flushed, merged and probed in many shards
    for name, value in {"OCCURRENCES_PER_SHARD": 64, "WORDS_PER_SHARD": 7, "PHRASES_PER_SHARD": 16, "BLOCK_IDS": 50, "HELD_KEYS": 40}.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "É", "x-y", "\x00", " ", "long" * 50]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randrange(25))]
        rows.append((" ".join(words), rng.choice(["en", "en", "fr", None, ""])))
    rows += [(None, "en"), ("", None), ("a a a a a a", "fr"), ("a b c a b c " * 40, "en"), ("once upon", "de"), rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("n", F.lit(1)).withColumn("word", F.lit("w")).withColumn("ids", F.lit("x"))
    got = phrases.mine_phrases(docs, max_words, min_count, cover, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, max_words, min_count, cover, top)


def test_nothing_frequent_and_nothing_at_all(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        assert phrases.mine_phrases(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    """The score's expression on counts of a corpus of 10^13 words."""
    rows = [(10**9, 5 * 10**13, 10**9, 10**9 + 7), (10**13, 5 * 10**13, 3 * 10**13, 10**13)]
    df = spark.createDataFrame(rows, "a long, all long, l long, r long")
    exact = "(cast(1000 as decimal(4,0)) * (cast(a as decimal(19,0)) * cast(all as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert [r[0] for r in df.select(F.expr(exact)).collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 14), (3, 21), (4, 16), (5, 13), (5, 26), (2, 33), (5, 40), (2, 64)])
def test_filters_are_lossless(n, bits):
    rng, grams = np.random.default_rng(n * bits), Grams(n, bits)
    ids = [rng.integers(0, min(2**bits, 50), 5000).astype(np.uint64) << np.uint64(max(bits - 6, 0) if bits > 6 else 0) for _ in range(n)]
    limbs = grams.pack(ids)
    assert all((a == b).all() for a, b in zip(ids, grams.unpack(limbs), strict=True))
    want = Counter(zip(*(x.tolist() for x in ids), strict=True))
    shard_bits = min(3, grams.widths[0])
    kept = Counter()
    # filters of two halves of the grams, written, read and merged shard by shard
    for shard in range(1 << shard_bits):
        parts = []
        for half in (slice(0, 2500), slice(2500, None)):
            mine = grams.shard([x[half] for x in limbs], shard_bits) == shard
            keys, counts = collapse([x[half][mine] for x in limbs])
            if len(counts):
                counts = counts * 300  # more than a byte
                parts.append(CountingQuotientFilter.parse(CountingQuotientFilter.build(grams, keys, counts, shard_bits).dump()).keys())
        if parts:
            keys, counts = collapse([np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))
            merged = CountingQuotientFilter.build(grams, keys, counts, shard_bits)
            assert merged.has(keys).all()
            absent = [keys[0] ^ np.uint64(1), *keys[1:]]
            absent = [x[grams.shard(absent, shard_bits) == shard] for x in absent]
            held = set(zip(*(x.tolist() for x in keys), strict=True))
            assert merged.has(absent).tolist() == [k in held for k in zip(*(x.tolist() for x in absent), strict=True)]
            kept.update(dict(zip(zip(*(x.tolist() for x in grams.unpack(keys)), strict=True), (counts // 300).tolist(), strict=True)))
    assert kept == want
