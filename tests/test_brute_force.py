"""Operators that SQL can't say, against plain Python on small random tables."""

import random
import time
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as x
from gradeloom.operators import monitoring as m
from gradeloom.operators import preparation as p
from gradeloom.operators import scores as s
from gradeloom.operators import tokens as t
from gradeloom.operators.order import range_bucket


def test_collapse_rate(spark):
    rng = random.Random(1)
    rows = [(s, q, k, [rng.choice("abcdef") for _ in range(rng.randint(0, 4))]) for s in range(2) for q in "uv" for k in range(9)]
    got = {(r["step"], r["q"]): (r["n"], r["collapse"]) for r in m.collapse_rate(spark.createDataFrame(rows, "step long, q string, rollout long, words array<string>")).collect()}
    for s, q in product(range(2), "uv"):
        clusters = []
        for _, _, _, words in sorted((r for r in rows if r[:2] == (s, q)), key=lambda r: r[2]):
            own = set(words)
            home = next((c for c in clusters if c[0] | own and len(c[0] & own) / len(c[0] | own) >= 0.4), None)
            if home:
                home[1] += 1
            else:
                clusters.append([own, 1])
        assert got[s, q] == (9, pytest.approx(max(c[1] for c in clusters) / 9))


@pytest.mark.parametrize("threshold", [0.05, 0.25, 0.4, 0.5, 2 / 3, 0.75, 1.0])
def test_leaders_are_found_through_the_index(threshold):
    rng = random.Random(7)
    for _ in range(200):
        sets = [{rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))} for _ in range(30)]
        firsts, sizes = [], []
        for own in sets:
            home = next((k for k, other in enumerate(firsts) if own | other and len(own & other) / len(own | other) >= threshold), None)
            if home is None:
                firsts.append(own)
                sizes.append(1)
            else:
                sizes[home] += 1
        assert m.leader_sizes(sets, threshold) == sizes
    if threshold != 0.4:
        return
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(50_000)]
    began = time.monotonic()
    assert sum(m.leader_sizes([set(rng.sample(words, 20)) for _ in range(20_000)], threshold)) == 20_000
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("n", range(1, 7))
def test_majority_of_n_is_the_mean_over_all_draws(spark, n):
    prompts = {"p": [1, 2, 2, 5], "q": [7], "r": [3, 3, 1], "s": [1, 2, 3, 4, 5], "t": [2, 1, 1, 2, 4]}
    rows = [("s", name, v, float(v * 10 + k), k) for name, votes in prompts.items() for k, v in enumerate(votes)]
    got = {r["prompt"]: r["maj"] for r in m.majority_of_n(spark.createDataFrame(rows, "source string, prompt string, vote long, value double, ord long"), n).collect()}
    for name, votes in prompts.items():
        first, total = {v: v * 10.0 + votes.index(v) for v in votes}, 0.0
        for pick in product(votes, repeat=n):
            counts = Counter(pick)
            total += first[next(v for v in pick if counts[v] == max(counts.values()))]
        assert got[name] == pytest.approx(total / len(votes) ** n)


def grams(t):
    t = t.strip().lower()
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def test_dedup_criteria(spark):
    rng = random.Random(2)
    words = ["names the cause", "names the causes", "gives a dose", "gives no dose", "is kind"]
    texts = ["\n".join(rng.choice(["- [+2] ", "- [-1] ", "", "head "]) + rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(x.dedup_criteria("t")).collect()]
    for text, have in zip(texts, got, strict=True):
        kept, out = [], []
        for line in text.split("\n"):
            g = grams(line)
            if line.startswith("- ["):
                if any((a := sum((g & k).values())) / max(sum((g | k).values()), 1) >= 0.55 and a for k in kept):
                    continue
                kept.append(g)
            out.append(line)
        assert have == "\n".join(out)


@pytest.mark.parametrize("equal", [False, True])
def test_balanced_batches(spark, equal):
    rng = random.Random(3)
    rows = [(k, k // 24, rng.randint(1, 4000)) for k in range(96)]
    out = p.balanced_batches(spark.createDataFrame(rows, "id long, batch long, n long"), "batch", 4, "n", "id", equal).collect()
    assert sorted(r["id"] for r in out) == list(range(96))
    load = lambda n: 24576.0 * n + n * n
    for b in range(4):
        parts, largest = defaultdict(list), max(load(n) for _, c, n in rows if c == b)
        for r in out:
            if r["batch"] == b:
                parts[r["part"]].append(load(r["n"]))
        sums = [sum(v) for v in parts.values()]
        assert len(parts) == 4 and max(sums) - min(sums) <= largest
        assert not equal or {len(v) for v in parts.values()} == {6}


def test_balanced_partitions_over_many_cells(spark, monkeypatch):
    """No worse than dealing forth and back, near to one heap of all rows, and the same rows for any order of arrival."""
    monkeypatch.setattr(p, "MERGED_CELLS", 3)
    rng = random.Random(8)
    load = lambda n: 24576.0 * n + n * n
    rows = [(k, None if k == 5 else int(rng.paretovariate(1.2) * 100), [k]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, n long, other array<long>")
    sums = lambda parts: [sum(load(rows[i][1] or 0) for i, q in parts.items() if q == k) for k in range(7)]
    spread = lambda parts: max(sums(parts)) - min(sums(parts))
    snake = {r["id"]: r["part"] for r in p.snake_partitions(df.fillna(0, ["n"]), 7, "n", "id").collect()}
    heap = dict(enumerate(p.largest_differencing([load(r[1] or 0) for r in rows], 7)))
    for cell_rows in (100, 5000):
        got = {r["id"]: r["part"] for r in p.balanced_partitions(df, 7, "n", "id", cell_rows).collect()}
        assert got.keys() == snake.keys() and set(got.values()) == set(range(7))
        assert spread(got) <= spread(snake) and spread(got) <= spread(heap) + 0.005 * sum(sums(got))
        again = p.balanced_partitions(df.repartition(5).orderBy(F.desc("id")), 7, "n", "id", cell_rows)
        assert {r["id"]: r["part"] for r in again.collect()} == got and all(r["other"] == [r["id"]] for r in again.collect())
    assert p.balanced_partitions(df.limit(0), 7, "n", "id").count() == 0
    assert {r["part"] for r in p.balanced_partitions(df.limit(3), 7, "n", "id").collect()} <= set(range(7))


def test_token_budget_partitions(spark, monkeypatch):
    monkeypatch.setattr(p, "CELL_BATCHES", 4)
    rng = random.Random(9)
    rows = [(k, rng.randint(1, 300)) for k in range(2000)]
    out = p.token_budget_partitions(spark.createDataFrame(rows, "id long, n long"), 5000, "n", "id").collect()
    assert sorted((r["id"], r["n"]) for r in out) == rows
    cells = defaultdict(Counter)
    for r in out:
        cells[r["cell"]][r["part"]] += r["n"]
    assert len(cells) > 5
    for parts in cells.values():
        assert set(parts) == set(range(-(-sum(parts.values()) // 5000))) and max(parts.values()) <= 5000 + 300


def test_plans_have_no_window_over_all_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 97).alias("n"), F.rand(1).alias("score"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(p.balanced_partitions(df, 8, "n", "id"))
    buckets = df.select(range_bucket(df, [-F.col("n"), F.col("id")]).alias("b"), "n", "id").collect()
    ordered = sorted(buckets, key=lambda r: (-r["n"], r["id"]))
    assert [r["b"] for r in ordered] == sorted(r["b"] for r in buckets) and max(Counter(r["b"] for r in buckets).values()) < 100


def test_resample_is_inversion_of_one_long_list(spark):
    from hashlib import md5

    rng = random.Random(10)
    rows = [(k * 37 - 4000, rng.choice([None, 0.0, rng.gauss(0, 3), 50.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "ord long, score double").repartition(3)
    for fanout in (40, 100_000):
        got = {r["draw"]: r["ord"] for r in p.resample(df, 700, "score", seed=3, fanout=fanout).collect()}
        units = [max(round((abs(x or 0.0) ** 2) / 2500.0 * 2**30), 1) for _, x in rows]
        for draw in range(700):
            left = int(md5(f"3:{draw}".encode()).hexdigest()[:12], 16) * sum(units) // 16**12
            for (key, _), w in zip(rows, units, strict=True):
                if left < w:
                    break
                left -= w
            assert got[draw] == key
    assert p.resample(df.limit(0), 5, "score").count() == 0


def test_recurrences_along_long_samples(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(s, k, int(rng.random() < 0.8), rng.gauss(0, 1), rng.gauss(0, 1)) for s, n in ((1, 300), (2, 1), (3, 64)) for k in range(n)]
    df = spark.createDataFrame(rows, "sample_id int, pos int, mask int, reward double, value double")
    for block, chunk in ((1 << 16, 64), (16, 64), (50, 7)):
        monkeypatch.setattr(t, "BLOCK", block)
        monkeypatch.setattr(t, "CHUNK", chunk)
        returns = {(r["sample_id"], r["pos"]): r["returns"] for r in t.discounted_returns(df, 0.95).collect()}
        estimates = {(r["sample_id"], r["pos"]): (r["gae"], r["returns"]) for r in t.gae(df, 0.97, 0.9).collect()}
        assert len(returns) == len(estimates) == len(rows)
        running, was = 0.0, None
        for s, k, mask, reward, value in sorted(rows, key=lambda r: (r[0], -r[1])):
            if s != was:
                running = next_value = last = 0.0
                was = s
            here = reward + 0.95 * running
            running = here * mask
            last, next_value = (reward + 0.97 * next_value - value + 0.97 * 0.9 * last, value) if mask else (last, next_value)
            assert returns[s, k] == pytest.approx(here) and estimates[s, k] == (pytest.approx(last), pytest.approx(last + value))
    long = spark.range(200_000).select(F.lit(1).alias("sample_id"), F.col("id").alias("pos"), F.lit(1).alias("mask"), F.lit(1.0).alias("reward"), F.lit(0.5).alias("value"))
    began = time.monotonic()
    monkeypatch.setattr(t, "BLOCK", 1 << 16)
    monkeypatch.setattr(t, "CHUNK", 64)
    assert t.gae(long, 0.99, 0.95).agg(F.max("returns")).first()[0] > 1
    assert t.discounted_returns(long, 0.5).agg(F.max("returns")).first()[0] == pytest.approx(2)
    assert time.monotonic() - began < 60


def test_token_budget_batches(spark):
    rng = random.Random(4)
    rows = [(k, k // 30, rng.randint(1, 900)) for k in range(90)]
    out = p.token_budget_batches(spark.createDataFrame(rows, "id long, batch long, n long"), "batch", 2000, "n", "id").collect()
    for b in range(3):
        total = sum(n for _, c, n in rows if c == b)
        assert {r["part"] for r in out if r["batch"] == b} == set(range(-(-total // 2000)))
    assert sorted(r["id"] for r in out) == list(range(90))


def test_smooth_factor_over_many_blocks(spark):
    rng = random.Random(6)
    values = [rng.random() for _ in range(1500)]
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate(values)], "run string, step long, v double")
    for keep in (0.9, 0.5, 0.99):
        got = {r["step"]: (r["ema"], r["factor"]) for r in m.smooth_factor(df, "v", "step", "run", keep).collect()}
        ema, factor = 1.0, 0.1
        for k, v in enumerate(values):
            ema = keep * ema + (1 - keep) * v
            factor = max(factor, 0.1 + 0.9 * ema)
            assert got[k] == (pytest.approx(ema, rel=1e-9), pytest.approx(factor, rel=1e-9))


def test_parse_rubric_with_many_lines(spark):
    text = "\n".join(f"- [+{k}] criterion {k}\n more of {k}  " for k in range(1, 3000))
    got = spark.createDataFrame([(text,)], "t string").select(F.size(x.parse_rubric("t")), x.parse_rubric("t")[2998]["text"]).first()
    assert tuple(got) == (2999, "criterion 2999\nmore of 2999")


def test_reward_parts_are_those_of_the_single_functions(spark):
    rng = random.Random(5)
    cells = [("q", j, k, i, i < 0, None if rng.random() < 0.1 else float(rng.choice([0, 3, 5, 6, 10]))) for j in range(8) for k in range(rng.randint(1, 5)) for i in range(-1, rng.randint(0, 5))]
    cells += [("flat", 0, k, i, False, 4.0) for k in range(3) for i in range(3)] + [("empty", 0, 0, 0, False, None)]
    scores = spark.createDataFrame(cells, "q string, rollout int, crit int, answer int, is_gold boolean, score double")
    stats = s.criterion_stats(scores)
    wanted = scores.select("q", "rollout").distinct()
    for part in (s.consensus(scores, stats), s.discrimination(stats), s.gold_discrimination(stats), s.calibration(scores)):
        wanted = wanted.join(part, ["q", "rollout"], "left")
    names = ("consensus", "disc", "gold_disc", "calibration")
    got, want = ({(r["q"], r["rollout"]): [r[c] for c in names] for r in df.collect()} for df in (s.reward_parts(scores), wanted))
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == [v if v is None else pytest.approx(v) for v in values]
