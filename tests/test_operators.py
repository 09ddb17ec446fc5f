import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import sequences as q
from gradeloom.operators import completion, plugins
from gradeloom.operators import preparation as p
from gradeloom.operators import scores as s
from gradeloom.operators import tokens as t
from gradeloom.sources import io
from gradeloom.streaming import runs


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(23).withColumnRenamed("id", "ord")


def test_upsample_sizes(spark, rows):
    for n in (0, 5, 23, 60):
        out = p.upsample(rows, n, "ord")
        assert out.count() == n
    counts = [r["count"] for r in p.upsample(rows, 60, "ord").groupBy("ord").count().collect()]
    assert min(counts) == 2 and max(counts) == 3 and p.upsample(rows.limit(0), 5, "ord").count() == 0


def test_sparse_subset_keeps_gold(spark):
    df = spark.createDataFrame([(g, i, i == 0) for g in range(3) for i in range(6)], "g int, item int, gold boolean")
    out = p.sparse_subset(df, 2, ["g"], "item", F.col("gold"))
    assert [r["count"] for r in out.groupBy("g").count().collect()] == [3, 3, 3] and out.filter("gold").count() == 3
    assert p.sparse_subset(df, 0, ["g"], "item").count() == 18


def test_chunk_pad_and_repeat(rows):
    sizes = sorted(r["count"] for r in p.chunk(rows, 4).groupBy("chunk").count().collect())
    assert sizes == [5, 6, 6, 6]
    padded = p.pad_to_multiple(rows, 8)
    assert padded.count() == 24 and padded.filter("is_pad").count() == 1
    assert [r["ord"] for r in p.repeat_rows(rows, 2).orderBy("new_ord").limit(4).collect()] == [0, 0, 1, 1]
    assert [r["ord"] for r in p.repeat_rows(rows, 2, False).orderBy("new_ord").limit(3).collect()] == [0, 1, 2]


def test_resample_weights(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "ord long, score double")
    drawn = lambda method: [r["ord"] for r in p.resample(df, 3000, "score", method).collect()]
    ends = drawn("max_min")
    assert len(ends) == 3000 and set(ends) == {0, 9} and abs(ends.count(0) - 1500) < 200
    top = drawn("max_random")
    assert len(top) == 3000 and abs(top.count(9) - 3000 * 0.4 / 1.3) < 150 and set(top) == set(range(10))


def test_resample_draws_all(rows):
    out = p.resample(rows.withColumn("score", F.col("ord").cast("double")), 200, "score")
    assert out.count() == 200 and out.filter("ord = 0").count() == 0


def test_differencing_beats_nothing_and_keeps_sizes():
    random.seed(3)
    loads = [random.randint(1, 1000) for _ in range(64)]
    parts = p.largest_differencing(loads, 8, equal_size=True)
    assert [parts.count(k) for k in range(8)] == [8] * 8
    sums = [sum(x for x, k in zip(loads, p.largest_differencing(loads, 8), strict=True) if k == i) for i in range(8)]
    assert max(sums) - min(sums) < 50


def test_disjoint_splits(spark, rows):
    with pytest.raises(ValueError, match="both splits"):
        p.check_disjoint(rows, rows, "ord")
    split = p.split_held_out(rows, "ord", 0.3)
    p.check_disjoint(split.filter("held_out"), split.filter("not held_out"), "ord")


def test_union_columns_fails_on_difference(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    with pytest.raises(Exception, match="differs"):
        p.union_columns(a, a.withColumn("v", F.lit("y")), "id").collect()


def test_gae_against_plain_python(spark):
    random.seed(1)
    data = [(1, k, random.randint(0, 1), random.random(), random.random()) for k in range(1, 12)]
    got = {r["pos"]: (r["gae"], r["returns"]) for r in t.gae(spark.createDataFrame(data, "sample_id int, pos int, mask int, reward double, value double"), 0.9, 0.8).collect()}
    nv = last = 0.0
    for _, pos, mask, reward, value in reversed(data):
        here = reward + 0.9 * nv - value + 0.72 * last
        nv, last = (value, here) if mask else (nv, last)
        assert got[pos] == pytest.approx((last, last + value))


def test_token_edges(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0)], "sample_id int, pos int, mask int, x double")
    assert t.masked_stats(df, "x").first()["mean"] == 0.0
    with pytest.raises(ValueError):
        t.aggregate_loss(df, "x", "none")


def test_clusters_and_rewards(spark):
    cells = [("q", j, k, i, False, float(v)) for j in range(2) for k, vs in enumerate(([1, 5, 9], [2, 6, 10], [9, 1, 5])) for i, v in enumerate(vs)]
    m = spark.createDataFrame(cells, "q string, rollout int, crit int, answer int, is_gold boolean, score double")
    reps = {(r["rollout"], r["crit"]): r["rep"] for r in s.criterion_clusters(m).collect()}
    assert reps[0, 1] == 0 and reps[0, 2] == 2
    rollouts = spark.createDataFrame([("q", 0, 0.5, False), ("q", 1, 0.5, True), ("alone", 0, -2.0, True)], "q string, rollout int, qa double, parrot_flag boolean")
    out = {(r["q"], r["rollout"]): r["reward"] for r in s.rewards(m, rollouts).collect()}
    assert out["alone", 0] == -2.0 and out["q", 0] - out["q", 1] == pytest.approx(1.0)


def test_matrix_completion():
    rng = np.random.default_rng(4)
    full = np.clip(5 + rng.normal(0, 1.2, (10, 2)) @ rng.normal(0, 1, (2, 10)), 0, 10)
    mask = rng.random((10, 10)) < 0.75
    out = completion.complete_matrix(np.where(mask, full, 0.0), mask)
    assert np.allclose(out[mask], full[mask]) and out.min() >= 0 and out.max() <= 10
    assert np.sqrt(np.mean((out - full)[~mask] ** 2)) < 2.0
    assert np.allclose(completion.complete_matrix(full, np.ones_like(mask)), full)


def test_sequences(spark):
    df = spark.createDataFrame([("a b c", "d e")], "p string, r string")
    row = q.prompt_response(df, "p", "r", 8).first()
    assert row["tokens"] == ["a", "b", "c", "d", "e", "</s>", "", ""] and row["loss_mask"] == [0, 0, 0, 1, 1, 1, 0, 0]
    assert q.prompt_response(df, "p", "r", 4, truncate="middle").first()["tokens"] == ["a", "b", "e", "</s>"]
    assert q.prompt_response(df, "p", "r", 4, truncate="left").first()["tokens"] == ["c", "d", "e", "</s>"]


def test_readers_accept_both_names(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": " q1 ", "rubric": [{"criterion": "c"}]}\n\n{"question": "q2", "rubrics": [{"criterion": "d", "points": -2}]}\n{"question": "", "rubric": []}\n')
    got = {r["question"]: [(c["criterion"], c["points"]) for c in r["rubric"]] for r in io.read_synthetic(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"q1": [("c", 1)], "q2": [("d", -2)]}
    (tmp_path / "step_40.json").write_text('{"question": "q", "n_rollouts": 2}\n')
    assert [r["step"] for r in io.read_steps(spark, str(tmp_path / "step_*.json"), "question string, n_rollouts int").collect()] == [40]
    (tmp_path / "run.log").write_text("one\n\nstep:3 - x\n")
    assert [r["line_no"] for r in io.read_log(spark, str(tmp_path / "run.log")).collect()] == [0, 2]
    (tmp_path / "cache.json").write_text('{"p1": "text", "p2": ""}')
    assert {r["id"] for r in io.read_cache_document(spark, str(tmp_path / "cache.json")).collect()} == {"p1", "p2"}


def test_rubric_table_layouts(spark):
    a = spark.createDataFrame([([("question", "user")], [("c", 99)], "hub")], "prompt array<struct<content:string,role:string>>, Rubrics array<struct<criterion:string,points:int>>, data_source string")
    b = spark.createDataFrame([("ask", [(None, "d", 0.25, None)], "ft")], "query string, rubrics array<struct<criterion:string,criteria:string,weight:double,points:double>>, source string")
    got = {r["source"]: (r["question"], [tuple(c) for c in r["rubric"]]) for r in io.rubric_tables(a, b).collect()}
    assert got == {"hub": ("question", [("c", 10)]), "ft": ("ask", [("d", 2)])}


def test_load_or_compute_runs_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert io.load_or_compute(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1


def test_response_cache(spark, tmp_path):
    """The last write or delete of a key holds, before and after compaction and when one was cut short."""
    cache, held, rng = io.ResponseCache(spark, f"{tmp_path}/c"), {}, random.Random(12)
    rows = lambda pairs: spark.createDataFrame(pairs, "cache_key string, response string")
    assert cache.table().count() == 0
    cache.compact()
    for k in range(6):
        new = [(f"k{rng.randrange(12)}", f"r{k}-{i}") for i in range(6)]
        cache.put(rows([*new, (None, "lost")]))
        for key, response in sorted(new):
            held[key] = response
        gone = [f"k{rng.randrange(12)}" for _ in range(2)]
        cache.delete(rows([(key, "") for key in gone]))
        for key in gone:
            held.pop(key, None)
        if k in (2, 4):
            cache.compact()
        if k == 3:  # a state that was never named
            rows([("k0", "half")]).withColumn("seq", F.lit(9**18)).write.parquet(f"{tmp_path}/c/state-{9**18}")
        assert {r["cache_key"]: r["response"] for r in cache.table().collect()} == held
    assert {r["cache_key"] for r in cache.look_up(rows([("k1", "x"), ("k99", "y")]).select("cache_key")).collect()} == {"k1"} & held.keys()


def test_metric_lists(spark):
    df = spark.createDataFrame([(2, {"a": 2.0}), (1, {"a": 1.0})], "batch int, metrics map<string,double>")
    assert p.metric_lists(df, "batch", "metrics").first()["list"] == [1.0, 2.0]
    with pytest.raises(Exception, match="not every batch"):
        p.metric_lists(df.union(spark.createDataFrame([(3, {"b": 1.0})], df.schema)), "batch", "metrics").collect()


def test_scorers(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    bad = plugins.safe_scorer(lambda row: 1.0 if row["t"] == "a" else 1 / 0)
    assert {r["t"]: r["score"] for r in plugins.apply_scorer(df, bad, "t string, score double").collect()} == {"a": 1.0, "b": 0.0}
    cache = spark.createDataFrame([], "cache_key string, response string")
    first, new = plugins.cached_scores(df, cache, plugins.hash_scorer("t"), "t", path=f"{tmp_path}/a")
    again, none = plugins.cached_scores(df, new, plugins.hash_scorer("t"), "t", path=f"{tmp_path}/b")
    assert sorted(map(tuple, first.select("t", "response").collect())) == sorted(map(tuple, again.select("t", "response").collect())) and none.count() == 0
    out = plugins.generate_with_retry(df, lambda d, k: d.withColumn("output", F.when((F.col("t") == "a") | (F.lit(k) > 0), F.concat("t", F.lit(str(k)))).otherwise("")), f"{tmp_path}/c", 3)
    assert sorted(r["output"] for r in out.collect()) == ["a0", "b1"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    scorer = lambda b: b.withColumn("score", F.length("t"))
    for name, text in (("step_1.json", "aa"), ("step_2.json", "bbb")):
        (src / name).write_text(f'{{"k": "{text}", "t": "{text}"}}\n{{"k": "aa", "t": "aa"}}\n')
        runs.score_as_it_comes(runs.stream_files(spark, str(src), "k string, t string"), scorer, out, "k", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["k"], r["score"], r["step"]) for r in spark.read.parquet(out).collect()) == [("aa", 2, 1), ("bbb", 3, 2)]


def test_models_are_asked_once(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(8)], "k long")
    calls = spark.sparkContext.accumulator(0)

    def ask(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(output=["" if k % 2 else "done" for k in pdf["k"]])

    out = plugins.generate_with_retry(df, lambda rows, _: rows.mapInPandas(ask, "k long, output string"), f"{tmp_path}/rounds", 3)
    for _ in range(2):
        assert out.count() == 8
    assert calls.value == 8 + 4 + 4
    calls.value = 0
    judge = lambda batches: (calls.add(len(p)) or p.assign(response="x") for p in batches)
    rows, new = plugins.cached_scores(df, spark.createDataFrame([], "cache_key string, response string"), judge, "k", path=f"{tmp_path}/cache")
    assert rows.count() == new.count() == 8 and calls.value == 8


def test_a_hanging_row_scores_nothing(spark):
    def slow(row):
        if row["k"] == 1:
            time.sleep(30)
        return 1.0

    began = time.monotonic()
    df = spark.createDataFrame([(k,) for k in range(4)], "k long").coalesce(1)
    got = plugins.apply_scorer(df, plugins.safe_scorer(slow, 0.5), "k long, score double").collect()
    assert sorted((r["k"], r["score"]) for r in got) == [(0, 1.0), (1, 0.0), (2, 1.0), (3, 1.0)] and time.monotonic() - began < 25


def test_unfinished_folders_are_computed_again(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for _ in range(2):
        assert io.load_or_compute(spark, str(tmp_path / "t"), lambda: spark.range(3)).count() == 3
