"""Ties that the last bit of a sum would decide, and steps whose cost must not grow faster than their input."""

import random
import sys
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import monitoring, plugins, scores, tokens
from gradeloom.plans import roundtrips
from gradeloom.plans import scores as plans
from gradeloom.sources import documents


def test_composites_equal_but_for_the_last_bit_are_ties(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.1 + 0.2), (3, 0.30001)], "step long, v double")
    assert {r["step"]: r["rank"] for r in monitoring.composite_ranking(df, {"v": 1.0}, "step").collect()} == {3: 1, 1: 2, 2: 3}


def test_a_consensus_that_ends_in_a_half_is_rounded_up(spark, tmp_path):
    # the mean is 3.82195, which the sum of doubles falls short of
    rows = [(7, 3, 1, 0, 7.6228), (7, 3, 1, 1, 0.0211)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in plans.score_consensus(spark, str(tmp_path)).collect()] == [(7, 0, 3.822)]


def test_a_cell_that_ends_in_a_half_is_rounded_up(spark, tmp_path):
    # the mean is 5.3075, which the sum of doubles falls short of
    rows = [(7, 3, 1, 0, 2.117), (7, 4, 1, 0, 8.498)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in plans.score_matrix_completion(spark, str(tmp_path)).collect()] == [(7, 1, 0, 5.308, True)]


def test_a_std_that_is_the_floor_but_for_the_last_bit_discriminates(spark, tmp_path):
    # criterion 1 has 23/3 and 26/3, whose std comes out below 0.5 in any order of their sums
    rows = [(7, 3, c, a, v) for c, values in ((1, (23 / 3, 26 / 3)), (2, (1.0, 9.0))) for a, v in enumerate(values)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_orderkey long, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in plans.score_consensus(spark, str(tmp_path)).collect()] == [(7, 0, 6.5833)]
    long = df.selectExpr("l_suppkey q", "0 rollout", "l_linenumber crit", "l_orderkey answer", "false is_gold", "l_quantity score")
    assert abs(scores.reward_parts(long).first()["consensus"] - 79 / 12) < 1e-9


def test_rollouts_are_closed_many_at_a_time(spark):
    # criteria 1, 2, 4 rise and 3, 5 fall with the answer; 6 has no score that is shared with enough others
    rise, fall = [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]
    rows = [(q, 0, c, k, v) for q in range(300) for c, values in ((4, rise), (1, rise), (3, fall), (2, rise), (5, fall), (6, rise[:2])) for k, v in enumerate(values)]
    rows += [(None, 0, 1, 0, 1.0), (0, 0, 7, 0, None), (0, 0, None, 0, 2.0)]
    linked = scores.linked_criteria(spark.createDataFrame(rows, "q long, rollout int, crit int, answer long, score double"))
    assert "FlatMapGroupsInPandas" not in linked._jdf.queryExecution().toString()
    assert linked.dtypes == [("q", "bigint"), ("rollout", "int"), ("crit", "int"), ("rep", "int")]
    want = {(q, 0, c, r) for q in range(300) for c, r in ((1, 1), (2, 1), (4, 1), (3, 3), (5, 3))}
    got = [tuple(r) for r in linked.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_class_meets_each_bucket_once_on_its_way_to_the_cells(spark):
    near_dedup = pytest.importorskip("gradeloom.llm.near_dedup")
    rng = random.Random(5)
    block, component = {n: rng.randrange(12) for n in range(90)}, {n: min(n, rng.choice([3, 50, n])) for n in range(90)}
    held = {b: [n for n in range(90) if (n * 7 + b) % 3 or b > 8] for b in range(12)}
    rows = [(b, n, component[n], block[n]) for b, nodes in held.items() for n in nodes] + [(99, n, 3, block[n]) for n in block if component[n] == 3]
    got = near_dedup._cells(spark.createDataFrame(rows, "bucket long, node long, component long, block long"))
    cells = {tuple(r) for r in got.select("node", "i", "j").collect()}
    pairs = {(a, b) for nodes in held.values() for a in nodes for b in nodes if component[a] != component[b]}
    assert cells == {(a, min(block[a], block[b]), max(block[a], block[b])) for a, b in pairs} and got.count() == len(cells)


def test_rows_of_a_batch_share_a_worker_thread():
    names = set()

    def score(row):
        names.add(threading.get_ident())
        if row["k"] == 3:
            time.sleep(1.5)
        if row["k"] == 5:
            raise ValueError
        return {7: None, 8: float("nan")}.get(row["k"], row["k"])

    batches = [pd.DataFrame({"k": range(lo, lo + 500)}) for lo in (0, 500)]
    got = pd.concat(plugins.safe_scorer(score, 0.4)(iter(batches)))
    assert list(got["score"]) == [0.0 if k in (3, 5, 7, 8) else float(k) for k in range(1000)]
    with pytest.raises(SystemExit):
        list(plugins.safe_scorer(lambda row: sys.exit(1), 5.0)(iter(batches)))
    started = []
    thread = threading.Thread
    plugins.threading.Thread, kept = (lambda **k: started.append(1) or thread(**k)), thread
    try:
        list(plugins.safe_scorer(lambda row: 1.0, 5.0)(iter(batches)))
    finally:
        plugins.threading.Thread = kept
    assert len(started) == 2


def test_top_covariance_sorts_no_more_than_a_bucket_in_a_task(spark):
    rng = random.Random(3)
    rows = [(k // 9, k % 9, int(k % 4 > 0), rng.choice([0.25, 0.5, 1.0, 3.0]), rng.choice([-1.0, 0.5, 2.0])) for k in range(3000)]
    df = spark.createDataFrame(rows, "sample_id long, pos int, mask int, advantage double, old_logp double")
    for share in (0.0001, 0.02, 0.6, 1.0):
        got = tokens.top_covariance(df, share)
        plan = got._jdf.queryExecution().toString()
        assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
        counted = [r for r in rows if r[2]]
        a, b = (sum(r[i] for r in counted) / len(counted) for i in (3, 4))
        first = sorted(counted, key=lambda r: (-round((r[3] - a) * (r[4] - b), 9), r[0], r[1]))[: max(1, int(len(counted) * share))]
        found = {(r["sample_id"], r["pos"]) for r in got.collect()}
        assert found == {r[:2] for r in first}
    assert tokens.top_covariance(df.limit(0), 0.02).count() == 0
    null = df.limit(3).withColumn("advantage", F.when(F.col("pos") == 1, F.lit(None)).otherwise(F.col("advantage"))).withColumn("mask", F.lit(1))
    assert [r["cov"] for r in tokens.top_covariance(null, 1.0).orderBy(F.col("cov").desc_nulls_last()).collect()][2] is None


def test_documents_lie_in_one_folder_and_keep_all_cores_busy(spark, tmp_path):
    # 60 keys of five rows
    df = spark.range(300).select((F.col("id") % 60).alias("k"), "id").repartition(7)
    roundtrips.one_file_each(df, "k", F.to_json(F.collect_list("id")), f"{tmp_path}/d")
    files = documents.files_below(f"{tmp_path}/d")
    assert len(files) == 60 and {name.rpartition("/")[0] for name, _ in files} == {f"{tmp_path}/d"}
    read = documents.read_elements(spark, f"{tmp_path}/d")
    assert sorted(int(r["json"]) for r in read.collect()) == list(range(300)) and read.rdd.getNumPartitions() == 4
    pieces = [(f"f{k}", 0, 1 << 20) for k in range(1000)]
    assert len(documents.packed(pieces, 8)) == len(documents.packed(pieces)) == 39
    assert [p for task in documents.packed(pieces[:10], 4) for p in task.pieces] == pieces[:10] and documents.packed([], 4) == []
