import numpy as np
from pyspark.sql import functions as F

from gradeloom.operators import completion

SCHEMA = "q string, row int, col string, score double"


def _cells(q, shape, share, seed):
    rng = np.random.default_rng(seed)
    full = np.clip(5 + rng.normal(0, 1.2, (shape[0], 2)) @ rng.normal(0, 1, (2, shape[1])), 0, 10)
    return [(q, i, f"c{j}", float(full[i, j])) for i in range(shape[0]) for j in range(shape[1]) if rng.random() < share]


def _table(df):
    return {(r["q"], r["row"], r["col"]): (r["score"], r["observed"]) for r in df.collect()}


def test_aggregates_give_what_a_group_gives(spark, tmp_path):
    cells = _cells("a", (12, 9), 0.7, 1) + _cells("b", (7, 15), 0.6, 2) + [("one", 3, "c0", 4.0)]
    # repeats of a cell, and rows that don't count
    cells += [cells[0][:3] + (1.0,), ("a", 1, None, 3.0), ("a", None, "c1", 3.0), (None, 1, "c1", 3.0), ("none", 1, "c1", None)]
    df = spark.createDataFrame(cells, SCHEMA).repartition(3)
    group = _table(completion.complete_scores(df, str(tmp_path / "g"), iterations=6))
    spread = _table(completion.complete_scores(df, str(tmp_path / "s"), iterations=6, max_cells=0))
    assert group.keys() == spread.keys() and {q for q, _, _ in group} == {"a", "b", "one"}
    assert all(group[k][1] == spread[k][1] and abs(group[k][0] - spread[k][0]) < 1e-6 for k in group)
    assert group["a", cells[0][1], cells[0][2]][0] == (cells[0][3] + 1.0) / 2
    # matrices of both kinds in one table, and matrices that stop at steps of their own
    both = _table(completion.complete_scores(df, str(tmp_path / "b"), iterations=6, max_cells=106, tol=1e-1))
    alone = _table(completion.complete_scores(df, str(tmp_path / "o"), iterations=6, tol=1e-1))
    assert both.keys() == alone.keys() and all(abs(both[k][0] - alone[k][0]) < 1e-6 for k in both)


def test_holes_are_near_the_truth_and_nothing_gives_nothing(spark, tmp_path):
    full = {c[:3]: c[3] for c in _cells("q", (10, 10), 1.1, 3)}
    seen = [(*k, v) for i, (k, v) in enumerate(full.items()) if i % 4]
    out = _table(completion.complete_scores(spark.createDataFrame(seen, SCHEMA), str(tmp_path / "q")))
    assert len(out) == 100 and all(0 <= v <= 10 for v, _ in out.values())
    assert np.sqrt(np.mean([(v - full[k]) ** 2 for k, (v, observed) in out.items() if not observed])) < 2.0
    assert completion.complete_scores(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")).count() == 0


def test_rows_of_a_large_matrix_fall_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(completion, "ROW_BLOCK", 4)
    df = spark.createDataFrame(_cells("q", (23, 5), 0.6, 4), SCHEMA)
    out = completion.complete_scores(df, str(tmp_path / "q"), iterations=2, max_cells=0)
    assert out.count() == df.select("row").distinct().count() * df.select("col").distinct().count()
    assert out.groupBy("row", "col").count().agg(F.max("count")).first()[0] == 1


def test_matrices_of_a_batch_are_filled_together_as_each_by_itself(spark, tmp_path):
    # numbers that are alike as doubles, shapes of all kinds, matrices that stop at steps of their own, and batches that end inside a matrix
    base, cells = 1 << 60, []
    for k in range(40):
        cells += [(base + k, *c[1:]) for c in _cells("x", (2 + k % 5, 1 + k % 4), 0.8 if k % 3 else 1.0, k)]
    df = spark.createDataFrame(cells, "q long, row int, col string, score double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = completion.complete_scores(df, str(tmp_path / "q"))
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = _table(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    starts = {r["col"]: r["s"] for r in df.select("col", completion._start("col", 2).alias("s")).distinct().collect()}
    want = {}
    for q in {c[0] for c in cells}:
        seen = {c[1:3]: c[3] for c in cells if c[0] == q}
        rows, cols = sorted({i for i, _ in seen}), sorted({j for _, j in seen})
        mask = np.array([[(i, j) in seen for j in cols] for i in rows])
        full = completion.complete_matrix(np.array([[seen.get((i, j), 0.0) for j in cols] for i in rows]), mask, start=np.array([starts[j] for j in cols]))
        want |= {(q, i, j): (full[a, b], mask[a, b]) for a, i in enumerate(rows) for b, j in enumerate(cols)}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in got)


def test_scores_are_computed_once(spark, tmp_path):
    cells = _cells("a", (12, 9), 0.7, 1) + _cells("b", (7, 15), 0.6, 2) + [("long", k, "c0", k / 20) for k in range(200)]
    for k, max_cells in enumerate((completion.MAX_CELLS, 1000, 107)):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        df = spark.createDataFrame(cells, SCHEMA).mapInPandas(counted, SCHEMA)
        assert completion.complete_scores(df, str(tmp_path / str(k)), iterations=2, max_cells=max_cells).count() == 12 * 9 + 7 * 15 + 200
        assert seen.value == len(cells)
