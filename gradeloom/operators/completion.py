"""Score matrices with their holes filled: overall mean, row and column biases, and a low-rank rest by alternating ridge regression.

Small matrices are filled by numpy, as many at a time as a batch of rows holds. A large one never meets in one place: each half of a step is a join of the observed cells with the factors of
one side and sums of a few numbers for each row of the other side, and a batch of small systems is solved from these sums. Both ways start from the same
factors, which a hash of the column gives, and stop by the same rule, so they agree up to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIAS_ROUNDS = 10
#: Cells that are filled at a time, so those of the largest matrix that numpy fills; larger matrices are filled by aggregates.
MAX_CELLS = 1_000_000
#: Rows of a large matrix that are filled with all its columns in one group.
ROW_BLOCK = 1024


def complete_matrix(observed: np.ndarray, mask: np.ndarray, rank: int = 2, iterations: int = 50, reg: float = 0.1, tol: float = 1e-5, start: np.ndarray | None = None) -> np.ndarray:
    """The matrix filled: results are within 0 and 10, observed entries stay as they are. Without an observed entry all are 5.

    ``start`` has the first factors of the columns (columns x rank), small and not all alike; a seed gives them where it is missing. Steps end where no column's factor
    moves by ``tol`` or more. The fit may end in a local minimum that depends on the start.
    """
    v = np.random.default_rng(0).normal(0, 0.1, (sum(observed.shape), rank))[observed.shape[0] :] if start is None else start
    return complete_matrices(observed[None], mask[None], v[None], iterations, reg, tol)[0]


def complete_matrices(observed: np.ndarray, mask: np.ndarray, start: np.ndarray, iterations: int = 50, reg: float = 0.1, tol: float = 1e-5) -> np.ndarray:
    """``complete_matrix`` of many matrices of one shape (matrices x rows x columns). Each stops at its own step."""
    n_rows, n_cols, n = mask.sum(axis=2), mask.sum(axis=1), mask.sum(axis=(1, 2))
    total = np.where(mask, observed, 0.0).sum(axis=(1, 2))
    mean = np.where(n > 0, total / np.maximum(n, 1), 5.0)[:, None, None]
    cols = np.zeros(n_cols.shape)
    for _ in range(BIAS_ROUNDS):
        rows = np.where(mask, observed - mean - cols[:, None, :], 0.0).sum(axis=2) / (n_rows + reg)
        cols = np.where(mask, observed - mean - rows[:, :, None], 0.0).sum(axis=1) / (n_cols + reg)
    base = mean + rows[:, :, None] + cols[:, None, :]
    rest = np.where(mask, observed - base, 0.0)
    rank = start.shape[2]
    u, v = np.zeros((*n_rows.shape, rank)), start.copy()

    def fit(weight: np.ndarray, rest: np.ndarray, f: np.ndarray) -> np.ndarray:
        gram = (weight @ (f[..., :, None] * f[..., None, :]).reshape(*f.shape[:2], -1)).reshape(*weight.shape[:2], rank, rank)
        return np.linalg.solve(gram + reg * np.eye(rank), (rest @ f)[..., None])[..., 0]

    going, w, r = np.arange(len(mask)), mask.astype(float), rest
    for _ in range(iterations):
        was = v[going]
        u[going] = x = fit(w, r, was)
        v[going] = y = fit(w.transpose(0, 2, 1), r.transpose(0, 2, 1), x)
        moved = ~(np.abs(y - was).max(axis=(1, 2)) < tol)
        if not moved.any():
            break
        if not moved.all():
            going, w, r = going[moved], w[moved], r[moved]
    return np.where(mask, observed, np.clip(base + u @ v.transpose(0, 2, 1), 0.0, 10.0))


def _kept(df: DataFrame, where: str) -> DataFrame:
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _start(key: str, rank: int) -> Column:
    """First factors of a column: even in +-0.17, so of deviation 0.1."""
    return F.array(*[F.xxhash64(F.col(key), F.lit(k)) / F.lit(2.0**63) * F.lit(0.1 * 3**0.5) for k in range(rank)])


def _places(owner: np.ndarray, key: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each cell the place of its key among those of its matrix; for each matrix the number of keys, and where they begin in the last: a cell of each key."""
    codes = pd.factorize(key, sort=True)[0].astype(np.int64)
    width = codes.max() + 1
    keys, first, place = np.unique(owner * width + codes, return_index=True, return_inverse=True)
    n = np.bincount(keys // width)
    begin = np.cumsum(n) - n
    return place - begin[owner], n, begin, first


def _begins(pdf: pd.DataFrame) -> np.ndarray:
    """The rows of a table sorted by q where a matrix begins."""
    q = pdf["q"].to_numpy()
    return np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))


def _filled(pdf: pd.DataFrame, rank: int, iterations: int, reg: float, tol: float) -> Iterator[pd.DataFrame]:
    """All cells of the whole matrices of a table sorted by q. Those of one shape are filled together."""
    begins = _begins(pdf)
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(pdf))))
    row, n_rows, row_begin, row_cell = _places(owner, pdf["row"])
    col, n_cols, col_begin, col_cell = _places(owner, pdf["col"])
    score, start = pdf["score"].to_numpy(), pdf[[f"start{k}" for k in range(rank)]].to_numpy()
    for m, n in np.unique(np.stack([n_rows, n_cols], axis=1), axis=0):
        alike, step = np.flatnonzero((n_rows == m) & (n_cols == n)), max(1, MAX_CELLS // (m * n))
        for some in (alike[k : k + step] for k in range(0, len(alike), step)):
            at = np.full(len(begins), -1)
            at[some] = np.arange(len(some))
            cells = np.flatnonzero(at[owner] >= 0)
            b, i, j = at[owner[cells]], row[cells], col[cells]
            observed, mask, v = np.zeros((len(some), m, n)), np.zeros((len(some), m, n), bool), np.zeros((len(some), n, rank))
            observed[b, i, j], mask[b, i, j], v[b, j] = score[cells], True, start[cells]
            filled = complete_matrices(observed, mask, v, iterations, reg, tol)
            rows, cols = row_cell[row_begin[some][:, None] + np.arange(m)], col_cell[col_begin[some][:, None] + np.arange(n)]
            labels = {"q": np.repeat(begins[some], m * n), "row": np.repeat(rows.ravel(), n), "col": np.repeat(cols, m, axis=0).ravel()}
            out = pd.DataFrame({name: pdf[name].take(found).array for name, found in labels.items()})
            yield out.assign(score=filled.ravel(), observed=mask.ravel())


def _by_batches(cells: DataFrame, rank: int, iterations: int, reg: float, tol: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last matrix may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = _begins(pdf)[-1]
            held = pdf.iloc[last:]
            if last:
                yield from _filled(pdf.iloc[:last], rank, iterations, reg, tol)
        if held is not None:
            yield from _filled(held, rank, iterations, reg, tol)

    t = dict(cells.dtypes)
    cells = cells.select("*", *[_start("col", rank)[k].alias(f"start{k}") for k in range(rank)])
    return cells.repartition("q").sortWithinPartitions("q").mapInPandas(run, f"q {t['q']}, row {t['row']}, col {t['col']}, score double, observed boolean")


def _solver(rank: int, reg: float) -> Callable[[Column], Column]:
    upper = np.triu_indices(rank)

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        if sums.empty:
            return pd.Series([], dtype=object)
        flat = np.stack(sums.to_list())
        gram = np.zeros((len(flat), rank, rank))
        gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = flat[:, : len(upper[0])]
        return pd.Series(list(np.linalg.solve(gram + reg * np.eye(rank), flat[:, len(upper[0]) :, None])[..., 0]))

    return solve


def _by_aggregates(cells: DataFrame, rank: int, iterations: int, reg: float, tol: float, path: str) -> DataFrame:
    names = (f"{k:05d}" for k in range(1 << 20))

    def kept(df: DataFrame, label: str) -> DataFrame:
        return _kept(df, f"{path}/{next(names)}-{label}")

    means = cells.groupBy("q").agg(F.avg("score").alias("mean"))
    cells = kept(cells.join(means, "q").withColumn("rest", F.col("score") - F.col("mean")), "cells")

    def bias(side: str, other: str, of_other: DataFrame | None) -> DataFrame:
        left = cells.withColumn("bias", F.lit(0.0)) if of_other is None else cells.join(of_other, ["q", other])
        return kept(left.groupBy("q", side).agg((F.sum(F.col("rest") - F.col("bias")) / (F.count(F.lit(1)) + reg)).alias("bias")), f"bias-{side}")

    of_cols = None
    for _ in range(BIAS_ROUNDS):
        of_rows = bias("row", "col", of_cols)
        of_cols = bias("col", "row", of_rows)
    rests = cells.join(of_rows.withColumnRenamed("bias", "b"), ["q", "row"]).join(of_cols, ["q", "col"])
    rests = kept(rests.select("q", "row", "col", (F.col("rest") - F.col("b") - F.col("bias")).alias("rest")), "rests")
    solve = _solver(rank, reg)

    def factors(side: str, other: str, of_other: DataFrame) -> DataFrame:
        """Of each ``side`` of the matrices that ``of_other`` still has: the factor that fits its cells best."""
        f = [F.col("f")[k] for k in range(rank)]
        sums = [F.sum(f[a] * f[b]) for a in range(rank) for b in range(a, rank)] + [F.sum(x * F.col("rest")) for x in f]
        return rests.join(of_other.select("q", other, "f"), ["q", other]).groupBy("q", side).agg(F.array(*sums).alias("sums")).select("q", side, solve("sums").alias("f"))

    # matrices leave when their columns stand still; the factors that they left with are in the tables of that step
    v, ended = rests.groupBy("q", "col").agg(F.count(F.lit(1)).alias("n")).select("q", "col", _start("col", rank).alias("f")), []
    for k in range(iterations):
        u = kept(factors("row", "col", v), "u")
        new = kept(factors("col", "row", u), "v")
        step = F.array_max(F.zip_with("f", "was", lambda a, b: F.abs(a - b)))
        moved = new.join(v.withColumnRenamed("f", "was"), ["q", "col"]).groupBy("q").agg(F.max(step).alias("step"))
        moved = kept(moved.select("q", ((F.col("step") < tol) | F.lit(k == iterations - 1)).alias("still")), "still")
        still = moved.filter("still").select("q")
        ended.append((u.join(still, "q", "left_semi"), new.join(still, "q", "left_semi")))
        v = kept(new.join(moved.filter("not still").select("q"), "q", "left_semi"), "going")
        if v.isEmpty():
            break
    us, vs = (reduce(DataFrame.unionByName, tables) for tables in zip(*ended, strict=True))
    # all cells of a matrix are its result, so rows meet all columns of it: in blocks of rows
    blocks = of_rows.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("n"))
    rows = us.join(of_rows.withColumnRenamed("bias", "b"), ["q", "row"]).withColumnRenamed("f", "g").join(blocks, "q").withColumn("block", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).drop("n")
    cols = vs.join(of_cols, ["q", "col"]).join(blocks, "q").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    product = F.aggregate(F.zip_with("g", "f", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    every = rows.join(cols, ["q", "block"]).join(means.withColumnRenamed("mean", "m"), "q").join(cells.select("q", "row", "col", "score"), ["q", "row", "col"], "left")
    fitted = F.greatest(F.least(F.col("m") + F.col("b") + F.col("bias") + product, F.lit(10.0)), F.lit(0.0))
    return every.select("q", "row", "col", F.coalesce("score", fitted).alias("score"), F.col("score").isNotNull().alias("observed"))


def complete_scores(df: DataFrame, path: str, rank: int = 2, iterations: int = 50, reg: float = 0.1, tol: float = 1e-5, max_cells: int = MAX_CELLS) -> DataFrame:
    """(q, row, col, score, observed) with every cell of each question's matrix, as ``complete_matrix`` fills it.

    Repeated cells count with their mean; rows with a null question, row, column or score are left out, and a row, column or question with no other isn't in the result. An empty table stays
    empty. Matrices of up to about ``max_cells`` cells are filled many at a time, larger ones by aggregates. The cells, the names of large matrices and the aggregates' steps are left in
    ``path``, a new folder that all executors share; ``df`` is read once. Which way a matrix goes changes no result but for rounding.
    """
    cells = df.select("q", "row", "col", F.col("score").cast("double").alias("score")).dropna()
    cells = _kept(cells.groupBy("q", "row", "col").agg(F.avg("score").alias("score")), f"{path}/cells")
    # n cells have at most n rows and n columns
    many = cells.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > math.isqrt(max_cells)).select("q")
    many = _kept(many, f"{path}/many")
    if many.isEmpty():
        return _by_batches(cells, rank, iterations, reg, tol)
    size = F.approx_count_distinct("row") * F.approx_count_distinct("col")
    large = cells.join(many, "q", "left_semi").groupBy("q").agg(size.alias("size")).filter(F.col("size") > max_cells).select("q")
    large = _kept(large, f"{path}/large")
    small = _by_batches(cells.join(large, "q", "left_anti"), rank, iterations, reg, tol)
    if large.isEmpty():
        return small
    return small.unionByName(_by_aggregates(cells.join(large, "q", "left_semi"), rank, iterations, reg, tol, path))
