"""Group-relative statistics: scores normalised inside their group (``uid``), as windows over (sample_id, uid, score, ...).

All windows of an estimator share one partitioning, so each costs one exchange. Results are in column ``advantage``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str):
    """Register a function DataFrame -> DataFrame as the group normaliser ``name``."""

    def add(f):
        ESTIMATORS[name] = f
        return f

    return add


def get_estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name]


def _in_group(f: Column) -> Column:
    return f.over(Window.partitionBy("uid"))


def _n() -> Column:
    return _in_group(F.count(F.lit(1)))


@estimator("grpo")
def grpo(df: DataFrame, by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample std + 1e-6); a one-row group has mean 0 and std 1, so it keeps its score."""
    one = _n() == 1
    mean = F.when(one, 0.0).otherwise(_in_group(F.avg("score")))
    std = F.when(one, 1.0).otherwise(_in_group(F.stddev_samp("score")))
    return df.withColumn("advantage", (F.col("score") - mean) / (std + EPS) if by_std else F.col("score") - mean)


@estimator("grpo_vectorized")
def grpo_vectorized(df: DataFrame, by_std: bool = True) -> DataFrame:
    """The same with the variance floored at eps; a one-row group has mean 0 and std 1."""
    one = _n() == 1
    mean = F.when(one, 0.0).otherwise(_in_group(F.avg("score")))
    std = F.when(one, 1.0).otherwise(F.sqrt(F.greatest(_in_group(F.var_samp("score")), F.lit(EPS))))
    return df.withColumn("advantage", (F.col("score") - mean) / (std + EPS) if by_std else F.col("score") - mean)


@estimator("gdpo")
def gdpo(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Each component normalised in its group as by ``grpo``, then their weighted sum."""
    total = F.lit(0.0)
    one = _n() == 1
    for name, weight in weights.items():
        mean = F.when(one, 0.0).otherwise(_in_group(F.avg(name)))
        std = F.when(one, 1.0).otherwise(_in_group(F.stddev_samp(name)))
        total = total + weight * (F.col(name) - mean) / (std + EPS)
    return df.withColumn("advantage", total)


def normalise_for_display(df: DataFrame, weight: float = 1.0) -> DataFrame:
    """weight (s - mean) / (population std + 1e-6); a one-row group gets 0."""
    value = weight * (F.col("score") - _in_group(F.avg("score"))) / (_in_group(F.stddev_pop("score")) + EPS)
    return df.withColumn("advantage", F.when(_n() == 1, 0.0).otherwise(value))


@estimator("pass_at_k")
def pass_at_k(df: DataFrame, by_std: bool = False, strict: bool = True) -> DataFrame:
    """The best row of a group gets best - second best (over the sample std), the others 0; the first row wins a tie.

    A group of one row is an error, or null where ``strict`` is false.
    """
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "sample_id")
    gain = F.col("score") - F.lead("score").over(order)
    if by_std:
        gain = gain / (_in_group(F.stddev_samp("score")) + EPS)
    alone = F.raise_error(F.concat(F.lit("pass_at_k needs two rows in group "), F.col("uid").cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return df.withColumn("advantage", F.when(_n() < 2, alone).when(F.row_number().over(order) == 1, gain).otherwise(0.0))


@estimator("mean_baseline")
def mean_baseline(df: DataFrame, weight: str = "length") -> DataFrame:
    """Score minus the group mean, then whitened over all tokens (each row counts ``weight`` tokens, Bessel's correction).

    A one-row group keeps its score before whitening. The whole-table moments are a one-row join.
    """
    base = df.withColumn("_x", F.col("score") - F.when(_n() == 1, 0.0).otherwise(_in_group(F.avg("score"))))
    sums = base.agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col("_x")).alias("_s"), F.sum(F.col(weight) * F.col("_x") ** 2).alias("_q"))
    mean = F.col("_s") / F.col("_w")
    var = (F.col("_q") / F.col("_w") - mean**2) * F.col("_w") / (F.col("_w") - 1)
    one = sums.select(mean.alias("_mean"), var.alias("_var"))
    return base.crossJoin(F.broadcast(one)).withColumn("advantage", (F.col("_x") - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_x", "_mean", "_var")


@estimator("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Score minus the mean of the others; a one-row group keeps its score."""
    n = _n()
    return df.withColumn("advantage", F.when(n > 1, (F.col("score") - _in_group(F.avg("score"))) * n / (n - 1)).otherwise(F.col("score")))


@estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """The same; a one-row group gets 0."""
    n = _n()
    value = (n * F.col("score") - _in_group(F.sum("score"))) / F.greatest(n - 1, F.lit(1))
    return df.withColumn("advantage", F.when(n > 1, value).otherwise(0.0))


@estimator("opo")
def opo(df: DataFrame, weight: str = "length") -> DataFrame:
    """Score minus the length-weighted mean of the group; a one-row group keeps its score."""
    baseline = F.try_divide(_in_group(F.sum(F.col(weight) * F.col("score"))), _in_group(F.sum(weight)))
    return df.withColumn("advantage", F.when(_n() == 1, F.col("score")).otherwise(F.col("score") - baseline))


@estimator("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / rows whose score isn't 0; a one-row group has mean 0."""
    one = df.agg((F.count(F.lit(1)) / F.greatest(F.count(F.when(F.col("score") != 0, 1)), F.lit(1))).alias("_alpha"))
    mean = F.when(_n() == 1, 0.0).otherwise(_in_group(F.avg("score")))
    return df.crossJoin(F.broadcast(one)).withColumn("advantage", F.col("_alpha") * (F.col("score") - mean) / f_norm).drop("_alpha")
