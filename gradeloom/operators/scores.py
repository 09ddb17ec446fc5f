"""Score-matrix analytics over the long table (q, rollout, crit, answer, is_gold, score).

A rollout's rubric has criteria; each criterion scores the answers of the other rollouts and perhaps a gold answer.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.ranking import average_rank, pearson

# Bounds and weights of the reward's parts.
REWARD = {
    "disc_floor": 0.5, "disc_power": 1.5, "disc_scale": 1.0, "gold_scale": 2.0, "binary_floor": 0.5, "binary_scale": 2.0,
    "min_chars": 30, "short_criterion": -0.1, "min_tokens": 100, "short_response": -1.0, "parrot": 1.0,
}
COMPONENTS = ("consensus", "disc", "qa", "gold_disc", "calibration", "parrot")


def evaluation_pairs(rollouts: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(q, rollout, answer, is_gold): every rollout against the answers of the others in its question, and the gold answer."""
    a = rollouts.select("q", "rollout")
    others = a.join(rollouts.select("q", F.col("rollout").alias("answer")), "q").filter("rollout <> answer").withColumn("is_gold", F.lit(False))
    if gold is None:
        return others
    return others.unionByName(a.join(gold.select("q", F.lit(-1).cast(rollouts.schema["rollout"].dataType).alias("answer")).distinct(), "q").withColumn("is_gold", F.lit(True)))


def redundant_edges(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(q, rollout, a, b, rho): criterion pairs of a rollout whose scores over three common answers or more have a Spearman rho
    above the threshold. Constant ones have no correlation and no edge."""
    by = ["q", "rollout", "a", "b"]
    marks = F.sort_array(F.collect_list(F.struct(F.col("crit").alias("c"), F.col("score").alias("s"))))
    # the scores of an answer are gathered once and paired where they lie
    answers = scores.dropna(subset=["q", "rollout", "answer", "crit", "score"]).groupBy("q", "rollout", "answer").agg(marks.alias("m"))
    first = answers.filter(F.size("m") > 1).select("q", "rollout", "m", F.explode("m").alias("_a"))
    pairs = first.select("q", "rollout", F.col("_a.c").alias("a"), F.col("_a.s").alias("x"), F.explode(F.filter("m", lambda e: e["c"] > F.col("_a.c"))).alias("_b"))
    pairs = pairs.select("q", "rollout", "a", F.col("_b.c").alias("b"), "x", F.col("_b.s").alias("y"))
    ranked = pairs.select(*by, average_rank(by, "x").alias("rx"), average_rank(by, "y").alias("ry"))
    return ranked.groupBy(*by).agg(pearson("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 3) & (F.col("rho") > threshold)).drop("n")


def linked_criteria(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(q, rollout, crit, rep) of criteria that are redundant with another; ``rep`` is the smallest one that is reached over edges.

    A rollout has few criteria, so its edges are closed as one list; a task takes many rollouts at a time.
    """
    kind = scores.schema["crit"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<crit: {kind}, rep: {kind}>>")
    def close(edges: pd.Series) -> pd.Series:
        out = []
        for listed in edges:
            up = {}

            def root(v):
                while up.setdefault(v, v) != v:
                    v = up[v]
                return v

            for e in listed:
                x, y = root(e["a"]), root(e["b"])
                up[max(x, y)] = min(x, y)
            out.append([{"crit": v, "rep": root(v)} for v in sorted(up)])
        return pd.Series(out, dtype=object)

    edges = redundant_edges(scores, threshold).groupBy("q", "rollout").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    return edges.select("q", "rollout", F.inline(close("edges")))


def criterion_clusters(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(q, rollout, crit, rep): clusters of redundant criteria, named by their smallest criterion."""
    every = scores.select("q", "rollout", "crit").distinct()
    return every.join(linked_criteria(scores, threshold), ["q", "rollout", "crit"], "left").withColumn("rep", F.coalesce("rep", "crit"))


def duplicate_weights(clusters: DataFrame) -> DataFrame:
    """``weight``: 1 / size of the criterion's cluster."""
    return clusters.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("q", "rollout", "rep")))


def unique_rate(clusters: DataFrame) -> DataFrame:
    """One row: mean over rollouts of clusters / criteria."""
    return clusters.groupBy("q", "rollout").agg((F.countDistinct("rep") / F.count(F.lit(1))).alias("r")).agg(F.avg("r").alias("unique_rate"))


def unique_scores(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """The scores of representatives alone."""
    reps = clusters.filter("crit = rep").select("q", "rollout", "crit")
    return scores.join(reps, ["q", "rollout", "crit"], "left_semi")


def _criterion_values() -> dict[str, Column]:
    solver = F.when(~F.col("is_gold"), F.col("score"))
    return {"n": F.count(solver), "std": F.stddev_pop(solver), "gold": F.max(F.when(F.col("is_gold"), F.col("score"))), "mean": F.avg(solver)}


def _spread(floor: float, power: float) -> Column:
    return F.when(F.col("n") >= 2, F.when(F.col("std") < floor, 0.0).otherwise(F.pow(F.greatest(F.col("std") - floor, F.lit(0.0)), power)))


def _gold_gap() -> Column:
    return F.when(F.col("n") > 0, F.col("gold") - F.col("mean"))


def _discriminates(floor: float) -> Column:
    """The std is taken at nine places, for the order of its sums decides the last bit of one that is the floor itself."""
    return (F.col("n") >= 2) & (F.round("std", 9) >= floor)


def _at_an_end() -> Column:
    return ((F.col("score") <= 0.5) | (F.col("score") >= 9.5)).cast("double")


def criterion_stats(scores: DataFrame, floor: float = REWARD["disc_floor"]) -> DataFrame:
    """(q, rollout, crit, n, std, gold, mean): solver answers' number, population std and mean, the gold score; ``discriminative``."""
    stats = scores.groupBy("q", "rollout", "crit").agg(*[value.alias(name) for name, value in _criterion_values().items()])
    return stats.withColumn("discriminative", _discriminates(floor))


def consensus(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """(q, rollout, consensus): per answer the mean over discriminative criteria, then the mean over answers; all criteria count
    in a rollout where none is discriminative."""
    flagged = stats.select("q", "rollout", "crit", "discriminative", F.max("discriminative").over(Window.partitionBy("q", "rollout")).alias("_any"))
    used = flagged.filter(F.col("discriminative") | ~F.col("_any")).select("q", "rollout", "crit")
    per_answer = scores.filter(~F.col("is_gold")).join(used, ["q", "rollout", "crit"]).groupBy("q", "rollout", "answer").agg(F.avg("score").alias("s"))
    return per_answer.groupBy("q", "rollout").agg(F.avg("s").alias("consensus"))


def discrimination(stats: DataFrame, floor: float = REWARD["disc_floor"], power: float = REWARD["disc_power"], scale: float = REWARD["disc_scale"]) -> DataFrame:
    """(q, rollout, disc): mean of (std - floor)^power over criteria with two scores, 0 for those under the floor, times scale."""
    return stats.groupBy("q", "rollout").agg((F.coalesce(F.avg(_spread(floor, power)), F.lit(0.0)) * scale).alias("disc"))


def gold_discrimination(stats: DataFrame, scale: float = REWARD["gold_scale"], factor: float = 1.0) -> DataFrame:
    """(q, rollout, gold_disc): mean over criteria of gold score - mean solver score, times scale and factor."""
    return stats.groupBy("q", "rollout").agg((F.coalesce(F.avg(_gold_gap()), F.lit(0.0)) * scale * factor).alias("gold_disc"))


def calibration(scores: DataFrame, floor: float = REWARD["binary_floor"], scale: float = REWARD["binary_scale"]) -> DataFrame:
    """(q, rollout, binary_ratio, calibration): share of scores at either end, and the penalty above the floor."""
    out = scores.groupBy("q", "rollout").agg(F.avg(_at_an_end()).alias("binary_ratio"))
    return out.withColumn("calibration", -scale * F.greatest(F.col("binary_ratio") - floor, F.lit(0.0)))


def short_penalties(rollouts: DataFrame, texts: str, tokens: str, c: Mapping[str, float] = REWARD) -> DataFrame:
    """``n_short``, ``crit_len_penalty`` and ``resp_len_penalty`` from an array of criterion texts and a token count."""
    short = F.size(F.filter(F.col(texts), lambda x: F.length(x) < c["min_chars"]))
    ramp = F.when((F.col(tokens) > 0) & (F.col(tokens) < c["min_tokens"]), c["short_response"] * (1 - F.col(tokens) / c["min_tokens"])).otherwise(0.0)
    return rollouts.withColumn("n_short", short).withColumn("crit_len_penalty", short * c["short_criterion"]).withColumn("resp_len_penalty", ramp)


def reward_parts(scores: DataFrame, gold_factor: float = 1.0, c: Mapping[str, float] = REWARD) -> DataFrame:
    """(q, rollout, consensus, disc, gold_disc, calibration), as the functions of these names give them, from one shuffle by rollout."""
    rollout, crit = Window.partitionBy("q", "rollout"), Window.partitionBy("q", "rollout", "crit")
    rows = scores.select("q", "rollout", "crit", "answer", "is_gold", "score").repartition("q", "rollout")
    rows = rows.select("*", *[value.over(crit).alias(name) for name, value in _criterion_values().items()], F.row_number().over(crit.orderBy("is_gold", "answer")).alias("_row"))
    rows = rows.withColumn("discriminative", _discriminates(c["disc_floor"])).withColumn("_any", F.max("discriminative").over(rollout))
    used = F.when(~F.col("is_gold") & (F.col("discriminative") | ~F.col("_any")), F.col("score"))
    # a criterion counts once, in its first row
    spread, gap = (F.when(F.col("_row") == 1, value) for value in (_spread(c["disc_floor"], c["disc_power"]), _gold_gap()))
    answers = rows.groupBy("q", "rollout", "answer").agg(
        F.avg(used).alias("used"),
        *[f(value).alias(f"{name}_{f.__name__}") for name, value in (("spread", spread), ("gap", gap), ("end", _at_an_end())) for f in (F.sum, F.count)],
    )

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_count"))

    return answers.groupBy("q", "rollout").agg(
        F.avg("used").alias("consensus"),
        (F.coalesce(mean("spread"), F.lit(0.0)) * c["disc_scale"]).alias("disc"),
        (F.coalesce(mean("gap"), F.lit(0.0)) * c["gold_scale"] * gold_factor).alias("gold_disc"),
        (-c["binary_scale"] * F.greatest(mean("end") - c["binary_floor"], F.lit(0.0))).alias("calibration"),
    )


def rewards(scores: DataFrame, rollouts: DataFrame, threshold: float = 0.8, gold_factor: float = 1.0, c: Mapping[str, float] = REWARD) -> DataFrame:
    """``rollouts`` (q, rollout, qa, parrot_flag) with the six components and ``reward``; a question's only rollout gets ``qa`` alone."""
    redundant = linked_criteria(scores, threshold).filter("crit <> rep").select("q", "rollout", "crit")
    unique = scores.join(redundant, ["q", "rollout", "crit"], "left_anti")
    out = rollouts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("q")))
    out = out.join(reward_parts(unique, gold_factor, c), ["q", "rollout"], "left")
    out = out.withColumn("parrot", F.when(F.col("parrot_flag"), -c["parrot"]).otherwise(0.0))
    for name in COMPONENTS:
        if name != "qa":
            out = out.withColumn(name, F.when(F.col("_n") > 1, F.coalesce(name, F.lit(0.0))).otherwise(0.0))
    return out.withColumn("reward", sum((F.col(n) for n in COMPONENTS), F.lit(0.0))).drop("_n")


def concept_diversity(rollouts: DataFrame, concepts: str) -> DataFrame:
    """(q, rollout, diversity): 1 - mean Jaccard of the concept array with those of the siblings; 0 without concepts or siblings."""
    a = rollouts.select("q", "rollout", F.col(concepts).alias("ca"))
    b = rollouts.select("q", F.col("rollout").alias("other"), F.col(concepts).alias("cb"))
    jaccard = F.when((F.size("ca") > 0) & (F.size("cb") > 0), F.size(F.array_intersect("ca", "cb")) / F.size(F.array_union("ca", "cb"))).otherwise(0.0)
    mean = a.join(b, "q").filter("rollout <> other").groupBy("q", "rollout").agg(F.avg(jaccard).alias("j"))
    value = F.when((F.size(F.col(concepts)) > 0) & F.col("j").isNotNull(), 1 - F.col("j")).otherwise(0.0)
    return rollouts.join(mean, ["q", "rollout"], "left").select("q", "rollout", value.alias("diversity"))
