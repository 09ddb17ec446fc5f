"""Ranking evaluation over labelled rows (prompt, ord, score, label): how well scores order what labels order.

Prompts are groups; pairs are compared only inside a prompt, and counted without being formed: rows are added up by (prompt,
label, score), and for each two labels of a prompt cumulative counts over the scores give how many pairs agree, tie and
disagree. The work grows with a prompt's distinct scores times its distinct labels, and a hot prompt is split over ranges of its
scores. Rows with a null score or label take no part in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, by: str = "prompt", order: str = "ord") -> DataFrame:
    """The first ``n`` rows of each group in the order of an explicit column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def label_share(labels: Column) -> Column:
    """Share of true values of an array of booleans; 0 for an empty or null one."""
    n = F.size(labels)
    return F.when(n > 0, F.size(F.filter(labels, lambda x: x)) / n).otherwise(F.lit(0.0))


def _slice(value: Column) -> Column:
    """A number that rises with the value: 64 slices for each doubling of its distance from 0."""
    return F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 64)


def cumulate(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """For each of ``values`` a column ``before_v``, its sum over the rows of the group with a smaller ``order``.

    Sums are made within slices of the order and carried over a table with a row a slice, so a large group isn't one task's. Rows of equal
    order share their sums.
    """
    sliced = df.withColumn("_slice", _slice(F.col(order)))
    sums = sliced.groupBy(*by, "_slice").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_slice", *[F.coalesce(F.sum(f"_sum_{v}").over(ahead), F.lit(0)).alias(f"_carry_{v}") for v in values])
    inside = Window.partitionBy(*by, "_slice").orderBy(order)
    peers = Window.partitionBy(*by, "_slice", order)
    placed = sliced.select("*", *[(F.sum(v).over(inside) - F.sum(v).over(peers)).alias(f"_inside_{v}") for v in values]).join(carried, [*by, "_slice"])
    return placed.withColumns({f"before_{v}": F.col(f"_carry_{v}") + F.col(f"_inside_{v}") for v in values}).drop("_slice", *[f"_{k}_{v}" for k in ("carry", "inside") for v in values])


def pair_counts(df: DataFrame, legacy_ties: bool = False) -> DataFrame:
    """(prompt, low, high, pairs, agree, tied, gap): for each two labels of a prompt, low < high, the number of pairs of one row of
    each, of those whose scores are in the order of the labels or equal, and the sum of the gaps between their scores.

    With ``legacy_ties`` a tied pair in which the lower label comes first (by ord) agrees.
    """
    rows = df.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    counts = rows.groupBy("prompt", "label", "score").agg(F.count(F.lit(1)).cast("double").alias("n"))
    labels = counts.select("prompt", F.col("label").alias("other")).distinct()
    of_pair = [F.least("label", "other").alias("low"), F.greatest("label", "other").alias("high")]
    is_low, is_high = F.col("label") == F.col("low"), F.col("label") == F.col("high")
    dealt = counts.join(labels, "prompt").filter("label <> other").select("prompt", *of_pair, "label", "score", "n")
    keys = ["prompt", "low", "high"]
    met = dealt.groupBy(*keys, "score").agg(F.sum(F.when(is_low, F.col("n")).otherwise(0)).alias("n_low"), F.sum(F.when(is_high, F.col("n")).otherwise(0)).alias("n_high"))
    met = met.withColumn("s_low", F.col("n_low") * F.col("score"))
    totals = met.groupBy(*keys).agg(F.sum("n_low").alias("all_low"), F.sum("s_low").alias("all_s"))
    placed = cumulate(met, keys, "score", ["n_low", "s_low"]).join(totals, keys)
    under = F.col("score") * F.col("before_n_low") - F.col("before_s_low")
    above = F.col("all_s") - F.col("before_s_low") - F.col("s_low") - F.col("score") * (F.col("all_low") - F.col("before_n_low") - F.col("n_low"))
    high = F.col("n_high")
    out = placed.groupBy(*keys).agg(F.sum(high * F.col("all_low")).alias("pairs"), F.sum(high * F.col("before_n_low")).alias("agree"), F.sum(high * F.col("n_low")).alias("tied"), F.sum(high * (under + above)).alias("gap"))
    if not legacy_ties:
        return out
    # rows of equal score, in input order
    same = rows.select("prompt", "score", "label", "ord").join(labels, "prompt").filter("label <> other").select("prompt", *of_pair, "label", "score", "ord")
    w = Window.partitionBy(*keys, "score").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ahead = same.withColumn("ahead", F.sum(is_low.cast("double")).over(w)).filter(is_high).groupBy(*keys).agg(F.coalesce(F.sum("ahead"), F.lit(0.0)).alias("first"))
    out = out.join(ahead, keys, "left")
    return out.select(*keys, "pairs", (F.col("agree") + F.coalesce("first", F.lit(0.0))).alias("agree"), (F.col("tied") - F.coalesce("first", F.lit(0.0))).alias("tied"), "gap")


def _accuracy() -> Column:
    """Aggregate of pair counts: 1 for a pair in label order, 0.5 for tied scores, else 0."""
    return F.try_divide(F.sum(F.col("agree") + F.col("tied") / 2), F.sum("pairs"))


def pairwise_metrics(df: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(prompt, pairwise_acc, resolution, pairs_used).

    A prompt without a usable pair counts with three zeros, or is left out where ``keep_empty`` is false.
    """
    used = pair_counts(df).groupBy("prompt").agg(_accuracy().alias("pairwise_acc"), F.try_divide(F.sum("gap"), F.sum("pairs")).alias("resolution"), F.sum("pairs").cast("long").alias("pairs_used"))
    return df.select("prompt").distinct().join(used, "prompt", "left").na.fill(0) if keep_empty else used


def macro_mean(per_prompt: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: the mean of each per-prompt metric, and the number of prompts."""
    return per_prompt.agg(F.count(F.lit(1)).alias("n_prompts"), *[F.avg(m).alias(m) for m in metrics])


def confident_pairs_pooled(df: DataFrame, thresholds: Sequence[float] = (0.1, 0.2, 0.3), legacy_ties: bool = False) -> DataFrame:
    """(threshold, accuracy, n_pairs) over all pairs whose labels differ by the threshold or more."""
    each = pair_counts(df, legacy_ties).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.filter(F.col("high") - F.col("low") >= F.col("threshold")).groupBy("threshold").agg(_accuracy().alias("accuracy"), F.sum("pairs").cast("long").alias("n_pairs"))


def confident_pairs_by_prompt(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(prompt, accuracy, n_pairs) over pairs whose labels differ by more than the threshold."""
    return pair_counts(df).filter(F.col("high") - F.col("low") > threshold).groupBy("prompt").agg(_accuracy().alias("accuracy"), F.sum("pairs").cast("long").alias("n_pairs"))


def top_bottom_gap(df: DataFrame) -> DataFrame:
    """(prompt, gap): mean score at the best label minus that at the worst, for prompts with two labels or more."""
    w = Window.partitionBy("prompt")
    ends = df.withColumn("_best", F.max("label").over(w)).withColumn("_worst", F.min("label").over(w)).filter("_best > _worst")
    gap = F.avg(F.when(F.col("label") == F.col("_best"), F.col("score"))) - F.avg(F.when(F.col("label") == F.col("_worst"), F.col("score")))
    return ends.groupBy("prompt").agg(gap.alias("gap"))


def average_rank(by: Sequence[str] | str, value: str) -> Column:
    """Rank from 1 with ties at their mean rank."""
    by = [by] if isinstance(by, str) else list(by)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, null where either side is constant."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    return F.try_divide(cov, F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, by: Sequence[str] | str = "prompt", x: str = "score", y: str = "label") -> DataFrame:
    """(by, rho, n): correlation of average ranks for groups of two rows or more; null where a side is constant."""
    by = [by] if isinstance(by, str) else list(by)
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(by, x).alias("_rx"), average_rank(by, y).alias("_ry"))
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n")).filter("n >= 2")


def kendall_tau_b(df: DataFrame) -> DataFrame:
    """(prompt, tau): (C - D) / sqrt((C + D + ties in score only) (C + D + ties in label only)); null where undefined or there is one row."""
    rows = df.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    two = lambda n: n * (n - 1) / 2
    counts = rows.groupBy("prompt", "score", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ties = lambda c: counts.groupBy("prompt", c).agg(F.sum("n").alias("n")).groupBy("prompt").agg(F.sum("n").alias("all"), F.sum(two(F.col("n"))).alias(f"by_{c}"))
    net = pair_counts(df).groupBy("prompt").agg(F.sum(2 * F.col("agree") + F.col("tied") - F.col("pairs")).alias("net"))
    both = ties("score").join(ties("label").drop("all"), "prompt").join(net, "prompt", "left").filter("all > 1")
    free = lambda c: two(F.col("all")) - F.col(f"by_{c}")
    return both.select("prompt", F.try_divide(F.coalesce("net", F.lit(0.0)), F.sqrt(free("score") * free("label"))).alias("tau"))


def ndcg(df: DataFrame, k: int, min_rows: int = 2) -> DataFrame:
    """(prompt, ndcg): gain label / log2(rank + 1); ties in score are broken by ord. Prompts need ``min_rows`` rows and two labels."""
    w = Window.partitionBy("prompt")
    ranked = df.select("prompt", "label", F.row_number().over(w.orderBy(F.desc("score"), "ord")).alias("r"), F.row_number().over(w.orderBy(F.desc("label"), "ord")).alias("ideal"))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("label") / F.log2(F.col(r) + 1)).otherwise(0.0))
    sums = ranked.groupBy("prompt").agg(gain("r").alias("dcg"), gain("ideal").alias("idcg"), F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return sums.filter((F.col("n") >= min_rows) & (F.col("lo") < F.col("hi"))).select("prompt", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def ndcg_tie_averaged(df: DataFrame, k: int) -> DataFrame:
    """(prompt, ndcg) with tied scores sharing the mean discount of the places that they take."""
    w = Window.partitionBy("prompt")
    ranked = df.select("prompt", "label", "score", F.row_number().over(w.orderBy(F.desc("score"), "ord")).alias("r"), F.row_number().over(w.orderBy(F.desc("label"), "ord")).alias("ideal"))
    discount = lambda r: F.when(F.col(r) <= k, 1 / F.log2(F.col(r) + 1)).otherwise(0.0)
    shared = ranked.withColumn("d", F.avg(discount("r")).over(Window.partitionBy("prompt", "score")))
    sums = shared.groupBy("prompt").agg(F.sum(F.col("label") * F.col("d")).alias("dcg"), F.sum(F.col("label") * discount("ideal")).alias("idcg"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return sums.filter("lo < hi").select("prompt", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def auroc(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(prompt, auc): share of pairs of a label above the threshold and one not above with scores in that order, ties half;
    prompts need both kinds."""
    two = df.select("prompt", "ord", "score", (F.col("label") > threshold).cast("double").alias("label"))
    return pair_counts(two).select("prompt", F.try_divide(F.col("agree") + F.col("tied") / 2, F.col("pairs")).alias("auc"))


def auroc_input_order(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(prompt, auc) with tied scores taken in input order (ord): the share of (positive, negative) pairs in which the positive stands first."""
    w = Window.partitionBy("prompt").orderBy(F.desc("score"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    neg = (F.col("label") <= threshold).cast("double")
    marked = df.select("prompt", neg.alias("neg"), F.sum(neg).over(w).alias("neg_before"))
    sums = marked.groupBy("prompt").agg(F.sum("neg").alias("n"), F.sum(1 - F.col("neg")).alias("p"), F.sum((1 - F.col("neg")) * F.col("neg_before")).alias("wrong"))
    return sums.filter("p > 0 and n > 0").select("prompt", (1 - F.col("wrong") / (F.col("p") * F.col("n"))).alias("auc"))


def label_variance(df: DataFrame) -> DataFrame:
    """(prompt, variance): sample variance of the labels, 0 for one row."""
    return df.groupBy("prompt").agg(F.coalesce(F.var_samp("label"), F.lit(0.0)).alias("variance"))


def discriminative(df: DataFrame, n: int = 8, min_variance: float = 0.01) -> DataFrame:
    """Rows of prompts whose first ``n`` labels have a sample variance above ``min_variance``."""
    wide = label_variance(first_rows(df, n)).filter(F.col("variance") > min_variance)
    return df.join(wide, "prompt", "left_semi")


def score_sensitivity(df: DataFrame) -> DataFrame:
    """One row (n_prompts, n_varied, share): prompts with at least two distinct integer parts of scores."""
    each = df.groupBy("prompt").agg(F.countDistinct(F.col("score").cast("long")).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("n_prompts"), F.count(F.when(F.col("n") >= 2, 1)).alias("n_varied")).withColumn("share", F.try_divide("n_varied", "n_prompts"))


def head_to_head(a: DataFrame, b: DataFrame, metric: str, tolerance: float = 0.001) -> DataFrame:
    """One row (a_wins, b_wins, ties, n) over the prompts that both per-prompt tables have."""
    both = a.select("prompt", F.col(metric).alias("a")).join(b.select("prompt", F.col(metric).alias("b")), "prompt")
    a_wins, b_wins = F.col("a") > F.col("b") + tolerance, F.col("b") > F.col("a") + tolerance
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(a_wins).alias("a_wins"), count(b_wins).alias("b_wins"), count(~a_wins & ~b_wins).alias("ties"), F.count(F.lit(1)).alias("n"))


def hard_easy_means(a: DataFrame, b: DataFrame, metric: str, hard: float = 0.5, easy: float = 0.8) -> DataFrame:
    """(subset, n, a, b): means of both tables on prompts that are hard (below) or easy (at least) for ``a``."""
    both = a.select("prompt", F.col(metric).alias("a")).join(b.select("prompt", F.col(metric).alias("b")), "prompt")
    subset = F.when(F.col("a") < hard, "hard").when(F.col("a") >= easy, "easy")
    return both.withColumn("subset", subset).filter("subset is not null").groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))


def category_breakdown(df: DataFrame, category: str, a: str, b: str, tolerance: float = 0.001) -> DataFrame:
    """(category, n, a, b, delta, winner): mean of two metrics by category, and which is larger by more than the tolerance."""
    means = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias(a), F.avg(b).alias(b)).withColumn("delta", F.col(b) - F.col(a))
    return means.withColumn("winner", F.when(F.col("delta") > tolerance, b).when(F.col("delta") < -tolerance, a).otherwise("tie"))


def preference_accuracy(df: DataFrame, chosen: str, rejected: str, subset: str) -> DataFrame:
    """(subset, accuracy, n) with half credit for ties; the row with a null subset is the total."""
    credit = F.when(F.col(chosen) > F.col(rejected), 1.0).when(F.col(chosen) == F.col(rejected), 0.5).otherwise(0.0)
    return df.rollup(subset).agg(F.avg(credit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def compare_modes(modes: dict[str, DataFrame], k: int = 4) -> DataFrame:
    """(metric, one column a mode): eight metrics of several scorings of the same prompts, on the prompts that all have."""
    common = None
    for df in modes.values():
        ids = df.select("prompt").distinct()
        common = ids if common is None else common.intersect(ids)
    long = None
    for mode, df in modes.items():
        df = df.join(common, "prompt", "left_semi")
        pairwise = macro_mean(pairwise_metrics(df), ["pairwise_acc", "resolution"])
        one = [
            pairwise.select(F.lit("pairwise_acc").alias("metric"), F.col("pairwise_acc").alias("value")), pairwise.select(F.lit("resolution"), "resolution"),
            confident_pairs_by_prompt(df).agg(F.lit("confident_acc"), F.avg("accuracy")), top_bottom_gap(df).agg(F.lit("top_bottom_gap"), F.avg("gap")),
            spearman(df).agg(F.lit("spearman"), F.avg("rho")), kendall_tau_b(df).agg(F.lit("kendall_tau_b"), F.avg("tau")),
            ndcg(df, k).agg(F.lit(f"ndcg@{k}"), F.avg("ndcg")), auroc(df).agg(F.lit("auroc"), F.avg("auc")),
        ]
        for part in one:
            part = part.toDF("metric", "value").withColumn("mode", F.lit(mode))
            long = part if long is None else long.union(part)
    return long.groupBy("metric").pivot("mode", list(modes)).agg(F.first("value"))


def agreement(scores: DataFrame) -> DataFrame:
    """(prompt, var_per_answer, mean_pair_rho, ensemble_rho, individual_rho, collapsed_rate, mean_length) of several rubrics.

    From (prompt, rubric, answer, score, label, length): mean population variance per answer across rubrics, mean Spearman of
    rubric pairs, Spearman of the mean score with the label, mean of each rubric's own, the share of rubrics with one
    distinct score, and the mean rubric length. An answer's label and a rubric's length are means over their rows, which share them.
    """
    per_answer = scores.groupBy("prompt", "answer").agg(F.var_pop("score").alias("v"), F.avg("score").alias("score"), F.avg("label").alias("label"))
    variance = per_answer.groupBy("prompt").agg(F.avg("v").alias("var_per_answer"))
    ensemble = spearman(per_answer).select("prompt", F.col("rho").alias("ensemble_rho"))
    individual = spearman(scores, ["prompt", "rubric"]).groupBy("prompt").agg(F.avg("rho").alias("individual_rho"))
    left = scores.select("prompt", "answer", F.col("rubric").alias("i"), F.col("score").alias("x"))
    right = scores.select("prompt", "answer", F.col("rubric").alias("j"), F.col("score").alias("y"))
    pairs = spearman(left.join(right, ["prompt", "answer"]).filter("i < j"), ["prompt", "i", "j"], "x", "y").groupBy("prompt").agg(F.avg("rho").alias("mean_pair_rho"))
    rubrics = scores.groupBy("prompt", "rubric").agg(F.countDistinct("score").alias("n"), F.avg("length").alias("length"))
    collapsed = rubrics.groupBy("prompt").agg(F.avg((F.col("n") <= 1).cast("double")).alias("collapsed_rate"), F.avg("length").alias("mean_length"))
    out = variance
    for part in (pairs, ensemble, individual, collapsed):
        out = out.join(part, "prompt", "left")
    return out.select("prompt", "var_per_answer", "mean_pair_rho", "ensemble_rho", "individual_rho", "collapsed_rate", "mean_length")
