"""Per-token statistics over long tables (sample_id, pos, mask, ...), mask 1 for tokens that count.

Whole-table figures are partial aggregates; per-sample ones group or window by sample_id. Where a figure is a masked mean, the
denominator is the number of counted tokens plus 1e-8, so a table without one gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.order import first_rows, range_bucket

SAFETY_BOUND = 20.0


def by_sample():
    return Window.partitionBy("sample_id")


def masked_sum(x: Column, mask: str = "mask") -> Column:
    return F.coalesce(F.sum(F.when(F.col(mask) != 0, x)), F.lit(0.0))


def masked_mean(x: Column, mask: str = "mask") -> Column:
    return masked_sum(x, mask) / (F.coalesce(F.sum(mask), F.lit(0)) + 1e-8)


def masked_var(x: Column, mask: str = "mask", unbiased: bool = True) -> Column:
    """Variance of counted tokens with Bessel's correction; null below two tokens."""
    chosen = F.when(F.col(mask) != 0, x)
    return F.var_samp(chosen) if unbiased else F.var_pop(chosen)


def whiten(df: DataFrame, column: str, out: str, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) over all counted tokens; the two moments are a one-row join."""
    moments = df.agg(masked_mean(F.col(column)).alias("_m"), masked_var(F.col(column)).alias("_v"))
    value = (F.col(column) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return df.crossJoin(F.broadcast(moments)).withColumn(out, value if shift_mean else value + F.col("_m")).drop("_m", "_v")


def masked_stats(df: DataFrame, column: str) -> DataFrame:
    """One row (n, sum, mean, variance, max, min) of the counted tokens."""
    chosen = F.when(F.col("mask") != 0, F.col(column))
    return df.agg(F.count(chosen).alias("n"), masked_sum(F.col(column)).alias("sum"), masked_mean(F.col(column)).alias("mean"), masked_var(F.col(column)).alias("variance"), F.max(chosen).alias("max"), F.min(chosen).alias("min"))


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_losses(df: DataFrame, column: str, scale: float | None = None) -> DataFrame:
    """One row with a column for each of LOSS_MODES; samples without a counted token don't count in the means over samples.

    The last is the sum over samples / ``scale``, which is the longest sample's length where it isn't given. One pass over the tokens
    gives a row a sample, from which all modes follow.
    """
    seqs = df.groupBy("sample_id").agg(masked_sum(F.col(column)).alias("s"), F.sum("mask").alias("n"), F.count(F.lit(1)).alias("length"))
    counted = lambda v: F.avg(F.when(F.col("n") > 0, v))
    values = (F.sum("s") / F.sum("n"), counted(F.col("s")), counted(F.col("s") / (F.col("n") + 1e-8)), F.sum("s") / (F.lit(scale) if scale is not None else F.max("length")))
    return seqs.agg(*[v.alias(mode) for mode, v in zip(LOSS_MODES, values, strict=True)])


def aggregate_loss(df: DataFrame, column: str, mode: str, scale: float | None = None) -> DataFrame:
    """One row (loss) by one of LOSS_MODES."""
    if mode not in LOSS_MODES:
        raise ValueError(f"unknown mode {mode}")
    return aggregate_losses(df, column, scale).select(F.col(f"`{mode}`").alias("loss"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """k1 (difference), abs, k2 (half its square), k3 (exp(d) - d - 1 with d = ref - logp within 20, the result within 10)."""
    if kind in ("kl", "k1"):
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (logp - ref) ** 2
    if kind in ("low_var_kl", "k3"):
        d = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(d) - d - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind}")


def penalised_rewards(df: DataFrame, beta: float, kind: str = "k1") -> DataFrame:
    """Token rewards minus beta times the masked KL estimate, in column ``reward``; the estimate is in ``kl``."""
    kl = kl_estimate(F.col("old_logp"), F.col("ref_logp"), kind) * F.col("mask")
    return df.withColumn("kl", kl).withColumn("reward", F.col("reward") - beta * F.col("kl"))


def mean_kl(df: DataFrame) -> DataFrame:
    """One row (mean_kl): per-sample masked means of ``kl``, then their mean."""
    return df.groupBy("sample_id").agg(masked_mean(F.col("kl")).alias("k")).agg(F.avg("k").alias("mean_kl"))


def log_ratio() -> Column:
    return F.col("old_logp") - F.col("rollout_logp")


def _level_log_ratio(level: str) -> Column:
    counted = F.when(F.col("mask") != 0, log_ratio()).otherwise(0.0)
    if level == "token":
        return log_ratio()
    if level == "sequence":
        return F.sum(counted).over(by_sample())
    if level == "geometric":
        return F.sum(counted).over(by_sample()) / (F.sum("mask").over(by_sample()) + 1e-8)
    raise ValueError(f"unknown level {level}")


def importance_weights(df: DataFrame, level: str = "token", cap: float = 2.0, normalise: bool = False) -> DataFrame:
    """``raw_weight`` exp(log ratio within 20) times the mask, and ``weight``: that capped, over its mean where ``normalise``."""
    df = df.withColumn("raw_weight", F.exp(clamp(_level_log_ratio(level), -SAFETY_BOUND, SAFETY_BOUND)) * F.col("mask"))
    df = df.withColumn("weight", F.least(F.col("raw_weight"), F.lit(cap)))
    if not normalise:
        return df
    if level == "token":
        mean = df.agg(masked_mean(F.col("weight")).alias("_m"))
    else:
        seqs = df.groupBy("sample_id").agg(masked_mean(F.col("weight")).alias("w"), F.sum("mask").alias("n"))
        mean = seqs.agg(F.avg(F.when(F.col("n") > 0, F.col("w"))).alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("weight", F.when(F.col("_m") > 1e-8, F.col("weight") / F.col("_m")).otherwise(F.col("weight"))).drop("_m")


def rejection_mask(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """``accepted`` (0/1) for weights between the thresholds, and ``new_mask`` = mask x accepted."""
    weight = F.exp(clamp(_level_log_ratio(level), -SAFETY_BOUND, SAFETY_BOUND))
    inside = weight.between(F.lit(1 / upper if lower is None else lower), F.lit(upper))
    return df.withColumn("accepted", inside.cast("int")).withColumn("new_mask", F.col("mask") * F.col("accepted"))


def rejected_fractions(df: DataFrame) -> DataFrame:
    """One row (token_fraction, sequence_fraction): counted tokens rejected, and samples with at least one of them."""
    seqs = df.groupBy("sample_id").agg(F.sum(F.col("mask") * (1 - F.col("accepted"))).alias("bad"), F.sum("mask").alias("n"))
    return seqs.agg((F.sum("bad") / (F.sum("n") + 1e-8)).alias("token_fraction"), F.avg((F.col("bad") > 0).cast("double")).alias("sequence_fraction"))


def weight_diagnostics(df: DataFrame, cap: float = 2.0) -> DataFrame:
    """One row of ``raw_weight`` over counted tokens: mean, std, max, min, shares above ``cap`` and below 1 / cap, effective
    sample size 1 / mean((w / mean)^2) of weights within the thresholds, and mean/std/max/min of per-sample means."""
    w = F.when(F.col("mask") != 0, F.col("raw_weight"))
    inside = clamp(F.col("raw_weight"), 1 / cap, cap)
    tokens = df.agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.max(w).alias("max"), F.min(w).alias("min"), F.avg((w > cap).cast("double")).alias("high"), F.avg((w < 1 / cap).cast("double")).alias("low"),
        (F.avg(F.when(w.isNotNull(), inside)) ** 2 / F.avg(F.when(w.isNotNull(), inside**2))).alias("ess"))
    seqs = df.groupBy("sample_id").agg(masked_mean(F.col("raw_weight")).alias("w"))
    per_seq = seqs.agg(F.avg("w").alias("seq_mean"), F.stddev_samp("w").alias("seq_std"), F.max("w").alias("seq_max"), F.min("w").alias("seq_min"))
    return tokens.crossJoin(F.broadcast(per_seq))


def veto(df: DataFrame, threshold: float) -> DataFrame:
    """``new_mask`` 0 for whole samples that have a counted token with a ratio under ``threshold``."""
    bad = (log_ratio() < F.log(F.lit(threshold))) & (F.col("mask") != 0)
    return df.withColumn("vetoed", F.coalesce(F.bool_or(bad).over(by_sample()), F.lit(False))).withColumn("new_mask", F.when(F.col("vetoed"), 0).otherwise(F.col("mask")))


def off_policy(df: DataFrame) -> DataFrame:
    """One row: perplexities of both policies, KL, k3, differences and ratio of log-perplexities, chi-square by token and sequence."""
    lr = log_ratio()
    seqs = df.groupBy("sample_id").agg(masked_mean(F.col("old_logp")).alias("t"), masked_mean(F.col("rollout_logp")).alias("r"), masked_sum(lr).alias("lr"), F.sum("mask").alias("n"),
        masked_sum(-lr).alias("kl"), masked_sum(F.exp(lr) - lr - 1).alias("k3"), masked_sum(F.exp(2 * clamp(lr, -SAFETY_BOUND, SAFETY_BOUND))).alias("sq"))
    diff = F.col("r") - F.col("t")
    tokens = F.sum("n") + 1e-8
    return seqs.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"), (F.sum("kl") / tokens).alias("kl"), (F.sum("k3") / tokens).alias("k3_kl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"), F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"), F.avg(F.exp(diff)).alias("ppl_ratio"), (F.sum("sq") / tokens - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clamp(F.col("lr"), -SAFETY_BOUND, SAFETY_BOUND))) - 1).alias("chi2_seq"))


def clip_diagnostics(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """One row (clip_fraction, lower_clip_fraction, approx_kl) of the clipped policy objective with advantages in ``advantage``."""
    kl = clamp(F.col("old_logp") - F.col("rollout_logp"), -20.0, 20.0)
    ratio, adv = F.exp(kl), F.col("advantage")
    plain, clipped = -adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high)
    worst = F.greatest(plain, clipped)
    lower = (worst > -adv * dual) & (adv < 0)
    return df.agg(masked_mean((clipped > plain).cast("double")).alias("clip_fraction"), masked_mean(lower.cast("double")).alias("lower_clip_fraction"), masked_mean(-kl).alias("approx_kl"))


def probability_difference(df: DataFrame) -> DataFrame:
    """One row: max, mean and sample std of |p - q| over counted tokens, and the correlation of p and q."""
    from gradeloom.operators.ranking import pearson

    pq = df.filter("mask <> 0").select(F.exp("old_logp").alias("p"), F.exp("rollout_logp").alias("q"))
    d = F.abs(F.col("p") - F.col("q"))
    return pq.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), pearson("p", "q").alias("pearson"))


def differing_tokens(df: DataFrame, a: str, b: str) -> DataFrame:
    """(sample_id, n): counted tokens that differ between two columns, null-safe."""
    return df.groupBy("sample_id").agg(F.count(F.when((F.col("mask") != 0) & ~F.col(a).eqNullSafe(F.col(b)), 1)).alias("n"))


# ---- recurrences and masks along a sample


#: Places of a sample whose tokens are one array, and tokens of a chunk of it.
BLOCK, CHUNK = 1 << 16, 64


def _blocks(df: DataFrame, *columns: str) -> DataFrame:
    """(sample_id, block, tokens): a sample's tokens by blocks of ``pos``, the last token first, so that a long sample isn't one row."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    return df.groupBy("sample_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *columns)), asc=False).alias("tokens"))


def _affine(df: DataFrame, a, b, out: str) -> DataFrame:
    """``out``: for each token of ``tokens`` the value x that comes to it from behind, where token t turns x into a(t) x + b(t) and a sample begins with 0.

    Maps compose to maps. A chunk's map is the fold of its tokens', those of the chunks behind are composed by doubling, and a block's map stands for it where other blocks go
    on; then each chunk is gone through from what comes in. So no array grows with a sample, and a sample of one chunk is one plain recurrence.
    """
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / CHUNK).cast("int")), lambda k: F.slice(F.col("tokens"), k * CHUNK + 1, CHUNK))
    line = lambda x, y: F.struct(x.cast("double").alias("a"), y.cast("double").alias("b"))
    both = lambda later, m: line(m["a"] * later["a"], m["a"] * later["b"] + m["b"])
    rows = df.withColumn("_chunks", chunk)
    maps = F.transform("_chunks", lambda c: F.aggregate(c, line(F.lit(1.0), F.lit(0.0)), lambda acc, t: line(a(t) * acc["a"], a(t) * acc["b"] + b(t))))
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range((BLOCK // CHUNK).bit_length())]), lambda s: s < F.size("_chunks"))
    composed = F.aggregate(strides, maps, lambda acc, s: F.transform(acc, lambda m, i: F.when(i >= s, both(F.get(acc, i - s), m)).otherwise(m)))
    rows = rows.withColumn("_maps", composed)
    behind = F.collect_list(F.element_at("_maps", -1)).over(by_sample().orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.aggregate(behind, F.lit(0.0), lambda x, m: m["a"] * x + m["b"]))
    into = F.transform("_maps", lambda m, i: F.when(i == 0, F.col("_in")).otherwise(F.get(F.col("_maps"), i - 1)["a"] * F.col("_in") + F.get(F.col("_maps"), i - 1)["b"]))
    state = lambda x, xs: F.struct(x.cast("double").alias("x"), xs.cast("array<double>").alias("xs"))
    along = lambda c, x: F.aggregate(c, state(x, F.array()), lambda acc, t: state(a(t) * acc["x"] + b(t), F.array_append(acc["xs"], acc["x"])), lambda acc: acc["xs"])
    return rows.withColumn(out, F.flatten(F.zip_with("_chunks", into, along))).drop("_chunks", "_maps", "_in")


def discounted_returns(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(sample_id, pos, mask, returns): running return from the end, set back to 0 behind each token that doesn't count.

    An affine scan: the work grows with the tokens, and a long sample is split over blocks.
    """
    scanned = _affine(_blocks(df, "mask", "reward"), lambda t: t["mask"] * gamma, lambda t: t["mask"] * t["reward"], "behind")
    each = scanned.select("sample_id", F.explode(F.arrays_zip("tokens", "behind")).alias("t"))
    return each.select("sample_id", "t.tokens.pos", "t.tokens.mask", (F.col("t.tokens.reward") + gamma * F.col("t.behind")).alias("returns"))


def remax(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """``returns`` (masked rewards summed from the token to the end) and ``advantage`` = (returns - baseline) x mask."""
    back = by_sample().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    returns = F.sum(F.col("reward") * F.col("mask")).over(back)
    return df.withColumn("returns", returns).withColumn("advantage", (returns - F.col(baseline)) * F.col("mask"))


def gae(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """(sample_id, pos, mask, gae, returns): generalised advantage estimation; tokens that don't count are skipped.

    Two affine scans, of the next counted value and of the estimate itself. Whiten ``gae`` for the advantage.
    """
    counts = lambda t: t["mask"] != 0
    blocks = _affine(_blocks(df, "mask", "reward", "value"), lambda t: F.when(counts(t), 0.0).otherwise(1.0), lambda t: F.when(counts(t), t["value"]).otherwise(0.0), "next_value")
    own = F.zip_with("tokens", "next_value", lambda t, v: F.struct(t["pos"].alias("pos"), t["mask"].alias("mask"), t["value"].alias("value"), (t["reward"] + gamma * v - t["value"]).alias("delta")))
    blocks = blocks.select("sample_id", "block", own.alias("tokens"))
    scanned = _affine(blocks, lambda t: F.when(counts(t), gamma * lam).otherwise(1.0), lambda t: F.when(counts(t), t["delta"]).otherwise(0.0), "last")
    each = scanned.select("sample_id", F.explode(F.arrays_zip("tokens", "last")).alias("t")).select("sample_id", "t.tokens.*", "t.last")
    here = F.when(F.col("mask") != 0, F.col("delta") + gamma * lam * F.col("last")).otherwise(F.col("last"))
    return each.select("sample_id", "pos", "mask", here.alias("gae"), (here + F.col("value")).alias("returns"))


def response_mask(df: DataFrame, token: str, end: Column) -> DataFrame:
    """``response_mask`` 1 up to and with the first end token of each sample."""
    is_end = (F.col(token) == end).cast("int")
    upto = F.sum(is_end).over(by_sample().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("response_mask", (upto - is_end == 0).cast("int"))


def position_ids(df: DataFrame) -> DataFrame:
    """``position_id``: running count of counted tokens, from 0."""
    running = F.sum("mask").over(by_sample().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("position_id", F.greatest(running - 1, F.lit(0)))


def overlong_penalty(length: Column, expected: float, buffer: float, factor: float) -> Column:
    """0 up to ``expected``, then falling by factor / buffer a token."""
    return F.least(-(length - expected) / buffer * factor, F.lit(0.0))


def place_score(df: DataFrame, score: str, where: str = "last") -> DataFrame:
    """``token_score``: the sample's score on its last counted token, or on all of them."""
    if where == "all":
        return df.withColumn("token_score", F.when(F.col("mask") != 0, F.col(score)).otherwise(0.0))
    last = F.max(F.when(F.col("mask") != 0, F.col("pos"))).over(by_sample())
    return df.withColumn("token_score", F.when(F.col("pos") == last, F.col(score)).otherwise(0.0))


def top_covariance(df: DataFrame, share: float) -> DataFrame:
    """The ``share`` of counted tokens (one at least) with the largest (advantage - mean) (log-prob - mean): (sample_id, pos, cov)."""
    counted = df.filter("mask <> 0")
    means = counted.agg(F.avg("advantage").alias("_a"), F.avg("old_logp").alias("_l"), F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("_k")).first()
    cov = counted.select("sample_id", "pos", ((F.col("advantage") - F.lit(means["_a"])) * (F.col("old_logp") - F.lit(means["_l"]))).alias("cov"))
    # NaN first and null last, as in a descending order
    kind = F.when(F.col("cov").isNull(), 2).when(F.isnan("cov"), 0).otherwise(1)
    order = [kind, F.when(kind == 1, -F.round("cov", 9)), F.col("sample_id")]
    # buckets go without ``pos``, so that a place that is worked out is worked out for the last step alone
    return first_rows(cov, [*order, "pos"], range_bucket(cov, order), int(means["_k"]))


def covariance_band(df: DataFrame, low: float, high: float, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` counted tokens whose covariance product lies in a band, chosen by hash order."""
    counted = df.filter("mask <> 0")
    means = counted.agg(F.avg("advantage").alias("_a"), F.avg("old_logp").alias("_l"))
    cov = counted.crossJoin(F.broadcast(means)).select("sample_id", "pos", ((F.col("advantage") - F.col("_a")) * (F.col("old_logp") - F.col("_l"))).alias("cov"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "sample_id", "pos"))
    return cov.filter(F.col("cov").between(low, high)).orderBy(order, "sample_id", "pos").limit(n)
