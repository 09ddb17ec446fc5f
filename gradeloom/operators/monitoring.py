"""Run monitoring: per-step statistics, text-log metrics, smoothing, thresholds, validation metrics and costs."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as x
from gradeloom.operators.order import BLOCK_ROWS, framed, last_known, number_within


def share(condition: Column) -> Column:
    """Aggregate: share of rows for which a condition holds; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def rollout_quality(df: DataFrame, text: str = "rubric", reward: str = "reward") -> DataFrame:
    """(step, n, mean_reward, mean_criteria, extreme, non_ascii, filler, garbage, min_points, max_points) from (step, rubric, reward).

    Extreme: criteria of 8 points or more either way. Filler: rubrics with an empty opening. Garbage: without any criterion.
    """
    lines = x.lines(text)
    scored = F.filter(lines, lambda v: F.trim(v).rlike(x.SCORED_LINE))
    points = F.transform(scored, lambda v: F.regexp_extract(v, r"([+-]?\d+)", 1).try_cast("int"))
    body = F.transform(scored, lambda v: F.trim(F.regexp_replace(v, r"^-\s*\[?\s*[+-]?\d+\s*\]?\s*", "")))
    each = df.select("step", F.col(reward).alias("r"), F.col(text).alias("t"), points.alias("p"), body.alias("b"))
    return each.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_reward"), F.avg(F.size("p")).alias("mean_criteria"),
        F.try_divide(F.sum(F.size(F.filter("p", lambda v: F.abs(v) >= 8))), F.sum(F.size("p"))).alias("extreme"), share(x.non_ascii(F.col("t"))).alias("non_ascii"),
        share(F.exists("b", x.has_filler)).alias("filler"), share(F.size("p") == 0).alias("garbage"), F.min(F.array_min("p")).alias("min_points"), F.max(F.array_max("p")).alias("max_points"))


def top_values(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """(by, value, count, rank): the ``n`` most frequent values of each group; ties by value."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), value))).filter(F.col("rank") <= n)


def leader_sizes(sets, threshold: float) -> list[int]:
    """Sizes of the clusters of sets in the order of arrival: each joins the first cluster whose first member's Jaccard with it reaches the threshold, or opens one.

    A prefix index finds the clusters to compare. With the elements of every set in one order, rarest first, two sets that reach the threshold share an element among the
    first n - ceil(threshold n) + 1 of each (n: its size), and their sizes are within the threshold of each other; so only leaders that do both are compared.
    An empty set is like no other. The threshold is above 0.
    """
    sets = [frozenset(s) for s in sets]
    counts = Counter(x for s in sets for x in s)
    leaders, sizes, index = [], [], {}
    for own in sets:
        least = math.ceil(threshold * len(own) - 1e-9)
        prefix = heapq.nsmallest(len(own) - least + 1, own, key=lambda x: (counts[x], x)) if own else []
        found = sorted({k for x in prefix for k in index.get(x, ()) if least <= len(leaders[k]) and threshold * len(leaders[k]) <= len(own) + 1e-9})
        home = next((k for k in found if (both := len(own & leaders[k])) / (len(own) + len(leaders[k]) - both) >= threshold), None)
        if home is not None:
            sizes[home] += 1
            continue
        for x in prefix:
            index.setdefault(x, []).append(len(leaders))
        leaders.append(own)
        sizes.append(1)
    return sizes


def collapse_rate(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(step, q, n, collapse): share of the largest cluster of a question's rollouts by keyword sets (``leader_sizes``, in the order of ``rollout``).

    Clusters depend on the order, so a question's rollouts are one group; the prefix index keeps tens of thousands of them a matter of seconds.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = leader_sizes(pdf.sort_values("rollout")["words"], threshold)
        return pd.DataFrame({"step": [pdf["step"].iloc[0]], "q": [pdf["q"].iloc[0]], "n": [len(pdf)], "collapse": [max(sizes) / len(pdf)]})

    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("step", "q", "rollout", "words").groupBy("step", "q").applyInPandas(run, f"step {t['step']}, q {t['q']}, n long, collapse double")


#: Lengths that share a slice in ``length_profile``.
SLICE = 1024


def length_profile(df: DataFrame, length: str, by: str = "step") -> DataFrame:
    """(by, n, upper_median, max, over_200, over_500); the upper median is the value at place floor(n / 2) from 0, nulls first.

    Selection by counting: rows are counted by length before they are shuffled, counts by slice of ``SLICE`` lengths name the slice that holds the place, and the counts in that slice
    the length. A hot step is as many rows as it has lengths, and no window holds more than its slices or a slice.
    """
    counts = df.groupBy(F.col(by).alias("_by"), F.floor(F.col(length) / SLICE).alias("_slice"), F.col(length).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    over = lambda limit: F.sum(F.when(F.col("_v") > limit, F.col("_c")).otherwise(0))
    slices = counts.groupBy("_by", "_slice").agg(F.sum("_c").alias("_c"), F.max("_v").alias("_max"), over(200).alias("_200"), over(500).alias("_500"))
    step = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_c").over(step.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = [F.sum("_c").over(step).alias("n"), F.max("_max").over(step).alias("max"), F.sum("_200").over(step).alias("_200"), F.sum("_500").over(step).alias("_500")]
    found = slices.select("_by", "_slice", "_c", before.alias("_before"), *totals).filter((F.col("_before") <= F.floor(F.col("n") / 2)) & (F.floor(F.col("n") / 2) < F.col("_before") + F.col("_c")))
    found = found.select(F.col("_by").alias(by), F.col("_slice").alias("_s"), "_before", "n", "max", (F.col("_200") / F.col("n")).alias("over_200"), (F.col("_500") / F.col("n")).alias("over_500"))
    inside = counts.join(found, F.col("_by").eqNullSafe(F.col(by)) & F.col("_slice").eqNullSafe(F.col("_s")))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_by").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = inside.withColumn("_upto", upto).filter((F.col("_upto") > F.floor(F.col("n") / 2)) & (F.col("_upto") - F.col("_c") <= F.floor(F.col("n") / 2)))
    return at.select(by, "n", F.col("_v").alias("upper_median"), "max", "over_200", "over_500")


def text_lengths(df: DataFrame, text: str, marker: str, by: str = "step") -> DataFrame:
    """(by, mean, min, max, markers): character lengths and the number of times a pattern occurs."""
    n = F.length(text)
    return df.groupBy(by).agg(F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(F.regexp_count(F.col(text), F.lit(marker))).alias("markers"))


def topic_specificity(df: DataFrame, question: str, rubric: str) -> DataFrame:
    """One row (criteria, questions): share of criteria that name a word of their question, and of questions with such a criterion."""
    words = x.keywords(question)
    # numbered before the criteria are exploded, or each criterion would be a question
    asked = df.select(F.monotonically_increasing_id().alias("_id"), words.alias("w"), F.col(rubric).alias("_rubric"))
    each = asked.select("_id", "w", F.explode_outer(x.parse_rubric("_rubric")).alias("c"))
    hit = F.exists("w", lambda w: F.contains(F.lower(F.col("c.text")), w))
    by_question = each.groupBy("_id").agg(F.count("c").alias("n"), F.count(F.when(hit, 1)).alias("hits"))
    return by_question.agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("criteria"), share(F.col("hits") > 0).alias("questions"))


def flag_rates(df: DataFrame, text: str, template: str, generic: str, by: str = "step") -> DataFrame:
    """(by, total, template, generic, clean): rows that match two patterns; clean = total - the larger of the two."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(text).rlike(template), 1)).alias("template"), F.count(F.when(F.col(text).rlike(generic), 1)).alias("generic"))
    return out.withColumn("clean", F.col("total") - F.greatest("template", "generic"))


def log_metrics(lines: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """``lines`` (log, line_no, line) with a double column for each pattern's first group, null where it isn't in the line."""
    return lines.select("log", "line_no", *[F.regexp_extract("line", p, 1).try_cast("double").alias(name) for name, p in patterns.items()])


def flagged_per_step(lines: DataFrame, flag: str, rule: str, step: str = "step") -> DataFrame:
    """(step, total, flagged, by_rule, rest): flagged lines of each step (forward-filled), and the part that no rule flagged, at least 0."""
    filled = last_known(lines, step, "log", "line_no", "_s")
    out = filled.filter("_s is not null").groupBy(F.col("_s").alias(step)).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(flag), 1)).alias("flagged"), F.count(F.when(F.col(rule), 1)).alias("by_rule"))
    return out.withColumn("rest", F.greatest(F.col("flagged") - F.col("by_rule"), F.lit(0)))


def chunk_by_count(df: DataFrame, size: int, order: Sequence[str], by: str) -> DataFrame:
    """``chunk`` of ``size`` rows in order, inside each log."""
    return number_within(df, by, order, "_k").withColumn("chunk", F.floor(F.col("_k") / size)).drop("_k")


def moving_average(df: DataFrame, value: str, order: Sequence[str], by: str, n: int = 10, rows: int = BLOCK_ROWS) -> DataFrame:
    """``average`` of the last ``n`` rows, full windows only. A log of more than ``rows`` rows is averaged block by block, each with the n - 1 rows before it."""
    placed = framed(df, by, order, n - 1, rows)
    last = Window.partitionBy(by, "_block").orderBy("_k").rowsBetween(1 - n, 0)
    return placed.withColumn("average", F.avg(value).over(last)).filter(~F.col("_copy") & (F.col("_k") >= n - 1)).drop("_k", "_block", "_copy")


def crossings(df: DataFrame, value: str, threshold: float, order: Sequence[str], by: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """The first row of each run at which the value goes from below the threshold to it or above. A log of more than ``rows`` rows is searched block by block, each with the row before it."""
    placed = framed(df, by, order, 1, rows)
    was = F.lag(value).over(Window.partitionBy(by, "_block").orderBy("_k"))
    crossed = placed.withColumn("_was", was).filter(~F.col("_copy") & (F.col("_was") < threshold) & (F.col(value) >= threshold))
    return crossed.groupBy(F.col(by).alias("_by")).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), "_k").alias("_row")).select("_row.*")


def smooth_factor(df: DataFrame, value: str, order: str, by: str, keep: float = 0.9, start: float = 1.0, low: float = 0.1) -> DataFrame:
    """(by, order, ema, factor): exponential mean from ``start`` and low + (1 - low) ema, never falling (from ``low``).

    The mean is a weighted prefix sum within blocks of steps, so long that what comes in from two blocks ahead is below the precision of a double;
    the sums of a block and of the one ahead of it are added up.
    """
    size = max(1, math.ceil(40 / -math.log(keep)))
    runs = Window.partitionBy(by).orderBy(order)
    placed = df.select(by, order, F.col(value).cast("double").alias("_v"), F.row_number().over(runs).alias("_k"))
    placed = placed.withColumn("_block", F.floor((F.col("_k") - 1) / size)).withColumn("_i", (F.col("_k") - 1) % size)
    upto = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum((1 - keep) * F.col("_v") * F.pow(F.lit(keep), -F.col("_i"))).over(upto) * F.pow(F.lit(keep), F.col("_i"))
    placed = placed.withColumn("_own", own)
    ends = placed.filter(F.col("_i") == size - 1).select(F.col(by).alias("_by"), (F.col("_block") + 1).alias("_next"), F.col("_own").alias("_carry"))
    placed = placed.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_next")), "left")
    ema = F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i") + 1) + start * F.pow(F.lit(keep), F.col("_k"))
    out = placed.select(by, order, ema.alias("ema"))
    return out.withColumn("factor", F.greatest(F.max(low + (1 - low) * F.col("ema")).over(runs.rowsBetween(Window.unboundedPreceding, 0)), F.lit(low)))


def adaptive_kl(df: DataFrame, kl: str, order: str, by: str, target: float, horizon: float, n_steps: str, start: float) -> DataFrame:
    """``beta`` before each batch: a running product of 1 + clip(kl / target - 1, +-0.2) n_steps / horizon."""
    factor = 1 + F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2)) * F.col(n_steps) / horizon
    past = F.sum(F.log(factor)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("beta", start * F.exp(F.coalesce(past, F.lit(0.0))))


def entropy_schedule(step: Column, start: float, end: float, total: int) -> Column:
    return start + (end - start) * F.least(F.greatest(step / float(total), F.lit(0.0)), F.lit(1.0))


def time_remaining(df: DataFrame, seconds: str, step: str, total: int, by: str) -> DataFrame:
    """``mean_seconds`` of the last 5 steps and ``remaining`` = steps left times that."""
    w = Window.partitionBy(by).orderBy(step).rowsBetween(-4, 0)
    return df.withColumn("mean_seconds", F.avg(seconds).over(w)).withColumn("remaining", (total - F.col(step)) * F.col("mean_seconds"))


def duplicate_profile(df: DataFrame, by: str = "step") -> DataFrame:
    """(by, mean_unique, two_or_less, mean_weight) from (n_unique, weight)."""
    return df.groupBy(by).agg(F.avg("n_unique").alias("mean_unique"), share(F.col("n_unique") <= 2).alias("two_or_less"), F.avg("weight").alias("mean_weight"))


def composite_ranking(df: DataFrame, terms: Mapping[str, float], key: str) -> DataFrame:
    """``composite`` = weighted sum of columns, and ``rank`` by it at nine places, ties by key; for a table with a row a step."""
    total = sum((F.col(c) * w for c, w in terms.items()), F.lit(0.0))
    return df.withColumn("composite", total).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("composite", 9)), key)))


# ---- validation metrics and batches


def validation_means(df: DataFrame) -> DataFrame:
    """(source, n_prompts, mean, std): per prompt the mean and population std of ``value``, then means over prompts."""
    each = df.groupBy("source", "prompt").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("n_prompts"), F.avg("m").alias("mean"), F.avg("s").alias("std"))


def best_of_n(df: DataFrame, n: int) -> DataFrame:
    """(source, prompt, best, worst, best_std): expected largest and smallest of ``n`` draws with replacement from a prompt's values.

    In closed form: the value at place i of N is the largest with probability (i/N)^n - ((i-1)/N)^n.
    """
    w = Window.partitionBy("source", "prompt")
    r = df.withColumn("i", F.row_number().over(w.orderBy("value"))).withColumn("N", F.count(F.lit(1)).over(w))
    up = F.pow(F.col("i") / F.col("N"), n) - F.pow((F.col("i") - 1) / F.col("N"), n)
    down = F.pow((F.col("N") - F.col("i") + 1) / F.col("N"), n) - F.pow((F.col("N") - F.col("i")) / F.col("N"), n)
    out = r.groupBy("source", "prompt").agg(F.sum(F.col("value") * up).alias("best"), F.sum(F.col("value") * down).alias("worst"), F.sum(F.col("value") ** 2 * up).alias("_q"))
    return out.withColumn("best_std", F.sqrt(F.greatest(F.col("_q") - F.col("best") ** 2, F.lit(0.0)))).drop("_q")


def majority_vote(df: DataFrame) -> DataFrame:
    """(source, prompt, vote, value): the most common vote, ties to the one seen first, with its first value."""
    votes = df.groupBy("source", "prompt", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min_by("value", "ord").alias("value"))
    best = F.row_number().over(Window.partitionBy("source", "prompt").orderBy(F.desc("n"), "first"))
    return votes.withColumn("_r", best).filter("_r = 1").select("source", "prompt", "vote", "value")


def majority_of_n(df: DataFrame, n: int) -> DataFrame:
    """(source, prompt, maj): expected value of the majority of ``n`` votes drawn with replacement from a prompt's; a tie goes to the one drawn first.

    Exact, without draws. For each number k that the winner may have, a programme over the prompt's distinct votes adds up the chances that some vote is drawn k times, all others
    k times or less and t of them just k times; equal counts are drawn in any order alike, so the winner is first with chance 1 / (t + 1). A vote counts with its first
    value. The work grows with the distinct votes of a prompt (times n^3).
    """
    votes = df.groupBy("source", "prompt", "vote").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ord").cast("double").alias("value"))
    share_of = F.col("n") / F.sum("n").over(Window.partitionBy("source", "prompt"))
    # the chances of a vote for each number of draws, but for the n! orders of all
    chances = F.array(*[F.pow(share_of, j) / math.factorial(j) for j in range(n + 1)])
    each = votes.withColumn("w", chances).groupBy("source", "prompt").agg(F.collect_list(F.struct("value", "w")).alias("votes"))

    def won_with(k: int) -> Column:
        ties = n // k  # others that have k too are fewer
        places = [(u, t, f) for u in range(n + 1) for t in range(ties) for f in (0, 1)]  # draws given, others with k, winner chosen or not
        at = {place: i for i, place in enumerate(places)}

        def step(acc: Column, vote: Column) -> Column:
            def chance(u: int, t: int, f: int) -> Column:
                parts = [acc[at[u - j, t, f]] * vote["w"][j] for j in range(min(k - 1, u) + 1)]
                if u >= k and t:
                    parts.append(acc[at[u - k, t - 1, f]] * vote["w"][k])
                if u >= k and f:
                    parts.append(acc[at[u - k, t, 0]] * vote["w"][k] * vote["value"])
                return sum(parts[1:], parts[0])

            return F.array(*[chance(*place) for place in places])

        start = F.array(*[F.lit(1.0 if place == (0, 0, 0) else 0.0) for place in places])
        return F.aggregate("votes", start, step, lambda acc: sum((acc[at[n, t, 1]] / (t + 1) for t in range(1, ties)), acc[at[n, 0, 1]] * 1.0) * float(math.factorial(n)))

    return each.select("source", "prompt", sum((won_with(k) for k in range(2, n + 1)), won_with(1)).alias("maj"))


def reduce_by_name(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): the maximum of metrics whose name holds max, the minimum of those with min, else the mean."""
    reduced = F.when(F.contains(F.first(name), F.lit("max")), F.max(value)).when(F.contains(F.first(name), F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(reduced.alias(value))


def batch_statistics(df: DataFrame, columns: Sequence[str], max_length: int | None = None, length: str = "length") -> DataFrame:
    """One row with mean, max and min of each column, the clip ratio (rows at ``max_length``) and the aborted ratio (length 0)."""
    stats = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    more = [share(F.col(length) == 0).alias("aborted_ratio")] + ([share(F.col(length) >= max_length).alias("clip_ratio")] if max_length is not None else [])
    return df.agg(*stats, *more)


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def throughput(df: DataFrame, tokens: str, seconds: str, workers: int = 1) -> DataFrame:
    """One row (tokens, seconds, ms_per_token, tokens_per_second a worker)."""
    out = df.agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))
    return out.withColumn("ms_per_token", F.try_divide(F.col("seconds") * 1000, "tokens")).withColumn("tokens_per_second", F.try_divide("tokens", F.col("seconds") * workers))


def metric_sections(df: DataFrame, core: str) -> DataFrame:
    """``section``: core for the core variable's mean@N and best@N (and maj@N) with the source's largest N, else aux."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).try_cast("int")
    largest = F.max(n).over(Window.partitionBy("source", "variable"))
    is_core = (F.col("variable") == core) & F.col("metric").rlike("^(mean|maj|best)@") & (n == largest)
    return df.withColumn("section", F.when(F.coalesce(is_core, F.lit(False)), "core").otherwise("aux"))


def usage_costs(calls: DataFrame, prices: DataFrame, prompts: int, extrapolate: int) -> DataFrame:
    """(model, calls, tokens_in, tokens_out, cost, cost_per_prompt, projected) from token counts and prices a million tokens.

    ``prices`` has a row a model; a model without a price costs null.
    """
    sums = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    out = sums.join(prices, "model", "left").withColumn("cost", cost).withColumn("cost_per_prompt", F.col("cost") / prompts)
    return out.withColumn("projected", F.col("cost_per_prompt") * extrapolate).drop("price_in", "price_out")
