"""Monitoring and validation queries over events, documents, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import monitoring as m
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table
from gradeloom.plans.rubrics import RUBRICS, STOP, WORDS, rubrics


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def steps(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("step", F.floor(F.col("doc_id") / 50))


@query(r"""WITH l AS (SELECT doc_id, doc_id // 50 AS step, n_chars, text, list_transform(list_filter(string_split(text, chr(10)), lambda v: trim(v) <> ''), lambda v: '- [' || CASE WHEN length(v) % 2 = 0 THEN '+' ELSE '-' END || length(v) % 10 || '] ' || v) AS b FROM documents),
    p AS (SELECT *, list_transform(b, lambda v: regexp_extract(v, '([+-]?\d+)', 1)::int) AS p FROM l)
    SELECT step, count(*) AS n, round(avg(n_chars), 4) AS mean_reward, round(avg(len(p)), 4) AS mean_criteria, round(sum(len(list_filter(p, lambda v: abs(v) >= 8))) / sum(len(p)), 4) AS extreme,
        round(avg(regexp_matches(text, '[^\x00-\x7f]')::int), 4) AS non_ascii, round(avg((len(p) = 0)::int), 4) AS garbage, min(list_min(p)) AS min_points, max(list_max(p)) AS max_points FROM p GROUP BY 1""")
def monitor_rollout_quality(spark, sf_dir):
    some = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    line = lambda v: F.concat(F.lit("- ["), F.when(F.length(v) % 2 == 0, "+").otherwise("-"), F.length(v) % 10, F.lit("] "), v)
    df = steps(spark, sf_dir).withColumn("rubric", F.array_join(F.transform(some, line), "\n"))
    return rounded(m.rollout_quality(df, "rubric", "n_chars").drop("filler"))


@query("SELECT lang, source, count(*) AS count, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::int AS rank FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) <= 3")
def monitor_top_values(spark, sf_dir):
    return m.top_values(table(spark, sf_dir, "documents"), "lang", "source", 3)


@query()
def monitor_collapse_rate(spark, sf_dir):
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    df = steps(spark, sf_dir).select("step", F.col("lang").alias("q"), F.col("doc_id").alias("rollout"), words.alias("words"))
    return rounded(m.collapse_rate(df))


@query("""WITH r AS (SELECT doc_id // 50 AS step, n_chars, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY doc_id // 50) AS n FROM documents)
    SELECT step, count(*) AS n, max(n_chars) FILTER (r = n // 2) AS upper_median, max(n_chars) AS max, round(avg((n_chars > 200)::int), 4) AS over_200, round(avg((n_chars > 500)::int), 4) AS over_500 FROM r GROUP BY 1""")
def monitor_length_profile(spark, sf_dir):
    return rounded(m.length_profile(steps(spark, sf_dir), "n_chars"))


@query("SELECT doc_id // 50 AS step, round(avg(length(text)), 4) AS mean, min(length(text))::int AS min, max(length(text))::int AS max, sum(len(string_split(text, '.')) - 1)::bigint AS markers FROM documents GROUP BY 1")
def monitor_text_lengths(spark, sf_dir):
    return rounded(m.text_lengths(steps(spark, sf_dir), "text", r"\."))


QUESTION_WORDS = WORDS.format(r"regexp_extract(text, '\S[^\r\n]*')", STOP)


@query(f"""WITH {RUBRICS}, g AS (SELECT *, sum(crit::int) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM c),
    t AS (SELECT doc_id, k, string_agg(CASE WHEN crit THEN body ELSE trim(line) END, chr(10) ORDER BY i) AS criterion FROM g WHERE k > 0 GROUP BY ALL),
    q AS (SELECT doc_id, {QUESTION_WORDS} AS w FROM documents),
    h AS (SELECT q.doc_id, count(k) AS n, count(*) FILTER (k IS NOT NULL AND len(list_filter(w, lambda v: contains(lower(criterion), v))) > 0) AS hits FROM q LEFT JOIN t USING (doc_id) GROUP BY 1)
    SELECT round(sum(hits) / sum(n), 4) AS criteria, round(avg((hits > 0)::int), 4) AS questions FROM h""")
def monitor_topic_specificity(spark, sf_dir):
    return rounded(m.topic_specificity(rubrics(spark, sf_dir).withColumn("question", F.regexp_extract("text", r"\S[^\r\n]*", 0)), "question", "rubric"))


@query("SELECT step, total, template, generic, total - greatest(template, generic) AS clean FROM (SELECT doc_id // 50 AS step, count(*) AS total, count(*) FILTER (contains(text, '|')) AS template, count(*) FILTER (contains(text, '!!')) AS generic FROM documents GROUP BY 1)")
def monitor_flag_rates(spark, sf_dir):
    return m.flag_rates(steps(spark, sf_dir), "text", r"\|", "!!")


# A training log made of events: every 50th line names a step, the others carry a metric.
LOG_SQL = "log AS (SELECT user_id % 7 AS log, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS line_no, event_id, event_type, value FROM events)"


def log_lines(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("log").orderBy("ts", "event_id"))
    e = events(spark, sf_dir).withColumn("log", F.col("user_id") % 7).withColumn("line_no", n)
    line = F.when(F.col("line_no") % 50 == 1, F.concat(F.lit("step:"), F.floor(F.col("line_no") / 50), F.lit(" - critic/score/mean:"), F.round(F.col("value"), 2).cast("decimal(12,2)"))).otherwise(F.concat(F.lit("[flag] kind="), "event_type"))
    return e.select("log", F.col("line_no").cast("long").alias("line_no"), line.alias("line"))


@query(f"WITH {LOG_SQL} SELECT log, line_no, CASE WHEN line_no % 50 = 1 THEN (line_no // 50)::double END AS step, CASE WHEN line_no % 50 = 1 THEN round(value, 2)::decimal(12,2)::double END AS score FROM log")
def monitor_log_metrics(spark, sf_dir):
    return m.log_metrics(log_lines(spark, sf_dir), {"step": r"step:(\d+)", "score": r"critic/score/mean:(-?[\d.]+)"})


@query(f"""WITH {LOG_SQL} SELECT (line_no - 1) // 50 AS step, count(*) AS total, count(*) FILTER (line_no % 50 <> 1 AND event_type <> 'view') AS flagged, count(*) FILTER (line_no % 50 <> 1 AND event_type = 'purchase') AS by_rule,
    greatest(count(*) FILTER (line_no % 50 <> 1 AND event_type <> 'view') - count(*) FILTER (line_no % 50 <> 1 AND event_type = 'purchase'), 0) AS rest FROM log GROUP BY 1""")
def monitor_flagged_per_step(spark, sf_dir):
    lines = log_lines(spark, sf_dir).withColumn("step", F.regexp_extract("line", r"step:(\d+)", 1).try_cast("long"))
    kind = F.regexp_extract("line", "kind=(.*)", 1)
    return m.flagged_per_step(lines.withColumn("flag", (kind != "") & (kind != "view")).withColumn("rule", kind == "purchase"), "flag", "rule")


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 64 AS chunk FROM events")
def monitor_chunks(spark, sf_dir):
    return m.chunk_by_count(events(spark, sf_dir), 64, ["ts", "event_id"], "event_type").select("event_id", "chunk")


@query("SELECT event_id, round(avg(value) OVER w, 4) AS average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 10")
def monitor_moving_average(spark, sf_dir):
    return rounded(m.moving_average(events(spark, sf_dir), "value", ["ts", "event_id"], "user_id").select("event_id", "average"))


@query("""WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
    SELECT user_id, event_id FROM l WHERE was < 50 AND value >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def monitor_crossings(spark, sf_dir):
    return m.crossings(events(spark, sf_dir), "value", 50.0, ["ts", "event_id"], "user_id").select("user_id", "event_id")


STEP_MEANS = "m AS (SELECT lang AS run, doc_id // 50 AS step, avg((n_chars > 800)::int) AS v, count(*) AS n FROM documents GROUP BY ALL)"


def step_means(spark, sf_dir):
    return steps(spark, sf_dir).groupBy(F.col("lang").alias("run"), "step").agg(F.avg((F.col("n_chars") > 800).cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {STEP_MEANS}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM m),
    r AS (SELECT run, step, k, 0.9::double + 0.1::double * v AS ema FROM k WHERE k = 1 UNION ALL SELECT k.run, k.step, k.k, 0.9::double * r.ema + 0.1::double * k.v FROM r JOIN k ON k.run = r.run AND k.k = r.k + 1)
    SELECT run, step, round(ema, 5) AS ema, round(greatest(max(0.1::double + 0.9::double * ema) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0.1), 5) AS factor FROM r""")
def monitor_smooth_factor(spark, sf_dir):
    return rounded(m.smooth_factor(step_means(spark, sf_dir), "v", "step", "run"), 5)


@query(f"""WITH {STEP_MEANS}, f AS (SELECT *, ln(1 + greatest(least(v / 0.5 - 1, 0.2), -0.2) * n / 1000) AS l FROM m)
    SELECT run, step, round(0.2 * exp(coalesce(sum(l) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS beta FROM f""")
def monitor_adaptive_kl(spark, sf_dir):
    return rounded(m.adaptive_kl(step_means(spark, sf_dir), "v", "step", "run", 0.5, 1000.0, "n", 0.2).select("run", "step", "beta"), 6)


@query(f"WITH {STEP_MEANS} SELECT run, step, round(avg(n) OVER (PARTITION BY run ORDER BY step ROWS 4 PRECEDING), 4) AS mean_seconds, round((100 - step) * avg(n) OVER (PARTITION BY run ORDER BY step ROWS 4 PRECEDING), 4) AS remaining FROM m")
def monitor_time_remaining(spark, sf_dir):
    return rounded(m.time_remaining(step_means(spark, sf_dir), "n", "step", 100, "run").select("run", "step", "mean_seconds", "remaining"))


@query(f"WITH {STEP_MEANS} SELECT step, round(avg(n), 4) AS mean_unique, round(avg((n <= 2)::int), 4) AS two_or_less, round(avg(v), 4) AS mean_weight FROM m GROUP BY 1")
def monitor_duplicate_profile(spark, sf_dir):
    return rounded(m.duplicate_profile(step_means(spark, sf_dir).select("step", F.col("n").alias("n_unique"), F.col("v").alias("weight"))))


@query(f"""WITH {STEP_MEANS}, s AS (SELECT step, sum(n) AS n, avg(v) AS v FROM m GROUP BY 1), c AS (SELECT step, n * 0.5 - 3.0 * v AS composite FROM s)
    SELECT step, round(composite + 1e-9, 4) AS composite, row_number() OVER (ORDER BY round(composite, 9) DESC, step)::int AS rank FROM c""")
def monitor_composite_ranking(spark, sf_dir):
    """Composites that differ after the ninth place alone are ties; the 1e-9 keeps values that end in an exact half away from the rounding. The last bit of a mean,
    which hangs on the order of its sum, would decide both."""
    by_step = step_means(spark, sf_dir).groupBy("step").agg(F.sum("n").alias("n"), F.avg("v").alias("v"))
    out = m.composite_ranking(by_step, {"n": 0.5, "v": -3.0}, "step").withColumn("composite", F.col("composite") + 1e-9)
    return rounded(out.select("step", "composite", "rank"))


# ---- validation: source = event type, prompt = user, value = value, vote = value rounded to tens

V = "v AS (SELECT event_type AS source, user_id AS prompt, value, floor(value / 10)::bigint AS vote, event_id AS ord FROM events)"


def votes(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("user_id").alias("prompt"), "value", F.floor(F.col("value") / 10).alias("vote"), F.col("event_id").alias("ord"))


@query(f"WITH {V} SELECT source, count(*) AS n_prompts, round(avg(m), 4) AS mean, round(avg(s), 4) AS std FROM (SELECT source, prompt, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY ALL) GROUP BY 1")
def validation_means(spark, sf_dir):
    return rounded(m.validation_means(votes(spark, sf_dir)))


@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY source, prompt ORDER BY value) AS i, (count(*) OVER (PARTITION BY source, prompt))::double AS n FROM v),
    w AS (SELECT *, (i / n) ** 4 - ((i - 1) / n) ** 4 AS u, ((n - i + 1) / n) ** 4 - ((n - i) / n) ** 4 AS d FROM r)
    SELECT source, prompt, round(sum(value * u), 3) AS best, round(sum(value * d), 3) AS worst, round(sqrt(greatest(sum(value * value * u) - sum(value * u) ** 2, 0)), 3) AS best_std FROM w GROUP BY ALL""")
def validation_best_of_n(spark, sf_dir):
    return rounded(m.best_of_n(votes(spark, sf_dir), 4), 3)


@query(f"""WITH {V}, c AS (SELECT source, prompt, vote, count(*) AS n, min(ord) AS first, min_by(value, ord) AS value FROM v GROUP BY ALL)
    SELECT source, prompt, vote, value FROM c QUALIFY row_number() OVER (PARTITION BY source, prompt ORDER BY n DESC, first) = 1""")
def validation_majority_vote(spark, sf_dir):
    return m.majority_vote(votes(spark, sf_dir))


@query(f"""WITH {V}, c AS (SELECT source, prompt, vote, count(*) AS n, min_by(value, ord) AS value FROM v GROUP BY ALL),
    p AS (SELECT source, prompt, value, n / sum(n) OVER (PARTITION BY source, prompt) AS p FROM c),
    s AS (SELECT *, 1 - p AS s1, sum(p ** 2) OVER w - p ** 2 AS s2, sum(p ** 3) OVER w - p ** 3 AS s3 FROM p WINDOW w AS (PARTITION BY source, prompt))
    SELECT source, prompt, round(sum(value * (p ** 4 + 4 * p ** 3 * s1 + 6 * p ** 2 * (s1 ** 2 - s2) + 3 * p ** 2 * s2 + p * (s1 ** 3 - 3 * s1 * s2 + 2 * s3))) + 3e-7, 4) AS maj FROM s GROUP BY 1, 2""")
def validation_majority_of_n(spark, sf_dir):
    """For four draws the chances are written out in the SQL: four alike, three, two with two others or with another pair, all different. The 3e-7 keep values that end
    in an exact half away from the rounding, which the last bit would decide."""
    return rounded(m.majority_of_n(votes(spark, sf_dir), 4).withColumn("maj", F.col("maj") + 3e-7))


@query("""SELECT event_type || CASE WHEN user_id % 3 = 0 THEN '/max' WHEN user_id % 3 = 1 THEN '/min' ELSE '/mean' END AS name,
    round(CASE user_id % 3 WHEN 0 THEN max(value) WHEN 1 THEN min(value) ELSE avg(value) END, 4) AS value FROM events GROUP BY event_type, user_id % 3""")
def validation_reduce_by_name(spark, sf_dir):
    name = F.concat("event_type", F.element_at(F.array(F.lit("/max"), F.lit("/min"), F.lit("/mean")), (F.col("user_id") % 3 + 1).cast("int")))
    return rounded(m.reduce_by_name(events(spark, sf_dir).select(name.alias("name"), "value")))


@query("""SELECT round(avg(l_quantity), 4) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, min(l_quantity) AS l_quantity_min, round(avg(l_discount), 4) AS l_discount_mean, max(l_discount) AS l_discount_max, min(l_discount) AS l_discount_min,
    round(avg((l_linenumber = 0)::int), 4) AS aborted_ratio, round(avg((l_linenumber >= 6)::int), 4) AS clip_ratio FROM lineitem""")
def batch_statistics(spark, sf_dir):
    return rounded(m.batch_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 6, "l_linenumber"))


@query("SELECT round(1 - var_samp(l_extendedprice - 900 * l_quantity) / (var_samp(l_extendedprice) + 1e-5), 6) AS explained_variance FROM lineitem")
def batch_explained_variance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", 900 * F.col("l_quantity"))
    return rounded(m.explained_variance(li, "l_extendedprice", "v"), 6)


@query("SELECT round(sum(l_quantity), 2) AS tokens, round(sum(l_tax), 2) AS seconds, round(sum(l_tax) * 1000 / sum(l_quantity), 4) AS ms_per_token, round(sum(l_quantity) / (sum(l_tax) * 8), 4) AS tokens_per_second FROM lineitem")
def batch_throughput(spark, sf_dir):
    out = m.throughput(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", 8)
    return out.select(F.round("tokens", 2).alias("tokens"), F.round("seconds", 2).alias("seconds"), F.round("ms_per_token", 4).alias("ms_per_token"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


@query("""WITH x AS (SELECT p_brand AS source, p_type AS variable, CASE WHEN p_size % 2 = 0 THEN 'mean@' ELSE 'std@' END || p_size % 5 AS metric FROM part), n AS (SELECT DISTINCT *, string_split(metric, '@')[2]::int AS n FROM x)
    SELECT source, variable, metric, CASE WHEN variable = (SELECT min(p_type) FROM part) AND metric LIKE 'mean@%' AND n = max(n) OVER (PARTITION BY source, variable) THEN 'core' ELSE 'aux' END AS section FROM n""")
def metric_sections(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    metric = F.concat(F.when(F.col("p_size") % 2 == 0, "mean@").otherwise("std@"), F.col("p_size") % 5)
    first = parts.agg(F.min("p_type")).first()[0]
    return m.metric_sections(parts.select(F.col("p_brand").alias("source"), F.col("p_type").alias("variable"), metric.alias("metric")).distinct(), first)


@query("""WITH c AS (SELECT l_partkey % 20 AS model, count(*) AS calls, sum(l_quantity)::bigint AS tokens_in, sum(l_linenumber)::bigint AS tokens_out FROM lineitem GROUP BY 1),
    p AS (SELECT p_partkey AS model, p_retailprice AS price_in, p_size * 10.0 AS price_out FROM part WHERE p_partkey < 18)
    SELECT model, calls, tokens_in, tokens_out, round((tokens_in * price_in + tokens_out * price_out) / 1e6, 4) AS cost, round((tokens_in * price_in + tokens_out * price_out) / 1e6 / 709, 6) AS cost_per_prompt,
        round((tokens_in * price_in + tokens_out * price_out) / 1e6 / 709 * 5000, 3) AS projected FROM c LEFT JOIN p USING (model)""")
def usage_costs(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("model"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"))
    prices = table(spark, sf_dir, "part").filter("p_partkey < 18").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("price_in"), (F.col("p_size") * 10.0).alias("price_out"))
    out = m.usage_costs(calls, prices, 709, 5000)
    return out.select("model", "calls", "tokens_in", "tokens_out", F.round("cost", 4).alias("cost"), F.round("cost_per_prompt", 6).alias("cost_per_prompt"), F.round("projected", 3).alias("projected"))


@query("SELECT source, round(avg(n_chars), 4) AS score FROM documents GROUP BY 1")
def source_mean_scores(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("score")))
