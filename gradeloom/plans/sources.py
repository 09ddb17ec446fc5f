"""Queries over sources, sequences, plug-ins and streams, on the given tables or on files that Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.functions import sequences as q
from gradeloom.operators import plugins
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table
from gradeloom.sources import io
from gradeloom.streaming import runs


def work_dir(spark) -> str:
    """A new folder under the shared checkpoint folder, or under /tmp for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/spark-gradeloom"
    return f"{base.rstrip('/')}/queries/{uuid.uuid4().hex}"


@query("SELECT doc_id::varchar AS prompt_id, 'User: ' || trim(text) AS question, 1 AS n_rubrics, 'documents' AS kind FROM documents WHERE trim(text) <> ''")
def source_prompts_roundtrip(spark, sf_dir):
    path = work_dir(spark)
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rubric = F.array(F.struct(F.lit("names the topic").alias("criterion"), F.lit(2).alias("points")), F.struct(F.lit(" ").alias("criterion"), F.lit(1).alias("points")))
    io.write_jsonl(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("prompt_id"), message.alias("prompt"), rubric.alias("rubrics")), path)
    return io.read_prompts(spark, path).select("prompt_id", "question", F.size("rubrics").alias("n_rubrics"), F.lit("documents").alias("kind"))


@query("SELECT event_id, user_id % 5 AS step, round(value, 4) AS value FROM events WHERE user_id % 5 BETWEEN 1 AND 3")
def source_step_files(spark, sf_dir):
    path = work_dir(spark)
    io.write_steps(table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 5).alias("step")), path)
    files = spark.read.schema("event_id long, value double, step long").json(path).filter("step between 1 and 3")
    return rounded(files.select("event_id", "step", "value"))


@query("SELECT o_custkey AS question, count(*) AS n_rollouts, round(sum(round(o_totalprice / 7, 4)), 2) AS total FROM orders GROUP BY 1")
def source_nested_log(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("step"), F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("rollout"), (F.col("o_totalprice") / 7).alias("reward"))
    log = io.nested_step_log(rows)
    total = F.aggregate("rollouts", F.lit(0.0), lambda acc, r: acc + r["reward"])
    return log.select("question", "n_rollouts", F.round(total, 2).alias("total"))


@query("SELECT user_id, list(event_type ORDER BY event_id) AS responses FROM events GROUP BY 1")
def source_wide_samples(spark, sf_dir):
    return io.wide_samples(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT c_custkey, md5('judge|' || c_name || '|' || c_nationkey) AS cache_key, c_custkey % 3 = 0 AS hit FROM customer")
def source_response_cache(spark, sf_dir):
    work = table(spark, sf_dir, "customer").withColumn("cache_key", io.cache_key(F.lit("judge"), F.col("c_name"), F.col("c_nationkey")))
    cache = work.filter("c_custkey % 3 = 0").select("cache_key", F.lit("Score: 7").alias("response"))
    hits, misses = io.split_cached(work, cache)
    return hits.select("c_custkey", "cache_key", F.lit(True).alias("hit")).unionByName(misses.select("c_custkey", "cache_key", F.lit(False).alias("hit")))


@query("SELECT prompt, ord, score, label FROM (SELECT o_custkey AS prompt, unnest(list(o_totalprice ORDER BY o_orderkey)) AS score, unnest(list((o_orderkey % 2)::double ORDER BY o_orderkey)) AS label, unnest(range(count(*)))::int AS ord FROM orders GROUP BY 1)")
def source_long_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("prompt_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    per_prompt = o.select("prompt_id", F.transform("s", lambda v: v["o_totalprice"]).alias("pred_scores"), F.transform("s", lambda v: (v["o_orderkey"] % 2).cast("double")).alias("label_scores"))
    return io.long_scores(per_prompt)


@query("SELECT p_partkey, '- [+' || greatest(1, least(10, p_size)) || '] ' || p_name AS gold_rubric, 'Ask: ' || p_type AS content FROM part")
def source_training_rows(spark, sf_dir):
    rubric = F.array(F.struct(F.col("p_name").alias("criterion"), F.greatest(F.lit(1), F.least(F.lit(10), F.col("p_size"))).alias("points")))
    rows = table(spark, sf_dir, "part").select(F.lit("parts").alias("source"), F.col("p_type").alias("question"), F.lit("").alias("gold_answer"), rubric.alias("rubric"), F.col("p_partkey").alias("prompt_id"))
    out = io.training_rows(rows, "Ask: {question}")
    return out.select(F.col("extra_info.prompt_id").alias("p_partkey"), F.col("reward_model.ground_truth.gold_rubric").alias("gold_rubric"), F.col("prompt")[0]["content"].alias("content"))


# ---- sequences

WORDS = "string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')"


def spaced(c):
    return F.split(F.regexp_replace(F.trim(c), r"\s+", " "), " ")


def written(c):
    return F.rtrim(F.array_join(c, " "))


@query("""WITH t AS (SELECT item_id, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') AS w FROM benchmark), n AS (SELECT *, len(w) AS n FROM t)
    SELECT item_id, least(n + 4, 40) AS real, least(greatest(40 - n, 0), 4) AS loss, rtrim(array_to_string(list_slice(w || ['it', 'is', 'so', '</s>'], 1, 40), ' ')) AS tokens,
    rpad(substr(repeat('0', n) || '1111', 1, 40), 40, '0') AS loss_mask, rpad(repeat('1', least(n + 4, 40)), 40, '0') AS attention FROM n""")
def sequence_prompt_response(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("answer", F.lit("it is so"))
    out = q.prompt_response(b, "text", "answer", 40, tokenizer=spaced)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v).cast("long")
    return out.select("item_id", total("attention").alias("real"), total("loss_mask").alias("loss"), written("tokens").alias("tokens"), F.array_join("loss_mask", "").alias("loss_mask"), F.array_join("attention", "").alias("attention"))


@query("""WITH t AS (SELECT conv_id, turn, role, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') AS w FROM conversations), s AS (SELECT *, len(w) AS n, sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn) - len(w) AS before FROM t)
    SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN greatest(least(before + n, 512) - least(before, 512), 0) ELSE 0 END)::bigint AS loss,
    rtrim(array_to_string(list_slice(flatten(list(w ORDER BY turn)), 1, 512), ' ')) AS tokens,
    rpad(substr(string_agg(repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, n), '' ORDER BY turn), 1, 512), 512, '0') AS loss_mask FROM s GROUP BY 1""")
def sequence_multi_turn(spark, sf_dir):
    out = q.multi_turn(table(spark, sf_dir, "conversations"), 512, spaced)
    loss = F.aggregate("loss_mask", F.lit(0), lambda a, v: a + v).cast("long")
    return out.select("conv_id", loss.alias("loss"), written("tokens").alias("tokens"), F.array_join("loss_mask", "").alias("loss_mask"))


@query("SELECT p_partkey, length(p_name) + length(p_type) + 1 AS n, round((length(p_name) + 7) * 0.5 + length(p_type), 4)::double AS total, repeat('5', length(p_name) + 7) || repeat('1', length(p_type)) AS marks FROM part")
def sequence_line_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("- [+] "), F.col("p_name"), F.lit("\n"), F.col("p_type")).alias("t"), F.array(F.lit(0.5)).alias("w"))
    out = q.spread_line_weights(rows, "t", "w")
    total = F.aggregate("char_weights", F.lit(0.0), lambda a, v: a + v)
    marks = F.transform("char_weights", lambda v: F.when(v == 0.5, "5").when(v == 1.0, "1").otherwise("?"))
    return out.select("p_partkey", (F.size("char_weights") - 6).cast("long").alias("n"), F.round(total, 4).alias("total"), F.array_join(marks, "").alias("marks"))


# ---- plug-ins and streams


@query("SELECT doc_id, ('0x' || md5(text)[1:2])::bigint % 11 AS score FROM documents")
def plugin_cached_judge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = spark.createDataFrame([], "cache_key string, response string")
    scored, _ = plugins.cached_scores(docs, cache, plugins.hash_scorer("text"), "text", path=work_dir(spark))
    return scored.select("doc_id", F.regexp_extract("response", r"(\d+)", 1).cast("long").alias("score"))


@query("SELECT user_id AS run, step, round(total, 4) AS total FROM (SELECT user_id % 10 AS user_id, event_id % 20 AS step, sum(value) AS total FROM events GROUP BY ALL)")
def stream_step_monitor(spark, sf_dir):
    """Each step's rows are in several files, which come in two runs of the stream, and a step's total is one row."""
    path = work_dir(spark)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("run"), (F.col("event_id") % 20).alias("at"), "value", F.pmod(F.xxhash64("event_id"), F.lit(2)).alias("part"))
    ends = rows.select("run").distinct().withColumn("at", F.lit(None).cast("long")).withColumn("value", F.lit(None).cast("double"))
    for parts in ([rows.filter("part = 0")], [rows.filter("part = 1"), ends]):
        for part in parts:
            part.select("run", "at", "value").write.mode("append").json(f"{path}/in")
        stream = runs.stream_files(spark, f"{path}/in", "run long, at long, value double")
        runs.run_to_files(runs.step_totals(stream, step="at", delay=20), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return rounded(spark.read.schema("run long, step long, total double, late boolean").parquet(f"{path}/out").filter("not late").select("run", "step", "total"))


@query("""WITH RECURSIVE m AS (SELECT lang AS run, doc_id // 50 AS step, avg((n_chars > 800)::int) AS v FROM documents GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM m),
    r AS (SELECT run, step, k, 0.9::double + 0.1::double * v AS ema FROM k WHERE k = 1 UNION ALL SELECT k.run, k.step, k.k, 0.9::double * r.ema + 0.1::double * k.v FROM r JOIN k ON k.run = r.run AND k.k = r.k + 1)
    SELECT run, step, round(ema, 5) AS ema, round(greatest(max(0.1::double + 0.9::double * ema) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0.1), 5) AS factor FROM r""")
def stream_smooth_factor(spark, sf_dir):
    path = work_dir(spark)
    means = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("run"), F.floor(F.col("doc_id") / 50).alias("step")).agg(F.avg((F.col("n_chars") > 800).cast("double")).alias("value"))
    # files come in any order, so a run's steps are held until the run has ended
    means.repartition(3, "step").write.parquet(f"{path}/in")
    means.select("run").distinct().select("run", F.lit(None).cast("long").alias("step"), F.lit(None).cast("double").alias("value")).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("run string, step long, value double").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    runs.run_to_files(runs.smooth_stream(stream, delay=runs.LAST), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return rounded(spark.read.schema("run string, step long, ema double, factor double").parquet(f"{path}/out"), 5)
