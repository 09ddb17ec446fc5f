"""Queries that write the given tables in a layout and read them back with the reader of that layout, and runs of plug-ins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gradeloom.functions import text as x
from gradeloom.operators import monitoring as m
from gradeloom.operators import plugins
from gradeloom.operators import preparation as p
from gradeloom.operators import ranking as r
from gradeloom.operators import tokens as t
from gradeloom.plans.preparation import DRAWN, UNITS
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table
from gradeloom.plans.sources import work_dir
from gradeloom.plans.tokens import T, tokens
from gradeloom.sources import io
from gradeloom.streaming import runs


@query("SELECT doc_id, source, length(text) AS n, true AS placed FROM documents")
def source_jsonl_rows(spark, sf_dir):
    path = work_dir(spark)
    io.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    back = io.read_jsonl(spark, path, "doc_id long, source string, text string")
    return back.select("doc_id", "source", F.length("text").cast("long").alias("n"), (F.col("ord").isNotNull() & F.endswith("file", F.lit(".json"))).alias("placed"))


@query("SELECT p_partkey::varchar AS gold_answer, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'synthetic' END AS source, trim(p_type) AS question, p_size AS points FROM part WHERE p_size % 5 > 0")
def source_synthetic(spark, sf_dir):
    path = work_dir(spark)
    item = F.array(F.struct(F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise("  ").alias("criterion"), F.col("p_size").alias("points")))
    even = F.col("p_partkey") % 2 == 0  # one half has the other name of the rubric field and no source
    rows = table(spark, sf_dir, "part").select(F.when(even, "a").alias("source"), F.concat(F.lit(" "), "p_type").alias("question"), F.col("p_partkey").cast("string").alias("gold_answer"), F.when(even, item).alias("rubric"), F.when(~even, item).alias("rubrics"))
    io.write_jsonl(rows, path)
    return io.read_synthetic(spark, path).select("gold_answer", "source", "question", F.col("rubric")[0]["points"].alias("points"))


@query("""SELECT 'hub' AS source, p_type AS question, p_name AS criterion, greatest(1, least(10, p_size)) AS points FROM part
    UNION ALL SELECT 'ft', p_type, p_brand, greatest(1, least(10, CASE WHEN p_size <= 20 THEN round_even(p_size / 20.0::double * 10, 0) ELSE trunc(p_size / 20.0::double) END))::int FROM part""")
def source_rubric_tables(spark, sf_dir):
    path, parts = work_dir(spark), table(spark, sf_dir, "part")
    turn = F.array(F.struct(F.lit("user").alias("role"), F.col("p_type").alias("content")))
    io.write_parquet(parts.select(turn.alias("prompt"), F.array(F.struct(F.col("p_name").alias("criterion"), F.col("p_size").alias("points"))).alias("Rubrics"), F.lit("hub").alias("data_source")), f"{path}/hub")
    weighted = F.array(F.struct(F.col("p_brand").alias("criteria"), (F.col("p_size") / 20.0).alias("weight")))
    io.write_parquet(parts.select(F.col("p_type").alias("query"), weighted.alias("rubrics"), F.lit("ft").alias("source")), f"{path}/ft")
    return io.read_rubric_tables(spark, [f"{path}/hub"], [f"{path}/ft"]).select("source", "question", F.inline("rubric"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def source_mixed_files(spark, sf_dir):
    path, orders = work_dir(spark), table(spark, sf_dir, "orders")
    io.write_parquet(orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus"), f"{path}/a.parquet")
    io.write_jsonl(orders.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice"), f"{path}/b.jsonl")
    return io.read_mixed(spark, [f"{path}/a.parquet", f"{path}/b.jsonl"], "o_orderkey long, o_totalprice double")


@query("SELECT least(300, count(*)) AS n, true AS all_valid FROM documents WHERE n_chars > 500")
def source_take_valid(spark, sf_dir):
    got = io.take_valid(table(spark, sf_dir, "documents"), F.col("n_chars") > 500, 300)
    return got.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.col("n_chars") > 500), F.lit(True)).alias("all_valid"))


@query("""SELECT p_type AS prompt, p_name AS chosen, p_brand AS rejected, 'direct' AS subset FROM part
    UNION ALL SELECT p_type, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END, NULL FROM part WHERE p_size % 3 < 2
    UNION ALL SELECT p_type, p_brand, p_name, 'sub' FROM part""")
def source_preferences(spark, sf_dir):
    path, parts = work_dir(spark), table(spark, sf_dir, "part")
    io.write_jsonl(parts.select(F.col("p_type").alias("prompt"), F.col("p_name").alias("chosen"), F.col("p_brand").alias("rejected"), F.lit("direct").alias("subset")), f"{path}/chosen")
    winner = F.element_at(F.array(F.lit("model_a"), F.lit("model_b"), F.lit("tie")), F.col("p_size") % 3 + 1)
    io.write_jsonl(parts.select(F.col("p_type").alias("prompt"), F.col("p_name").alias("response_1"), F.col("p_brand").alias("response_2"), winner.alias("winner")), f"{path}/winner")
    turn = F.array(F.struct(F.lit("user").alias("role"), F.col("p_type").alias("content")))
    answers = F.array(*[F.struct(F.col(c).alias("answer")) for c in ("p_name", "p_brand")])
    io.write_jsonl(parts.select(turn.alias("conversation"), answers.alias("responses"), F.lit(1).alias("preferred_index"), F.lit("top/sub").alias("category_path")), f"{path}/conversation")
    return p.union_all(*[io.read_preferences(spark, f"{path}/{layout}", layout) for layout in ("chosen", "winner", "conversation")])


@query("SELECT event_id, (user_id % 5)::int AS step, round(value, 4) AS value FROM events WHERE user_id % 5 IN (1, 3)")
def source_read_steps(spark, sf_dir):
    path = work_dir(spark)
    io.write_steps(table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 5).alias("step")), path)
    return rounded(io.read_steps(spark, path, "event_id long, value double", steps=[1, 3, 4], lo=1, hi=3).select("event_id", "step", "value"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total, 0 AS without_id FROM (SELECT event_type, round(value, 2) AS value FROM events) GROUP BY 1")
def source_text_logs(spark, sf_dir):
    path = work_dir(spark)
    line = F.concat(F.lit("step:"), "event_id", F.lit(" kind="), "event_type", F.lit(" value:"), F.round("value", 2).cast("decimal(14,2)"))
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / ROWS_EACH).alias("run"), "event_id", line.alias("value"))
    events.repartition(n_files(events), "run").sortWithinPartitions("run", "event_id").select("value").write.text(path)
    lines = io.read_log(spark, path)
    read = m.log_metrics(lines, {"id": r"step:(\d+)", "value": r"value:(-?[\d.]+)"}).join(lines.select("log", "line_no", F.regexp_extract("line", r"kind=(\w+)", 1).alias("kind")), ["log", "line_no"])
    return read.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count(F.when(F.col("id").isNull(), 1)).cast("int").alias("without_id"))


#: Rows of a document or a log that a query writes to read it back: some MB, so that opening and committing files costs little beside their bytes.
ROWS_EACH = 20_000


def n_files(rows) -> int:
    """As many files as the table fills, so that none grows with it."""
    return max(1, rows.count() // ROWS_EACH)


def one_file_each(df, key: str, text, path: str) -> None:
    """A text file for each key, whose one line is ``text`` of the key's rows. All lie in one folder, for a folder a key costs more than its file."""
    df.groupBy(key).agg(text.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("SELECT 'm' || l_partkey % 40 AS model, count(*) AS calls, sum(l_quantity)::bigint AS tokens_in, sum(l_linenumber)::bigint AS tokens_out FROM lineitem WHERE l_orderkey >= 1000 GROUP BY 1")
def source_usage_log(spark, sf_dir):
    path, li = work_dir(spark), table(spark, sf_dir, "lineitem")
    call = F.struct(F.concat(F.lit("m"), F.col("l_partkey") % 40).alias("modelName"), F.col("l_quantity").cast("long").alias("promptTokens"), F.col("l_linenumber").cast("long").alias("completionTokens"), F.col("l_orderkey").cast("double").alias("createdAt"))
    # a document holds the calls of a few orders
    one_file_each(li.withColumn("k", F.pmod(F.xxhash64("l_orderkey"), F.lit(n_files(li)))), "k", F.to_json(F.collect_list(call)), path)
    read = io.read_usage(spark, path, since=1000.0)
    return read.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("SELECT doc_id // 50 AS step, round(avg(n_chars), 4) AS reward, min(n_chars)::double AS reward_min, max(n_chars)::double AS reward_max FROM documents GROUP BY 1")
def source_step_csv(spark, sf_dir):
    path = work_dir(spark)
    steps = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("step")).agg(F.avg("n_chars").alias("reward"), F.min("n_chars").alias("reward_min"), F.max("n_chars").alias("reward_max"))
    steps.select("step", "reward", "reward_min", "reward_max", *[F.lit(1.0).alias(c) for c in ("n_crit", "n_uniq", "unique_ratio")]).write.csv(path, header=True)
    return rounded(io.read_step_csv(spark, path).select(F.col("step").cast("long").alias("step"), "reward", "reward_min", "reward_max"))


@query("SELECT o_custkey::varchar AS prompt_id, count(*)::int AS num_completions, max(o_totalprice) AS pairwise_acc FROM orders GROUP BY 1")
def source_results(spark, sf_dir):
    path = work_dir(spark)
    each = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("prompt_id")).agg(F.count(F.lit(1)).cast("int").alias("num_completions"), F.max("o_totalprice").alias("pairwise_acc"))
    document = F.to_json(F.struct(F.struct(F.count(F.lit(1)).alias("num_prompts")).alias("summary"), F.collect_list(F.struct("prompt_id", "num_completions", "pairwise_acc")).alias("per_prompt")))
    one_file_each(each.withColumn("k", F.pmod(F.xxhash64("prompt_id"), F.lit(n_files(each)))), "k", document, path)
    return io.read_results(spark, path).select("prompt_id", "num_completions", "pairwise_acc")


@query("SELECT c_custkey::varchar AS id, c_name AS text FROM customer")
def source_cache_document(spark, sf_dir):
    path = work_dir(spark)
    document = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), "c_name"))))
    customers = table(spark, sf_dir, "customer")
    one_file_each(customers.withColumn("k", F.pmod(F.xxhash64("c_custkey"), F.lit(n_files(customers)))), "k", document, path)
    return io.read_cache_document(spark, path)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'third ' || c_name WHEN c_custkey % 2 = 0 THEN 'second ' || c_name ELSE 'first ' || c_name END AS response
    FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0""")
def source_cache_with_deletes(spark, sf_dir):
    """Written, overwritten in part, deleted in part, compacted, and written and looked up once more behind that."""
    customers = table(spark, sf_dir, "customer").select(io.cache_key(F.col("c_custkey")).alias("cache_key"), "c_custkey", "c_name")
    cache = io.ResponseCache(spark, work_dir(spark))
    put = lambda rows, word: cache.put(rows.select("cache_key", F.concat(F.lit(word), "c_name").alias("response")))
    put(customers, "first ")
    put(customers.filter("c_custkey % 2 = 0"), "second ")
    cache.delete(customers.filter("c_custkey % 5 = 0"))
    cache.compact()
    put(customers.filter("c_custkey % 7 = 0"), "third ")
    return cache.look_up(customers.select("cache_key", "c_custkey")).select("c_custkey", "response")


@query("SELECT 'n' AS name, string_agg(n::varchar, ',' ORDER BY batch) AS list FROM (SELECT doc_id // 50 AS batch, count(*) AS n FROM documents GROUP BY 1) UNION ALL SELECT 'chars', string_agg(c::varchar, ',' ORDER BY batch) FROM (SELECT doc_id // 50 AS batch, sum(n_chars)::bigint AS c FROM documents GROUP BY 1)")
def prep_metric_lists(spark, sf_dir):
    batches = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(F.create_map(F.lit("n"), F.count(F.lit(1)), F.lit("chars"), F.sum("n_chars").cast("long")).alias("metrics"))
    return p.metric_lists(batches, "batch", "metrics").select("name", F.array_join(F.transform("list", lambda v: v.cast("string")), ",").alias("list"))


@query("SELECT 'rows' AS part, count(*) AS n, round(avg(n_chars), 4) AS score FROM documents UNION ALL SELECT 'summary', count(*), round(avg(n_chars), 4) FROM documents")
def source_result_pair(spark, sf_dir):
    path = work_dir(spark)
    io.write_result(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), path, ["score"])
    rows = spark.read.schema("doc_id long, score double").json(f"{path}/per_prompt").agg(F.lit("rows").alias("part"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
    summary = spark.read.schema("num_prompts long, score double").json(f"{path}/summary").select(F.lit("summary").alias("part"), F.col("num_prompts").alias("n"), "score")
    return rounded(rows.unionByName(summary))


@query("SELECT o_custkey AS question, o_orderkey AS rollout, round(o_totalprice / 7, 4) AS reward, count(*) OVER (PARTITION BY o_custkey) AS n_rollouts FROM orders")
def source_nested_log_roundtrip(spark, sf_dir):
    path = work_dir(spark)
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("step"), F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("rollout"), (F.col("o_totalprice") / 7).alias("reward"))
    io.write_steps(io.nested_step_log(rows), path)
    back = io.read_steps(spark, path, "question long, n_rollouts long, rollouts array<struct<rollout:bigint,reward:double>>")
    return back.select("question", "n_rollouts", F.inline("rollouts"))


# ---- preparation and scores


@query("SELECT p_partkey FROM part WHERE p_size % 3 > 0 AND trim(p_name) <> ''")
def prep_non_empty(spark, sf_dir):
    rubrics = x.normalise_plain_rubrics(F.array(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(" ")))
    return p.non_empty(table(spark, sf_dir, "part").withColumn("rubrics", rubrics), "p_name", "rubrics").select("p_partkey")


@query("SELECT o_custkey AS prompt, round(avg((o_orderkey % 2)::int), 4) AS label FROM orders GROUP BY 1")
def label_shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("prompt")).agg(F.collect_list(F.col("o_orderkey") % 2 == 1).alias("binary_labels"))
    return rounded(o.select("prompt", r.label_share(F.col("binary_labels")).alias("label")))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::varchar), doc_id) - 1 AS place FROM documents")
def prep_seeded_shuffle(spark, sf_dir):
    shuffled = p.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    # the place is that in the shuffled table, counted by partition, not by a second sort of the hashes
    marked = shuffled.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sizes = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return marked.join(sizes.select("part", "first", before.alias("before")), "part").select("doc_id", (F.col("before") + F.col("at") - F.col("first")).alias("place"))


@query(f"""WITH {T}, m AS (SELECT avg(advantage) AS a, avg(old_logp) AS l FROM t WHERE mask = 1), c AS (SELECT sample_id, pos, (advantage - a) * (old_logp - l) AS cov FROM t, m WHERE mask = 1)
    SELECT sample_id, pos, round(cov, 4) AS cov FROM c WHERE cov BETWEEN -0.5 AND 0.5 ORDER BY md5('1:' || sample_id || ':' || pos), sample_id, pos LIMIT 500""")
def token_covariance_band(spark, sf_dir):
    return rounded(t.covariance_band(tokens(spark, sf_dir), -0.5, 0.5, 500))


EXTREME = "CASE WHEN p_size IN ((SELECT max(p_size) FROM part), (SELECT min(p_size) FROM part)) THEN 1 ELSE 0 END"
TOP = "CASE WHEN p_size = (SELECT max(p_size) FROM part) THEN 0.4::double ELSE 0.1::double END"


@query(" UNION ALL ".join(f"""(WITH {DRAWN.format(rows="SELECT p_partkey AS key, " + UNITS.format(w=w, most=most) + " AS w FROM part", n="(SELECT count(*) FROM part)")}
    SELECT '{method}' AS method, draw, key AS p_partkey FROM u JOIN s ON u >= start AND u < start + w)""" for method, w, most in (("max_min", EXTREME, "1.0"), ("max_random", TOP, "0.4::double"))))
def prep_resample_methods(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    drawn = [p.resample(part, part.count(), "p_size", method, key="p_partkey").select(F.lit(method).alias("method"), "draw", "p_partkey") for method in ("max_min", "max_random")]
    return drawn[0].unionByName(drawn[1])


# ---- plug-ins and streams


@plugins.reward_manager("length")
def _length_reward(df):
    return df.withColumn("score", F.length("text").cast("double"))


@query("SELECT doc_id, length(text)::double AS score FROM documents")
def plugin_reward_manager(spark, sf_dir):
    return plugins.REWARD_MANAGERS["length"](table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "score")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_size END::double AS score FROM part")
def plugin_safe_scorer(spark, sf_dir):
    """Rows that raise score 0; the others get their size."""

    def score(row: dict) -> float:
        if row["p_size"] % 4 == 0:
            raise ValueError("no score")
        return row["p_size"]

    return plugins.apply_scorer(table(spark, sf_dir, "part").select("p_partkey", "p_size"), plugins.safe_scorer(score, 30.0), "p_partkey long, p_size int, score double").select("p_partkey", "score")


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'round ' || p_size % 3 ELSE '' END AS output FROM part")
def plugin_retry_rounds(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    answer = lambda df, k: df.withColumn("output", F.when(F.col("p_size") % 3 == k, F.lit(f"round {k}")).otherwise(""))
    return plugins.generate_with_retry(parts, answer, work_dir(spark), 2).select("p_partkey", "output")


@query("SELECT o_orderkey, o_totalprice * 2 AS score FROM orders")
def plugin_saved_batches(spark, sf_dir):
    path = work_dir(spark)
    make = lambda factor: lambda: table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * factor).alias("score"))
    io.load_or_compute(spark, path, make(3), factor=3)
    io.load_or_compute(spark, path, make(2), factor=2)
    # saved under its parameters, so this isn't computed again
    return io.load_or_compute(spark, path, make(99), factor=2)


def _files(spark, sf_dir, path: str, parts: int):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.col("doc_id"), F.lit(parts)).alias("step"))
    return lambda k: docs.filter(F.col("step") == k).drop("step").write.mode("append").json(f"{path}/in")


@query("SELECT doc_id, length(text) AS score FROM documents")
def stream_score_and_restart(spark, sf_dir):
    """Files come in two rounds, the second with rows of the first; the run ends between them and goes on from its checkpoint."""
    path = work_dir(spark)
    put = _files(spark, sf_dir, path, 2)
    for rounds in ((0,), (0, 1)):
        for k in rounds:
            put(k)
        stream = runs.stream_files(spark, f"{path}/in", "doc_id long, text string").drop("step")
        runs.score_as_it_comes(stream, lambda b: b.select("doc_id", F.length("text").cast("long").alias("score")), f"{path}/out", "doc_id", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long, score long").parquet(f"{path}/out").select("doc_id", "score")


@query("SELECT doc_id FROM documents WHERE length(text) > 300")
def stream_grow_dataset(spark, sf_dir):
    path = work_dir(spark)
    put = _files(spark, sf_dir, path, 3)
    for k in range(3):
        put(k)
        stream = runs.stream_files(spark, f"{path}/in", "doc_id long, text string").drop("step")
        runs.grow_dataset(stream, lambda b: b.filter(F.length("text") > 300), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long").parquet(f"{path}/out").select("doc_id")
