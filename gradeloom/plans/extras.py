"""More preparation queries: datasets of several layouts, preferences, showcases, permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import sequences as q
from gradeloom.functions import text as x
from gradeloom.operators import monitoring as m
from gradeloom.operators import preparation as p
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table


@query("""SELECT conv_id, coalesce(CASE WHEN conv_id % 2 = 0 THEN max_by(text, turn) FILTER (role = 'user') ELSE 'ask ' || conv_id END, '') AS question,
    coalesce(CASE WHEN conv_id % 2 = 0 THEN max_by(text, turn) FILTER (role = 'assistant') ELSE 'say' END, '') AS gold_answer FROM conversations GROUP BY conv_id""")
def prep_question_answer(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    odd = F.col("conv_id") % 2 == 1
    rows = c.withColumn("dataset", F.when(odd, "open-instruct").otherwise("chat-set")).withColumn("instruction", F.lit(""))
    rows = rows.withColumn("input", F.when(odd, F.concat(F.lit("ask "), F.col("conv_id")))).withColumn("output", F.when(odd, "say"))
    for name in ("question", "generated_solution", "expected_answer"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return p.question_answer(rows).select("conv_id", "question", "gold_answer")


@query("""SELECT p_type AS prompt, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS chosen, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS rejected, p_brand AS subset FROM part WHERE p_size % 3 < 2 OR p_size % 2 < 2""")
def prep_preferred_pairs(spark, sf_dir):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    talk = F.array(turn("user", F.lit("hello")), turn("assistant", F.lit("yes?")), turn("user", F.col("p_type")))
    answers = F.array(F.struct(F.col("p_name").alias("answer")), F.struct(F.col("p_brand").alias("answer")))
    rows = table(spark, sf_dir, "part").select(talk.alias("conversation"), answers.alias("responses"), (F.col("p_size") % 2).alias("preferred_index"), F.concat_ws("/", F.lit("parts"), F.col("p_brand")).alias("category_path"))
    return p.preferred_pairs(rows)


@query("""SELECT doc_id, round(a - greatest(b, c), 4) AS lead FROM (SELECT doc_id, text, (n_chars % 97) / 97 AS a, (n_chars % 89) / 89 AS b, (doc_id % 83) / 83 AS c FROM documents)
    WHERE a > greatest(b, c) + 0.05 AND a >= 0.6 AND length(text) > 50 AND length(text) < 800 ORDER BY a - greatest(b, c) DESC, text LIMIT 10""")
def prep_showcase(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 97 / 97).alias("a"), (F.col("n_chars") % 89 / 89).alias("b"), (F.col("doc_id") % 83 / 83).alias("c"))
    return rounded(p.showcase(d, "a", ["b", "c"], "text").select("doc_id", "lead"))


@query("SELECT event_id FROM events WHERE epoch(ts) >= (SELECT avg(epoch(ts)) FROM events)")
def prep_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("epoch"))
    return p.since(e, "epoch", e.agg(F.avg("epoch")).first()[0]).select("event_id")


@query("SELECT item_id, (SELECT max(item_id) FROM benchmark) - item_id AS ord FROM benchmark")
def prep_reorder(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("ord"))
    last = rows.agg(F.max("ord").alias("last"))  # one row
    permutation = rows.crossJoin(F.broadcast(last)).select(F.col("ord").alias("old"), (F.col("last") - F.col("ord")).alias("new"))
    return p.reorder(rows, permutation)


@query("SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0")
def prep_rows_at(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("idx"))
    return p.rows_at(table(spark, sf_dir, "documents").select("doc_id", "lang"), wanted, "doc_id")


@query("SELECT doc_id, n_chars AS size, lang AS language FROM documents")
def prep_pop_and_rename(spark, sf_dir):
    popped, rest = p.pop(table(spark, sf_dir, "documents"), ["n_chars"], ["doc_id"])
    return p.rename(popped.join(rest.select("doc_id", "lang"), "doc_id"), {"n_chars": "size", "lang": "language"})


@query("SELECT p_partkey, replace(replace(p_name || '|' || p_type, '|', '\\|'), chr(10), ' ') AS cell, CASE WHEN p_size >= 25 THEN '+' ELSE '-' END || abs(p_size - 25) || '.0000' AS delta FROM part")
def prep_table_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.escape_cell(F.concat_ws("|", "p_name", "p_type")).alias("cell"), x.signed(F.col("p_size") - 25).alias("delta"))


@query("SELECT p_partkey, p_size % 2 = 0 AS flag, p_name AS text FROM part")
def prep_tag_flags(spark, sf_dir):
    tagged = F.concat(F.when(F.col("p_size") % 2 == 0, "<GENERIC_RUBRIC> ").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", x.tag_flag(tagged, "GENERIC_RUBRIC").alias("t")).select("p_partkey", "t.flag", "t.text")


@query("SELECT o_custkey, string_agg(n || '. ' || o_orderpriority, chr(10) ORDER BY n) AS block FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def prep_numbered_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    return o.select("o_custkey", x.numbered(F.transform("s", lambda v: v["o_orderpriority"])).alias("block"))


@query("SELECT step, round(0.01 + (0.001 - 0.01) * least(greatest(step / 12.0::double, 0), 1), 6) AS coefficient FROM (SELECT DISTINCT doc_id // 50 AS step FROM documents)")
def monitor_entropy_schedule(spark, sf_dir):
    steps = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("step")).distinct()
    return rounded(steps.select("step", m.entropy_schedule(F.col("step"), 0.01, 0.001, 12).alias("coefficient")), 6)


@query("SELECT p_partkey, 2 AS prompt_tokens, round(2 * least(1 + 0.1::double * p_size, 3.0), 4)::double AS total_weight FROM part")
def sequence_weighted_criteria(spark, sf_dir):
    items = F.array(F.struct(F.lit("first one").alias("text"), x.criterion_weight(F.col("p_size")).alias("weight")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("the prompt").alias("p"), items.alias("c"))
    out = q.weighted_criteria(rows, "p", "c", 6)
    total = F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)
    return out.select("p_partkey", F.size(F.filter(F.slice("weights", 1, 2), lambda w: w == 0)).alias("prompt_tokens"), F.round(total, 4).alias("total_weight"))


@query("SELECT p_partkey, 8 AS n, p_name AS last_chosen FROM part WHERE NOT contains(p_name, ' ')  UNION ALL SELECT p_partkey, 8, string_split(p_name, ' ')[-1] FROM part WHERE contains(p_name, ' ')")
def sequence_preference_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("prompt", F.lit("a b c d e f g h"))
    out = q.preference_pair(rows, "prompt", "p_name", "p_type", 8, lambda c: F.split(c, " "))
    return out.select("p_partkey", F.size("chosen_tokens").alias("n"), F.element_at("chosen_tokens", -1).alias("last_chosen"))
