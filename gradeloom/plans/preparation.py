"""Preparation queries over documents, orders, parts, events, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import text as x
from gradeloom.operators import preparation as p
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT CASE WHEN text IS NULL OR len(string_split(text, ' ')) < 30 THEN 'too_short' WHEN n_chars > 5000 THEN 'too_long' WHEN lang = 'de' THEN 'language' END AS skip_reason, count(*) AS n FROM documents GROUP BY 1")
def prep_skip_reasons(spark, sf_dir):
    tests = {"too_short": F.size(F.split("text", " ")) >= 30, "too_long": F.col("n_chars") <= 5000, "language": F.col("lang") != "de"}
    return p.skip_reasons(docs(spark, sf_dir), tests).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE len(string_split(trim(text), ' ')) <= 200 AND text IS NOT NULL")
def prep_within_length(spark, sf_dir):
    return p.within_length(docs(spark, sf_dir), "text", 200, lambda c: F.size(F.split(F.btrim(c, F.lit(" ")), " "))).select("doc_id")


@query("SELECT doc_id, ('0x' || substr(md5('42:' || doc_id::varchar), 1, 8))::bigint % 100 < 20 AS held_out FROM documents")
def prep_held_out_split(spark, sf_dir):
    return p.split_held_out(docs(spark, sf_dir), "doc_id").select("doc_id", "held_out")


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE doc_id::varchar END), ''), md5(text)) AS id FROM documents")
def prep_id_or_hash(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", p.id_or_hash(raw, F.col("text")).alias("id"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS chosen, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS rejected FROM part WHERE p_size % 3 < 2")
def prep_by_winner(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("winner", F.expr("element_at(array('a', 'b', 'none'), p_size % 3 + 1)"))
    return p.by_winner(parts, "p_name", "p_type", "winner", "a", "b").select("p_partkey", "chosen", "rejected")


@query("SELECT doc_id FROM documents WHERE doc_id >= 5 AND doc_id < 700 AND (doc_id - 5) % 3 = 0")
def prep_row_slice(spark, sf_dir):
    return p.rows_slice(docs(spark, sf_dir), 5, 700, 3, "doc_id").select("doc_id")


@query("WITH s AS (SELECT event_id, user_id % 1000 AS step FROM events) SELECT event_id, step FROM s WHERE step % 100 = 0 OR (step >= 800 AND step % 20 = 0)")
def prep_sampled_steps(spark, sf_dir):
    return p.sampled_steps(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 1000).alias("step"))).select("event_id", "step")


@query("""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id::varchar), item_id) AS r, count(*) OVER () AS c FROM benchmark)
    SELECT item_id, unnest(range(1, (n // c + (r <= n % c)::int) + 1)) AS copy FROM r, (SELECT count(*) AS n FROM labels)""")
def prep_upsample(spark, sf_dir):
    return p.upsample(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels").count(), "item_id").select("item_id", F.col("copy").cast("long").alias("copy"))


@query("SELECT doc_id FROM documents ORDER BY (lang <> 'fr')::int, md5('7:' || doc_id::varchar), doc_id LIMIT 250")
def prep_priority_sample(spark, sf_dir):
    return p.priority_sample(docs(spark, sf_dir), 250, F.col("lang") == "fr", "doc_id", 7).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id::varchar), doc_id LIMIT 100")
def prep_random_subset(spark, sf_dir):
    return p.random_subset(docs(spark, sf_dir), 100, "doc_id", 11).select("doc_id")


@query("""SELECT l_orderkey, l_partkey FROM (SELECT *, sum((NOT g)::int) OVER (PARTITION BY l_orderkey ORDER BY md5('42:' || l_orderkey::varchar || ':' || l_partkey::varchar), l_partkey ROWS UNBOUNDED PRECEDING) AS r
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_partkey % 7 = 0 AS g FROM lineitem)) WHERE g OR r <= 2""")
def prep_sparse_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return p.sparse_subset(rows, 2, ["l_orderkey"], "l_partkey", F.col("l_partkey") % 7 == 0)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def prep_best_rows(spark, sf_dir):
    return p.best_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 2).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey::varchar), o_orderkey) - 1 AS shuffled_pos FROM orders")
def prep_shuffled_positions(spark, sf_dir):
    out = p.shuffled_positions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")
    return out.select("o_custkey", "o_orderkey", F.col("shuffled_pos").cast("long").alias("shuffled_pos"))


#: Draws as points in the running sum of whole weights, in the order of the keys: {rows} gives (key, w), {n} the number of draws.
DRAWN = """s AS (SELECT key, w, sum(w) OVER (ORDER BY key) - w AS start FROM ({rows})), d AS (SELECT range AS draw, ('0x' || substr(md5('42:' || range::varchar), 1, 12))::bigint AS h FROM range({n})),
    u AS (SELECT draw, (h::hugeint * (SELECT sum(w) FROM s)) // 281474976710656 AS u FROM d)"""
UNITS = "greatest(round({w} / {most} * 1073741824), 1)::hugeint"


@query(f"""WITH l AS (SELECT doc_id AS key, pow(abs(n_chars / 1000), 2) AS p FROM labels JOIN documents USING (doc_id)),
    {DRAWN.format(rows="SELECT key, " + UNITS.format(w="p", most="(SELECT max(p) FROM l)") + " AS w FROM l", n="(SELECT count(*) FROM l)")}
    SELECT draw, key AS doc_id FROM u JOIN s ON u >= start AND u < start + w""")
def prep_resample(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id").select("doc_id", (F.col("n_chars") / 1000).alias("score"))
    return p.resample(labelled, labelled.count(), "score", key="doc_id").select("draw", "doc_id")


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY 24576.0 * n_chars + n_chars * n_chars DESC, doc_id) - 1 AS r FROM documents)
    SELECT doc_id, (CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END)::int AS part FROM r""")
def prep_snake_partitions(spark, sf_dir):
    return p.snake_partitions(docs(spark, sf_dir), 8, "n_chars", "doc_id").select("doc_id", "part")


@query()
def prep_balanced_partitions(spark, sf_dir):
    return p.balanced_partitions(docs(spark, sf_dir).select("doc_id", "n_chars"), 8, "n_chars", "doc_id").select("doc_id", "part")


@query()
def prep_token_budget_partitions(spark, sf_dir):
    return p.token_budget_partitions(docs(spark, sf_dir).select("doc_id", "n_chars"), 20000, "n_chars", "doc_id").select("doc_id", "cell", "part")


@query()
def prep_balanced_batches(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")
    return p.balanced_batches(rows, "batch", 8, "n_chars", "doc_id").select("doc_id", "batch", "part")


@query()
def prep_token_budget_batches(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")
    return p.token_budget_batches(rows, "batch", 20000, "n_chars", "doc_id").select("doc_id", "batch", "part")


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY 24576.0 * n_chars + n_chars * n_chars DESC, doc_id) - 1 AS r FROM documents),
    s AS (SELECT CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS part, sum(n_chars) AS s FROM r GROUP BY 1)
    SELECT min(s)::bigint AS min, max(s)::bigint AS max, (max(s) - min(s))::bigint AS spread, round(avg(s), 4) AS mean FROM s""")
def prep_imbalance(spark, sf_dir):
    return rounded(p.imbalance(p.snake_partitions(docs(spark, sf_dir), 8, "n_chars", "doc_id"), "part", "n_chars"))


@query("SELECT 'doc' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'item', item_id, NULL FROM benchmark")
def prep_union_all(spark, sf_dir):
    a = docs(spark, sf_dir).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return p.union_all(a, table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


@query("SELECT lang AS source, (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS n FROM documents GROUP BY 1")
def prep_equal_mix(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("source"))
    return p.equal_mix(d, "source", "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def prep_conflicts(spark, sf_dir):
    return p.conflicts(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT item_id, unnest(range(3)) AS copy, item_id * 3 + unnest(range(3)) AS new_ord FROM benchmark")
def prep_repeat_interleaved(spark, sf_dir):
    return p.repeat_rows(table(spark, sf_dir, "benchmark"), 3, True, "item_id").select("item_id", F.col("copy").cast("long").alias("copy"), "new_ord")


@query("SELECT item_id, copy, row_number() OVER (ORDER BY copy, item_id) - 1 AS new_ord FROM (SELECT item_id, unnest(range(3)) AS copy FROM benchmark)")
def prep_repeat_stacked(spark, sf_dir):
    return p.repeat_rows(table(spark, sf_dir, "benchmark"), 3, False, "item_id").select("item_id", F.col("copy").cast("long").alias("copy"), F.col("new_ord").cast("long").alias("new_ord"))


@query("SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS copy FROM part WHERE p_size % 4 > 0")
def prep_repeat_each(spark, sf_dir):
    return p.repeat_each(table(spark, sf_dir, "part").withColumn("times", F.col("p_size") % 4), "times").select("p_partkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) AS chunk FROM documents")
def prep_chunk(spark, sf_dir):
    return p.chunk(docs(spark, sf_dir), 7, "doc_id").select("doc_id", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT doc_id, doc_id // 128 AS chunk FROM documents")
def prep_split_by_size(spark, sf_dir):
    return p.split_by_size(docs(spark, sf_dir), 128, "doc_id").select("doc_id", "chunk")


@query("SELECT item_id, false AS is_pad FROM benchmark UNION ALL SELECT item_id + (SELECT count(*) FROM benchmark), true FROM benchmark WHERE item_id < (7 - (SELECT count(*) FROM benchmark) % 7) % 7")
def prep_pad_to_multiple(spark, sf_dir):
    return p.pad_to_multiple(table(spark, sf_dir, "benchmark"), 7, "item_id").select("item_id", "is_pad")


@query("SELECT vec_id, true AS same FROM embeddings")
def prep_unfold_and_fold(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return p.fold(p.unfold(vectors, "embedding", 4), ["vec_id"], "embedding").join(vectors.withColumnRenamed("embedding", "was"), "vec_id").select("vec_id", (F.col("embedding") == F.col("was")).alias("same"))


@query("SELECT a.doc_id, quality::int AS quality, n_chars AS chars FROM documents a JOIN labels USING (doc_id)")
def prep_join_models(spark, sf_dir):
    joined = docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("v"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    return p.join_models({"chars": joined, "quality": labels}, "doc_id", "v").withColumn("quality", F.col("quality").cast("int"))


@query("SELECT DISTINCT item_id AS id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def prep_leaked_ids(spark, sf_dir):
    return p.leaked_ids(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), docs(spark, sf_dir).select(F.col("doc_id").alias("id")), "id")


@query("SELECT d.doc_id, coalesce(quality, -1)::int AS quality FROM documents d LEFT JOIN labels USING (doc_id)")
def prep_lookup(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("int"))
    return p.lookup(docs(spark, sf_dir).select("doc_id"), labels, "doc_id", "quality", -1)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prep_not_done(spark, sf_dir):
    return p.not_done(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH k AS (SELECT item_id AS id, text, item_id + 1000 AS v FROM benchmark), s AS (SELECT substr(text, 1, 150) AS start, min(v) AS v FROM k GROUP BY 1),
    q AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'User: ' ELSE '' END || text AS text FROM documents)
    SELECT q.id, coalesce(k.v, s.v) AS v FROM q LEFT JOIN k USING (id) LEFT JOIN s ON s.start = substr(regexp_replace(trim(q.text), '^User: ', ''), 1, 150)""")
def prep_fallback_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", (F.col("item_id") + 1000).alias("v"))
    asked = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "User: ").otherwise(""), F.col("text")).alias("text"))
    return p.fallback_lookup(asked, known, "id", "text", "v").select("id", "v")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def prep_union_columns(spark, sf_dir):
    d = docs(spark, sf_dir)
    return p.union_columns(d.select("doc_id", "lang", "source"), d.select("doc_id", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM events""")
def prep_forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id"))).withColumn("at", F.struct("ts", "event_id"))
    return p.forward_fill(e, "mark", "user_id", "at", "step").select("event_id", "step")


@query("""SELECT nation, a.v AS before, b.v AS after, b.v - a.v AS delta FROM (SELECT c_nationkey AS nation, count(*) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS v FROM supplier GROUP BY 1) b USING (nation)""")
def prep_before_after(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("v"))
    return p.before_after(a, b, ["nation"], "v")


@query("""WITH g AS (SELECT conv_id, min_by(text, turn) AS gold FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1)
    SELECT c.conv_id, c.turn, g.gold FROM conversations c LEFT JOIN g USING (conv_id)""")
def prep_first_gold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("gold", F.when(F.col("role") == "assistant", F.col("text")))
    return p.first_gold(c, "conv_id", "gold", "turn").select("conv_id", "turn", "gold")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def prep_source_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def prep_id_intersection(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def prep_missing_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS chat,
    coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (role = 'user' AND trim(text) <> ''), '') AS asked, string_agg(text, chr(10) ORDER BY turn) AS contents FROM conversations GROUP BY 1""")
def prep_chat_text(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    m = F.col("m")
    return c.select("conv_id", x.chat_lines(m).alias("chat"), x.chat_user_text(m).alias("asked"), x.chat_contents(m).alias("contents"))
