"""Score-matrix queries: line items; q = supplier, rollout, criterion and answer from key modulo, score = mean of quantity % 11."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import completion
from gradeloom.operators import scores as s
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table
from gradeloom.plans.sources import work_dir


def matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 3).alias("rollout"), (F.col("l_linenumber") % 4).alias("crit"), (F.col("l_orderkey") % 5).alias("answer")]
    return li.groupBy(*keys).agg(F.avg(F.col("l_quantity") % 11).alias("score")).withColumn("is_gold", F.col("answer") == 4)


M = "s AS (SELECT l_suppkey AS q, l_partkey % 3 AS rollout, l_linenumber % 4 AS crit, l_orderkey % 5 AS answer, avg(l_quantity % 11) AS score, l_orderkey % 5 = 4 AS is_gold FROM lineitem GROUP BY ALL)"
ST = M + """, st AS (SELECT q, rollout, crit, count(*) FILTER (NOT is_gold) AS n, stddev_pop(score) FILTER (NOT is_gold) AS std, max(score) FILTER (is_gold) AS gold, avg(score) FILTER (NOT is_gold) AS mean FROM s GROUP BY ALL),
    d AS (SELECT *, n >= 2 AND coalesce(std, 0) >= 0.5 AS disc, max((n >= 2 AND coalesce(std, 0) >= 0.5)::int) OVER (PARTITION BY q, rollout) AS any_disc FROM st)"""


@query(f"WITH {M}, r AS (SELECT DISTINCT q, rollout FROM s) SELECT a.q, a.rollout, b.rollout AS answer, false AS is_gold FROM r a JOIN r b USING (q) WHERE a.rollout <> b.rollout UNION ALL SELECT q, rollout, -1, true FROM r WHERE q % 2 = 0")
def score_evaluation_pairs(spark, sf_dir):
    r = matrix(spark, sf_dir).select("q", "rollout").distinct()
    return s.evaluation_pairs(r, r.filter("q % 2 = 0"))


@query(f"""WITH {M}, p AS (SELECT a.q, a.rollout, a.crit AS a, b.crit AS b, rank() OVER w1 + (count(*) OVER (PARTITION BY a.q, a.rollout, a.crit, b.crit, a.score) - 1) / 2 AS x, rank() OVER w2 + (count(*) OVER (PARTITION BY a.q, a.rollout, a.crit, b.crit, b.score) - 1) / 2 AS y
    FROM s a JOIN s b ON a.q = b.q AND a.rollout = b.rollout AND a.answer = b.answer AND a.crit < b.crit WINDOW w1 AS (PARTITION BY a.q, a.rollout, a.crit, b.crit ORDER BY a.score), w2 AS (PARTITION BY a.q, a.rollout, a.crit, b.crit ORDER BY b.score))
    SELECT q, rollout, a, b, round((avg(x * y) - avg(x) * avg(y)) / sqrt(var_pop(x) * var_pop(y)), 4) AS rho FROM p GROUP BY ALL
    HAVING count(*) >= 3 AND CASE WHEN var_pop(x) * var_pop(y) > 0 THEN (avg(x * y) - avg(x) * avg(y)) / sqrt(var_pop(x) * var_pop(y)) END > 0.8001""")
def score_redundant_edges(spark, sf_dir):
    return rounded(s.redundant_edges(matrix(spark, sf_dir), 0.8001))


# A little above 0.8, which rank correlations of few answers often are up to the last bit.
THRESHOLD = 0.8001
CLUSTERS = f"""{M}, p AS (SELECT a.q, a.rollout, a.crit AS a, b.crit AS b, rank() OVER w1 + (count(*) OVER (PARTITION BY a.q, a.rollout, a.crit, b.crit, a.score) - 1) / 2 AS x, rank() OVER w2 + (count(*) OVER (PARTITION BY a.q, a.rollout, a.crit, b.crit, b.score) - 1) / 2 AS y
    FROM s a JOIN s b ON a.q = b.q AND a.rollout = b.rollout AND a.answer = b.answer AND a.crit < b.crit WINDOW w1 AS (PARTITION BY a.q, a.rollout, a.crit, b.crit ORDER BY a.score), w2 AS (PARTITION BY a.q, a.rollout, a.crit, b.crit ORDER BY b.score)),
    e AS (SELECT q, rollout, a, b FROM p GROUP BY ALL HAVING count(*) >= 3 AND CASE WHEN var_pop(x) * var_pop(y) > 0 THEN (avg(x * y) - avg(x) * avg(y)) / sqrt(var_pop(x) * var_pop(y)) END > {THRESHOLD}),
    ways AS (SELECT q, rollout, a, b FROM e UNION SELECT q, rollout, b, a FROM e), crits AS (SELECT DISTINCT q, rollout, crit FROM s),
    reach AS (SELECT q, rollout, crit, crit AS other FROM crits UNION SELECT r.q, r.rollout, r.crit, n.b FROM reach r JOIN ways n ON n.q = r.q AND n.rollout = r.rollout AND n.a = r.other),
    k AS (SELECT q, rollout, crit, min(other) AS rep FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CLUSTERS} SELECT q, rollout, crit, rep, round(1 / count(*) OVER (PARTITION BY q, rollout, rep), 4) AS weight FROM k")
def score_duplicate_weights(spark, sf_dir):
    return rounded(s.duplicate_weights(s.criterion_clusters(matrix(spark, sf_dir), THRESHOLD)).select("q", "rollout", "crit", "rep", "weight"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT round(avg(r), 4) AS unique_rate FROM (SELECT count(DISTINCT rep) / count(*) AS r FROM k GROUP BY q, rollout)")
def score_unique_rate(spark, sf_dir):
    return rounded(s.unique_rate(s.criterion_clusters(matrix(spark, sf_dir), THRESHOLD)))


# A std that is the floor itself counts as such, whatever its last bit.
ST_AT_9 = ST.replace("coalesce(std, 0) >= 0.5", "coalesce(round(std, 9), 0) >= 0.5")


@query(f"WITH {ST_AT_9}, p AS (SELECT s.q, s.rollout, answer, avg(score) AS v FROM s JOIN d USING (q, rollout, crit) WHERE NOT is_gold AND (disc OR any_disc = 0) GROUP BY ALL) SELECT q, rollout, round(avg(v) + 1e-9, 4) AS consensus FROM p GROUP BY ALL")
def score_consensus(spark, sf_dir):
    """The 1e-9 keeps means that end in an exact half away from the rounding, which the order of their sums would decide."""
    m = matrix(spark, sf_dir)
    return rounded(s.consensus(m, s.criterion_stats(m)).withColumn("consensus", F.col("consensus") + 1e-9))


@query(f"WITH {ST} SELECT q, rollout, round(coalesce(avg(CASE WHEN n >= 2 THEN CASE WHEN std < 0.5 THEN 0 ELSE greatest(std - 0.5, 0) ** 1.5 END END), 0), 4) AS disc FROM st GROUP BY ALL")
def score_discrimination(spark, sf_dir):
    return rounded(s.discrimination(s.criterion_stats(matrix(spark, sf_dir))))


@query(f"WITH {ST} SELECT q, rollout, round(coalesce(avg(CASE WHEN n > 0 THEN gold - mean END), 0) * 2, 4) AS gold_disc FROM st GROUP BY ALL")
def score_gold_discrimination(spark, sf_dir):
    return rounded(s.gold_discrimination(s.criterion_stats(matrix(spark, sf_dir))))


@query(f"WITH {M}, r AS (SELECT q, rollout, avg((score <= 0.5 OR score >= 9.5)::int) AS b FROM s GROUP BY ALL) SELECT q, rollout, round(b, 4) AS binary_ratio, round(0 - 2 * greatest(b - 0.5, 0), 4) + 0.0 AS calibration FROM r")
def score_calibration(spark, sf_dir):
    out = rounded(s.calibration(matrix(spark, sf_dir)))
    return out.withColumn("calibration", F.col("calibration") + 0.0)


@query("SELECT p_partkey, (length(p_name) < 9)::int + (length(p_type) < 9)::int AS n_short, round(((length(p_name) < 9)::int + (length(p_type) < 9)::int) * -0.1, 4)::double + 0.0 AS crit_len_penalty, round(CASE WHEN p_size < 30 THEN -1.0 * (1 - p_size / 30) ELSE 0 END, 4)::double AS resp_len_penalty FROM part")
def score_short_penalties(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("texts", F.array("p_name", "p_type"))
    out = rounded(s.short_penalties(parts, "texts", "p_size", s.REWARD | {"min_chars": 9, "min_tokens": 30}).select("p_partkey", "n_short", "crit_len_penalty", "resp_len_penalty"))
    return out.withColumn("crit_len_penalty", F.col("crit_len_penalty") + 0.0)


@query()
def score_rewards(spark, sf_dir):
    m = matrix(spark, sf_dir)
    rollouts = m.groupBy("q", "rollout").agg((F.max("crit") / -10.0).alias("qa")).withColumn("parrot_flag", (F.col("q") + F.col("rollout")) % 7 == 0)
    return rounded(s.rewards(m, rollouts))


@query("""WITH c AS (SELECT o_custkey AS q, o_orderkey AS rollout, list_distinct([o_orderpriority, o_orderstatus, (o_orderkey % 3)::varchar]) AS c FROM orders),
    p AS (SELECT a.q, a.rollout, avg(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c)))) AS j FROM c a JOIN c b ON a.q = b.q AND a.rollout <> b.rollout GROUP BY ALL)
    SELECT c.q, c.rollout, round(coalesce(1 - j, 0), 6) AS diversity FROM c LEFT JOIN p USING (q, rollout)""")
def score_concept_diversity(spark, sf_dir):
    concepts = F.array_distinct(F.array("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 3).cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("rollout"), concepts.alias("concepts"))
    return rounded(s.concept_diversity(rows, "concepts"), 6)


@query()
def score_matrix_completion(spark, sf_dir):
    """The 1e-9 is that of score_consensus."""
    m = matrix(spark, sf_dir).select("q", F.col("crit").alias("row"), F.col("answer").alias("col"), "score")
    return rounded(completion.complete_scores(m, work_dir(spark)).withColumn("score", F.col("score") + 1e-9), 3)
