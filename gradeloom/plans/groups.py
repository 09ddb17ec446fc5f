"""Group-relative queries: orders; uid = customer, score = total price over 997 (no round numbers, so no ties at rounding), length = number of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import groups as g
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table


def orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("length"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 997).alias("score"))
    return o.join(lines, "sample_id", "left").select("sample_id", "uid", "score", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


O = """o AS (SELECT o_orderkey AS sample_id, o_custkey AS uid, o_totalprice / 997 AS score, coalesce(length, 0) AS length, coalesce(quantity, 0) AS quantity,
    count(*) OVER (PARTITION BY o_custkey) AS n, avg(o_totalprice / 997) OVER (PARTITION BY o_custkey) AS m, stddev_samp(o_totalprice / 997) OVER (PARTITION BY o_custkey) AS sd,
    avg(coalesce(quantity, 0)) OVER (PARTITION BY o_custkey) AS qm, stddev_samp(coalesce(quantity, 0)) OVER (PARTITION BY o_custkey) AS qsd
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS length, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def sql(expr: str, source: str = "o", extra: str = "") -> str:
    return f"WITH {O}{extra} SELECT sample_id, uid, round({expr}, 4) AS advantage FROM {source}"


def out(df):
    return rounded(df.select("sample_id", "uid", "advantage"))


@query(sql("CASE WHEN n = 1 THEN score / 1.000001 ELSE (score - m) / (sd + 1e-6) END"))
def group_grpo(spark, sf_dir):
    return out(g.get_estimator("grpo")(orders(spark, sf_dir)))


@query(sql("CASE WHEN n = 1 THEN score ELSE score - m END"))
def group_grpo_without_std(spark, sf_dir):
    return out(g.grpo(orders(spark, sf_dir), by_std=False))


@query(sql("CASE WHEN n = 1 THEN score / 1.000001 ELSE (score - m) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END"))
def group_grpo_vectorized(spark, sf_dir):
    return out(g.grpo_vectorized(orders(spark, sf_dir)))


@query(sql("CASE WHEN n = 1 THEN (score + 2 * quantity - 0.5 * length) / 1.000001 ELSE (score - m) / (sd + 1e-6) + 2 * (quantity - qm) / (qsd + 1e-6) - 0.5 * (length - lm) / (lsd + 1e-6) END",
    "l", ", l AS (SELECT *, avg(length) OVER (PARTITION BY uid) AS lm, stddev_samp(length) OVER (PARTITION BY uid) AS lsd FROM o)"))
def group_gdpo(spark, sf_dir):
    return out(g.gdpo(orders(spark, sf_dir), {"score": 1.0, "quantity": 2.0, "length": -0.5}))


@query(sql("CASE WHEN n = 1 THEN 0 ELSE (score - m) / (psd + 1e-6) END", "p", ", p AS (SELECT *, stddev_pop(score) OVER (PARTITION BY uid) AS psd FROM o)"))
def group_display_form(spark, sf_dir):
    return out(g.normalise_for_display(orders(spark, sf_dir)))


@query(sql("CASE WHEN n < 2 THEN NULL WHEN r = 1 THEN score - nxt ELSE 0 END", "p", ", p AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY uid ORDER BY score DESC, sample_id))"))
def group_pass_at_k(spark, sf_dir):
    return out(g.pass_at_k(orders(spark, sf_dir), strict=False))


@query(sql("(x - mean) / sqrt(var + 1e-8)", "x, t", """, x AS (SELECT *, CASE WHEN n = 1 THEN score ELSE score - m END AS x FROM o),
    t AS (SELECT sum(length * x) / sum(length) AS mean, (sum(length * x * x) / sum(length) - (sum(length * x) / sum(length)) ** 2) * sum(length) / (sum(length) - 1) AS var FROM x)"""))
def group_mean_baseline(spark, sf_dir):
    return out(g.mean_baseline(orders(spark, sf_dir)))


@query(sql("CASE WHEN n = 1 THEN score ELSE (score - m) * n / (n - 1) END"))
def group_rloo(spark, sf_dir):
    return out(g.rloo(orders(spark, sf_dir)))


@query(sql("CASE WHEN n = 1 THEN 0 ELSE (n * score - n * m) / (n - 1) END"))
def group_rloo_vectorized(spark, sf_dir):
    return out(g.rloo_vectorized(orders(spark, sf_dir)))


@query(sql("CASE WHEN n = 1 THEN score ELSE score - ws / nullif(w, 0) END", "p", ", p AS (SELECT *, sum(length * score) OVER (PARTITION BY uid) AS ws, sum(length) OVER (PARTITION BY uid) AS w FROM o)"))
def group_opo(spark, sf_dir):
    return out(g.opo(orders(spark, sf_dir)))


@query(sql("alpha * (score - CASE WHEN n = 1 THEN 0 ELSE m END) / 2", "o, a", ", a AS (SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) AS alpha FROM o)"))
def group_gpg(spark, sf_dir):
    return out(g.gpg(orders(spark, sf_dir), f_norm=2.0))
