"""Token queries: line items; sample = order, pos = place in the order, log-probs -discount, -tax, mask = returned or not."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import tokens as t
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table


def tokens(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return li.select(F.col("l_orderkey").alias("sample_id"), pos.cast("long").alias("pos"), (F.col("l_returnflag") != "N").cast("int").alias("mask"), F.col("l_quantity").alias("reward"), (F.col("l_extendedprice") / 997).alias("value"),
        (-F.col("l_discount") * 10).alias("old_logp"), (-F.col("l_tax") * 10).alias("ref_logp"), (-F.col("l_tax") * 12 + 0.01).alias("rollout_logp"), (F.col("l_quantity") / 7 - 3.5).alias("advantage"), F.col("l_linestatus").alias("token"))


T = """t AS (SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
    (l_returnflag <> 'N')::int AS mask, l_quantity AS reward, l_extendedprice / 997 AS value, -l_discount * 10 AS old_logp, -l_tax * 10 AS ref_logp, -l_tax * 12 + 0.01 AS rollout_logp,
    l_quantity / 7 - 3.5 AS advantage, l_linestatus AS token, (-l_discount * 10) - (-l_tax * 12 + 0.01) AS lr FROM lineitem)"""
MM = "coalesce(sum({}) FILTER (mask = 1), 0) / (sum(mask) + 1e-8)"


@query(f"WITH {T} SELECT count(*) FILTER (mask = 1) AS n, round(sum(advantage) FILTER (mask = 1), 4) AS sum, round({MM.format('advantage')}, 6) AS mean, round(var_samp(advantage) FILTER (mask = 1), 6) AS variance, round(max(advantage) FILTER (mask = 1), 4) AS max, round(min(advantage) FILTER (mask = 1), 4) AS min FROM t")
def token_masked_stats(spark, sf_dir):
    s = t.masked_stats(tokens(spark, sf_dir), "advantage")
    return s.select("n", *[F.round(c, n).alias(c) for c, n in (("sum", 4), ("mean", 6), ("variance", 6), ("max", 4), ("min", 4))])


@query(f"WITH {T}, m AS (SELECT {MM.format('advantage')} AS m, var_samp(advantage) FILTER (mask = 1) AS v FROM t) SELECT sample_id, pos, round((advantage - m) / sqrt(v + 1e-8), 4) AS white FROM t, m")
def token_whiten(spark, sf_dir):
    return rounded(t.whiten(tokens(spark, sf_dir), "advantage", "white").select("sample_id", "pos", "white"))


@query(f"""WITH {T}, s AS (SELECT sample_id, coalesce(sum(reward) FILTER (mask = 1), 0) AS s, sum(mask) AS n, count(*) AS length FROM t GROUP BY 1)
    SELECT round(sum(s) / sum(n), 4) AS token_mean, round(avg(s) FILTER (n > 0), 4) AS seq_mean_token_sum, round(avg(s / (n + 1e-8)) FILTER (n > 0), 4) AS seq_mean_token_mean, round(sum(s) / max(length), 4) AS seq_mean_token_sum_norm FROM s""")
def token_loss_modes(spark, sf_dir):
    losses = t.aggregate_losses(tokens(spark, sf_dir), "reward")
    return rounded(losses.toDF(*[mode.replace("-", "_") for mode in t.LOSS_MODES]))


@query(f"""WITH {T}, k AS (SELECT mask, old_logp - ref_logp AS d, greatest(least(ref_logp - old_logp, 20), -20) AS c FROM t)
    SELECT round({MM.format('d')}, 6) AS k1, round({MM.format('abs(d)')}, 6) AS abs, round({MM.format('0.5 * d * d')}, 6) AS k2, round({MM.format('greatest(least(exp(c) - c - 1, 10), -10)')}, 6) AS k3 FROM k""")
def token_kl_estimators(spark, sf_dir):
    o, r = F.col("old_logp"), F.col("ref_logp")
    return rounded(tokens(spark, sf_dir).agg(*[t.masked_mean(t.kl_estimate(o, r, k)).alias(k) for k in ("k1", "abs", "k2", "k3")]), 6)


@query(f"WITH {T} SELECT sample_id, pos, round((old_logp - ref_logp) * mask, 4) AS kl, round(reward - 0.13 * (old_logp - ref_logp) * mask, 4) AS reward FROM t")
def token_penalised_rewards(spark, sf_dir):
    return rounded(t.penalised_rewards(tokens(spark, sf_dir), 0.13).select("sample_id", "pos", "kl", "reward"))


@query(f"WITH {T} SELECT round(avg(k), 6) AS mean_kl FROM (SELECT {MM.format('old_logp - ref_logp')} AS k FROM t GROUP BY sample_id)")
def token_mean_kl(spark, sf_dir):
    return rounded(t.mean_kl(t.penalised_rewards(tokens(spark, sf_dir), 0.13)), 6)


@query(f"WITH {T}, w AS (SELECT *, least(exp(greatest(least(lr, 20), -20)) * mask, 1.7) AS w FROM t), m AS (SELECT {MM.format('w')} AS m FROM w) SELECT sample_id, pos, round(w / m, 4) AS weight FROM w, m")
def token_importance_weights(spark, sf_dir):
    return rounded(t.importance_weights(tokens(spark, sf_dir), "token", 1.7, normalise=True).select("sample_id", "pos", "weight"))


@query(f"WITH {T}, s AS (SELECT *, sum(lr * mask) OVER (PARTITION BY sample_id) AS slr FROM t) SELECT sample_id, pos, round(least(exp(greatest(least(slr, 20), -20)) * mask, 1.7), 4) AS weight FROM s")
def sequence_importance_weights(spark, sf_dir):
    return rounded(t.importance_weights(tokens(spark, sf_dir), "sequence", 1.7).select("sample_id", "pos", "weight"))


def _rejected(level_sql: str) -> str:
    return f"""WITH {T}, s AS (SELECT *, {level_sql} AS x FROM t), a AS (SELECT *, (exp(greatest(least(x, 20), -20)) BETWEEN 1 / 1.7 AND 1.7)::int AS ok FROM s),
        q AS (SELECT sum(mask * (1 - ok)) AS bad, sum(mask) AS n FROM a GROUP BY sample_id) SELECT round(sum(bad) / (sum(n) + 1e-8), 6) AS token_fraction, round(avg((bad > 0)::int), 6) AS sequence_fraction FROM q"""


@query(_rejected("lr"))
def token_rejection(spark, sf_dir):
    return rounded(t.rejected_fractions(t.rejection_mask(tokens(spark, sf_dir), "token", 1.7)), 6)


@query(_rejected("sum(lr * mask) OVER (PARTITION BY sample_id)"))
def sequence_rejection(spark, sf_dir):
    return rounded(t.rejected_fractions(t.rejection_mask(tokens(spark, sf_dir), "sequence", 1.7)), 6)


@query(_rejected("sum(lr * mask) OVER (PARTITION BY sample_id) / (sum(mask) OVER (PARTITION BY sample_id) + 1e-8)"))
def geometric_rejection(spark, sf_dir):
    return rounded(t.rejected_fractions(t.rejection_mask(tokens(spark, sf_dir), "geometric", 1.7)), 6)


@query(f"""WITH {T}, w AS (SELECT *, exp(greatest(least(lr, 20), -20)) * mask AS w FROM t), q AS (SELECT {MM.format('w')} AS s FROM w GROUP BY sample_id),
    a AS (SELECT avg(w) AS mean, stddev_pop(w) AS std, max(w) AS max, min(w) AS min, avg((w > 2)::int) AS high, avg((w < 0.5)::int) AS low, avg(greatest(least(w, 2), 0.5)) ** 2 / avg(greatest(least(w, 2), 0.5) ** 2) AS ess FROM w WHERE mask = 1),
    b AS (SELECT avg(s) AS seq_mean, stddev_samp(s) AS seq_std, max(s) AS seq_max, min(s) AS seq_min FROM q)
    SELECT {', '.join(f'round({c}, 5) AS {c}' for c in ('mean', 'std', 'max', 'min', 'high', 'low', 'ess', 'seq_mean', 'seq_std', 'seq_max', 'seq_min'))} FROM a, b""")
def token_weight_diagnostics(spark, sf_dir):
    return rounded(t.weight_diagnostics(t.importance_weights(tokens(spark, sf_dir), "token")), 5)


@query(f"WITH {T} SELECT sample_id, pos, CASE WHEN bool_or(lr < ln(0.51) AND mask = 1) OVER (PARTITION BY sample_id) THEN 0 ELSE mask END AS new_mask FROM t")
def token_veto(spark, sf_dir):
    return t.veto(tokens(spark, sf_dir), 0.51).select("sample_id", "pos", "new_mask")


@query(f"""WITH {T}, q AS (SELECT {MM.format('old_logp')} AS t, {MM.format('rollout_logp')} AS r, coalesce(sum(lr) FILTER (mask = 1), 0) AS lr, sum(mask) AS n, coalesce(sum(exp(lr) - lr - 1) FILTER (mask = 1), 0) AS k3, coalesce(sum(exp(2 * lr)) FILTER (mask = 1), 0) AS sq FROM t GROUP BY sample_id)
    SELECT round(avg(exp(-t)), 5) AS training_ppl, round(avg(-t), 5) AS training_log_ppl, round(-sum(lr) / (sum(n) + 1e-8), 5) AS kl, round(sum(k3) / (sum(n) + 1e-8), 5) AS k3_kl, round(avg(exp(-r)), 5) AS rollout_ppl, round(avg(-r), 5) AS rollout_log_ppl,
        round(avg(r - t), 5) AS log_ppl_diff, round(avg(abs(r - t)), 5) AS log_ppl_abs_diff, round(max(r - t), 5) AS log_ppl_diff_max, round(min(r - t), 5) AS log_ppl_diff_min, round(avg(exp(r - t)), 5) AS ppl_ratio,
        round(sum(sq) / (sum(n) + 1e-8) - 1, 5) AS chi2_token, round(avg(exp(2 * greatest(least(lr, 20), -20))) - 1, 5) AS chi2_seq FROM q""")
def token_off_policy(spark, sf_dir):
    return rounded(t.off_policy(tokens(spark, sf_dir)), 5)


@query(f"""WITH {T}, c AS (SELECT mask, advantage AS a, greatest(least(lr, 20), -20) AS kl, exp(greatest(least(lr, 20), -20)) AS r FROM t),
    d AS (SELECT *, -a * r AS p, -a * greatest(least(r, 1.2), 0.8) AS q FROM c)
    SELECT round({MM.format('(q > p)::int')}, 6) AS clip_fraction, round({MM.format('(greatest(p, q) > -a * 3 AND a < 0)::int')}, 6) AS lower_clip_fraction, round({MM.format('-kl')}, 6) AS approx_kl FROM d""")
def token_clip_diagnostics(spark, sf_dir):
    return rounded(t.clip_diagnostics(tokens(spark, sf_dir)), 6)


@query(f"""WITH {T}, x AS (SELECT exp(old_logp) AS p, exp(rollout_logp) AS q FROM t WHERE mask = 1)
    SELECT round(max(abs(p - q)), 6) AS diff_max, round(avg(abs(p - q)), 6) AS diff_mean, round(stddev_samp(abs(p - q)), 6) AS diff_std, round((avg(p * q) - avg(p) * avg(q)) / sqrt(var_pop(p) * var_pop(q)), 6) AS pearson FROM x""")
def token_probability_difference(spark, sf_dir):
    return rounded(t.probability_difference(tokens(spark, sf_dir)), 6)


@query(f"WITH {T} SELECT sample_id, count(*) FILTER (mask = 1 AND old_logp <> ref_logp) AS n FROM t GROUP BY 1")
def token_differences(spark, sf_dir):
    return t.differing_tokens(tokens(spark, sf_dir), "old_logp", "ref_logp")


@query(f"""WITH RECURSIVE {T}, z AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS k FROM t),
    r AS (SELECT sample_id, pos, mask, k, reward AS returns FROM z WHERE k = 1 UNION ALL SELECT z.sample_id, z.pos, z.mask, z.k, z.reward + 0.9 * r.returns * r.mask FROM r JOIN z ON z.sample_id = r.sample_id AND z.k = r.k + 1)
    SELECT sample_id, pos, round(returns, 3) AS returns FROM r""")
def token_discounted_returns(spark, sf_dir):
    return rounded(t.discounted_returns(tokens(spark, sf_dir), 0.9).select("sample_id", F.col("pos").cast("long").alias("pos"), "returns"), 3)


@query(f"WITH {T}, s AS (SELECT *, sum(reward * mask) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS ret FROM t) SELECT sample_id, pos, round(ret, 4) AS returns, round((ret - value) * mask, 4) AS advantage FROM s")
def token_remax(spark, sf_dir):
    return rounded(t.remax(tokens(spark, sf_dir), "value").select("sample_id", "pos", "returns", "advantage"))


@query(f"""WITH RECURSIVE {T}, z AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS k FROM t),
    r AS (SELECT sample_id, pos, k, CASE WHEN mask = 1 THEN value ELSE 0 END AS nv, CASE WHEN mask = 1 THEN reward - value ELSE 0 END AS g, value FROM z WHERE k = 1
        UNION ALL SELECT z.sample_id, z.pos, z.k, CASE WHEN z.mask = 1 THEN z.value ELSE r.nv END, CASE WHEN z.mask = 1 THEN z.reward + 0.9 * r.nv - z.value + 0.9 * 0.8 * r.g ELSE r.g END, z.value FROM r JOIN z ON z.sample_id = r.sample_id AND z.k = r.k + 1)
    SELECT sample_id, pos, round(g, 3) AS gae, round(g + value, 3) AS returns FROM r""")
def token_gae(spark, sf_dir):
    return rounded(t.gae(tokens(spark, sf_dir), 0.9, 0.8).select("sample_id", F.col("pos").cast("long").alias("pos"), "gae", "returns"), 3)


@query(f"WITH {T} SELECT sample_id, pos, (sum((token = 'O')::int) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - (token = 'O')::int = 0)::int AS response_mask FROM t")
def token_response_mask(spark, sf_dir):
    return t.response_mask(tokens(spark, sf_dir), "token", F.lit("O")).select("sample_id", "pos", "response_mask")


@query(f"WITH {T} SELECT sample_id, pos, greatest(sum(mask) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1, 0)::bigint AS position_id FROM t")
def token_position_ids(spark, sf_dir):
    return t.position_ids(tokens(spark, sf_dir)).select("sample_id", "pos", "position_id")


@query(f"WITH {T} SELECT sample_id, round(least(-(count(*) - 3.0) / 2.0 * 1.5, 0), 4) AS penalty FROM t GROUP BY 1")
def token_overlong_penalty(spark, sf_dir):
    lengths = tokens(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(lengths.select("sample_id", t.overlong_penalty(F.col("n"), 3.0, 2.0, 1.5).alias("penalty")))


@query(f"WITH {T} SELECT sample_id, pos, CASE WHEN pos = max(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY sample_id) THEN reward ELSE 0 END AS token_score FROM t")
def token_score_on_last(spark, sf_dir):
    return t.place_score(tokens(spark, sf_dir), "reward").select("sample_id", "pos", "token_score")


@query(f"""WITH {T}, m AS (SELECT avg(advantage) AS a, avg(old_logp) AS l, greatest(floor(count(*) * 0.02), 1) AS k FROM t WHERE mask = 1)
    SELECT sample_id, pos, round(cov, 4) AS cov FROM (SELECT sample_id, pos, cov, k, row_number() OVER (ORDER BY round(cov, 9) DESC, sample_id, pos) AS r FROM (SELECT *, (advantage - a) * (old_logp - l) AS cov FROM t, m WHERE mask = 1)) WHERE r <= k""")
def token_top_covariance(spark, sf_dir):
    return rounded(t.top_covariance(tokens(spark, sf_dir), 0.02))
