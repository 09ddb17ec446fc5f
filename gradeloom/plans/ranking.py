"""Ranking queries: documents joined to labels; prompt = source, ord = doc_id, score = n_chars or word count, label = quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import ranking as r
from gradeloom.plans.registry import query, table


def labelled(spark: SparkSession, sf_dir: str, score: str = "chars") -> DataFrame:
    value = F.col("n_chars") if score == "chars" else F.size(F.split("text", " "))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("source").alias("prompt"), value.cast("double").alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("prompt", F.col("doc_id").alias("ord"), "score", F.col("quality").cast("double").alias("label"))


L = """labelled AS (
    SELECT source AS prompt, doc_id AS ord, n_chars::double AS score, quality::double AS label, len(string_split(text, ' '))::double AS words
    FROM documents JOIN labels USING (doc_id))"""
PAIRS = L + """, pairs AS (
    SELECT a.prompt, a.score AS sa, b.score AS sb, a.words AS wa, b.words AS wb, a.label AS la, b.label AS lb
    FROM labelled a JOIN labelled b ON a.prompt = b.prompt AND a.ord < b.ord AND a.label <> b.label)"""
CREDIT = "CASE WHEN sa = sb THEN 0.5 WHEN (la > lb) = (sa > sb) THEN 1.0 ELSE 0.0 END"
WORD_CREDIT = "CASE WHEN wa = wb THEN 0.5 WHEN (la > lb) = (wa > wb) THEN 1.0 ELSE 0.0 END"
PER_PROMPT = PAIRS + f""", per_prompt AS (
    SELECT p.prompt, coalesce(avg({CREDIT}), 0) AS acc, coalesce(avg({WORD_CREDIT}), 0) AS word_acc, coalesce(avg(abs(sa - sb)), 0) AS resolution, count(sa) AS pairs_used
    FROM (SELECT DISTINCT prompt FROM labelled) p LEFT JOIN pairs USING (prompt) GROUP BY p.prompt)"""
RANKS = L + """, ranked AS (
    SELECT *, rank() OVER (PARTITION BY prompt ORDER BY score) + (count(*) OVER (PARTITION BY prompt, score) - 1) / 2 AS rs,
        rank() OVER (PARTITION BY prompt ORDER BY label) + (count(*) OVER (PARTITION BY prompt, label) - 1) / 2 AS rl FROM labelled)"""


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {PER_PROMPT} SELECT count(*) AS n_prompts, round(avg(acc), 4) AS pairwise_acc, round(avg(resolution), 4) AS resolution FROM per_prompt")
def pairwise_summary(spark, sf_dir):
    return rounded(r.macro_mean(r.pairwise_metrics(labelled(spark, sf_dir)), ["pairwise_acc", "resolution"]))


@query(f"WITH {PER_PROMPT} SELECT prompt, round(acc, 4) AS pairwise_acc, round(resolution, 4) AS resolution, pairs_used FROM per_prompt")
def pairwise_by_prompt(spark, sf_dir):
    return rounded(r.pairwise_metrics(labelled(spark, sf_dir)))


@query(f"WITH {PER_PROMPT} SELECT count(*) AS n_prompts, round(avg(acc), 4) AS pairwise_acc FROM per_prompt WHERE pairs_used > 0")
def pairwise_dropping_empty(spark, sf_dir):
    return rounded(r.macro_mean(r.pairwise_metrics(labelled(spark, sf_dir), keep_empty=False), ["pairwise_acc"]))


@query(f"""WITH {PAIRS} SELECT t AS threshold, round(avg({CREDIT}), 4) AS accuracy, count(*) AS n_pairs
    FROM pairs, (VALUES (0.1::double), (0.2::double), (0.3::double)) v(t) WHERE abs(la - lb) >= t GROUP BY t""")
def confident_pairs_pooled(spark, sf_dir):
    return rounded(r.confident_pairs_pooled(labelled(spark, sf_dir)))


@query(f"""WITH {PAIRS} SELECT round(avg(a), 4) AS accuracy, count(*) AS n_prompts FROM (
    SELECT prompt, avg({CREDIT}) AS a FROM pairs WHERE abs(la - lb) > 0.2 GROUP BY prompt)""")
def confident_pairs_by_prompt(spark, sf_dir):
    return rounded(r.confident_pairs_by_prompt(labelled(spark, sf_dir)).agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n_prompts")))


@query(f"""WITH {L} SELECT prompt, round(avg(score) FILTER (label = hi) - avg(score) FILTER (label = lo), 4) AS gap FROM (
    SELECT *, max(label) OVER (PARTITION BY prompt) AS hi, min(label) OVER (PARTITION BY prompt) AS lo FROM labelled) WHERE hi > lo GROUP BY prompt""")
def top_bottom_gap(spark, sf_dir):
    return rounded(r.top_bottom_gap(labelled(spark, sf_dir)))


RHO = "CASE WHEN var_pop({0}) * var_pop({1}) > 0 THEN (avg({0} * {1}) - avg({0}) * avg({1})) / sqrt(var_pop({0}) * var_pop({1})) END"


@query(f"WITH {RANKS} SELECT prompt, round({RHO.format('rs', 'rl')}, 4) AS rho, count(*) AS n FROM ranked GROUP BY prompt HAVING count(*) >= 2")
def spearman_by_prompt(spark, sf_dir):
    return rounded(r.spearman(labelled(spark, sf_dir)))


@query(f"""WITH {L} SELECT prompt, round(CASE WHEN x * y > 0 THEN net / sqrt(x * y) END, 4) AS tau FROM (
    SELECT a.prompt, sum(sign(a.score - b.score) * sign(a.label - b.label))::double AS net, sum(abs(sign(a.score - b.score)))::double AS x, sum(abs(sign(a.label - b.label)))::double AS y
    FROM labelled a JOIN labelled b ON a.prompt = b.prompt AND a.ord < b.ord GROUP BY a.prompt)""")
def kendall_by_prompt(spark, sf_dir):
    return rounded(r.kendall_tau_b(labelled(spark, sf_dir)))


def _ndcg_sql(k: int) -> str:
    return f"""WITH {L}, places AS (
        SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, ord) AS r, row_number() OVER (PARTITION BY prompt ORDER BY label DESC, ord) AS i FROM labelled)
        SELECT prompt, round(CASE WHEN sum(CASE WHEN i <= {k} THEN label / log2(i + 1) ELSE 0 END) > 0 THEN
            sum(CASE WHEN r <= {k} THEN label / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= {k} THEN label / log2(i + 1) ELSE 0 END) ELSE 0 END, 4) AS ndcg
        FROM places GROUP BY prompt HAVING count(*) >= 4 AND min(label) < max(label)"""


@query(_ndcg_sql(4))
def ndcg_at_4(spark, sf_dir):
    return rounded(r.ndcg(labelled(spark, sf_dir), 4, min_rows=4))


@query(f"""WITH {L}, places AS (
    SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, ord) AS r, row_number() OVER (PARTITION BY prompt ORDER BY label DESC, ord) AS i FROM labelled),
    shared AS (SELECT *, avg(CASE WHEN r <= 4 THEN 1 / log2(r + 1) ELSE 0 END) OVER (PARTITION BY prompt, score) AS d FROM places)
    SELECT prompt, round(CASE WHEN sum(label * CASE WHEN i <= 4 THEN 1 / log2(i + 1) ELSE 0 END) > 0 THEN sum(label * d) / sum(label * CASE WHEN i <= 4 THEN 1 / log2(i + 1) ELSE 0 END) ELSE 0 END, 4) AS ndcg
    FROM shared GROUP BY prompt HAVING min(label) < max(label)""")
def ndcg_tie_averaged(spark, sf_dir):
    return rounded(r.ndcg_tie_averaged(labelled(spark, sf_dir), 4))


@query(f"""WITH {RANKS} SELECT prompt, round((sum(rs) FILTER (label > 0.5) - p * (p + 1) / 2) / (p * (c - p)), 4) AS auc FROM (
    SELECT *, (count(*) FILTER (label > 0.5) OVER (PARTITION BY prompt))::double AS p, count(*) OVER (PARTITION BY prompt) AS c FROM ranked) WHERE p > 0 AND p < c GROUP BY prompt, p, c""")
def auroc_by_prompt(spark, sf_dir):
    return rounded(r.auroc(labelled(spark, sf_dir)))


@query(f"""WITH {L}, o AS (SELECT *, (count(*) FILTER (label <= 0.5) OVER (PARTITION BY prompt ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING))::double AS before FROM labelled)
    SELECT prompt, round(1 - sum(CASE WHEN label > 0.5 THEN before ELSE 0 END) / (count(*) FILTER (label > 0.5) * count(*) FILTER (label <= 0.5)), 4) AS auc
    FROM o GROUP BY prompt HAVING count(*) FILTER (label > 0.5) > 0 AND count(*) FILTER (label <= 0.5) > 0""")
def auroc_input_order(spark, sf_dir):
    return rounded(r.auroc_input_order(labelled(spark, sf_dir)))


@query(f"WITH {L} SELECT prompt, round(coalesce(var_samp(label), 0), 4) AS variance FROM labelled GROUP BY prompt")
def label_variance(spark, sf_dir):
    return rounded(r.label_variance(labelled(spark, sf_dir)))


@query(f"""WITH {L}, f AS (SELECT prompt, coalesce(var_samp(label), 0) AS v FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY ord) AS k FROM labelled) WHERE k <= 8 GROUP BY prompt)
    SELECT prompt, ord, score, label FROM labelled WHERE prompt IN (SELECT prompt FROM f WHERE v > 0.01)""")
def discriminative_prompts(spark, sf_dir):
    return r.discriminative(labelled(spark, sf_dir))


@query(f"WITH {L} SELECT count(*) AS n_prompts, count(*) FILTER (n >= 2) AS n_varied, round(count(*) FILTER (n >= 2) / count(*), 4) AS share FROM (SELECT prompt, count(DISTINCT floor(score)::bigint) AS n FROM labelled GROUP BY prompt)")
def score_sensitivity(spark, sf_dir):
    return rounded(r.score_sensitivity(labelled(spark, sf_dir)))


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return tuple(r.pairwise_metrics(labelled(spark, sf_dir, s)) for s in ("chars", "words"))


@query(f"WITH {PER_PROMPT} SELECT count(*) FILTER (acc > word_acc + 0.001) AS a_wins, count(*) FILTER (word_acc > acc + 0.001) AS b_wins, count(*) FILTER (abs(acc - word_acc) <= 0.001) AS ties, count(*) AS n FROM per_prompt")
def head_to_head(spark, sf_dir):
    return r.head_to_head(*_two(spark, sf_dir), "pairwise_acc")


@query(f"""WITH {PER_PROMPT} SELECT CASE WHEN acc < 0.5 THEN 'hard' ELSE 'easy' END AS subset, count(*) AS n, round(avg(acc), 4) AS a, round(avg(word_acc), 4) AS b
    FROM per_prompt WHERE acc < 0.5 OR acc >= 0.8 GROUP BY 1""")
def hard_easy_means(spark, sf_dir):
    return rounded(r.hard_easy_means(*_two(spark, sf_dir), "pairwise_acc"))


@query(f"""WITH {PER_PROMPT} SELECT right(prompt, 1) AS category, count(*) AS n, round(avg(acc), 4) AS chars, round(avg(word_acc), 4) AS words, round(avg(word_acc) - avg(acc), 4) AS delta,
    CASE WHEN avg(word_acc) - avg(acc) > 0.001 THEN 'words' WHEN avg(word_acc) - avg(acc) < -0.001 THEN 'chars' ELSE 'tie' END AS winner FROM per_prompt GROUP BY 1""")
def category_breakdown(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    both = a.select("prompt", F.col("pairwise_acc").alias("chars")).join(b.select("prompt", F.col("pairwise_acc").alias("words")), "prompt")
    return rounded(r.category_breakdown(both.withColumn("category", F.substring("prompt", -1, 1)), "category", "chars", "words"))


@query("""SELECT p_brand AS subset, round(avg(CASE WHEN p_retailprice > 40.0 * p_size THEN 1.0 WHEN p_retailprice = 40.0 * p_size THEN 0.5 ELSE 0.0 END), 4) AS accuracy, count(*) AS n
    FROM part GROUP BY ROLLUP (p_brand)""")
def preference_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("subset"), F.col("p_retailprice").alias("chosen"), (F.col("p_size") * 40.0).alias("rejected"))
    return rounded(r.preference_accuracy(rows, "chosen", "rejected", "subset"))


def _mode_sql(m: str, score: str) -> str:
    """The eight metrics of one scoring, as a CTE v_m (metric, v)."""
    return f"""l_{m} AS (SELECT prompt, ord, label, {score} AS score FROM labelled),
    p_{m} AS (SELECT a.prompt, a.score AS sa, b.score AS sb, a.label AS la, b.label AS lb FROM l_{m} a JOIN l_{m} b ON a.prompt = b.prompt AND a.ord < b.ord),
    pp_{m} AS (SELECT q.prompt, coalesce(avg({CREDIT}) FILTER (la <> lb), 0) AS acc, coalesce(avg(abs(sa - sb)) FILTER (la <> lb), 0) AS res, avg({CREDIT}) FILTER (abs(la - lb) > 0.2) AS conf,
        sum(sign(sa - sb) * sign(la - lb))::double AS net, sum(abs(sign(sa - sb)))::double AS x, sum(abs(sign(la - lb)))::double AS y FROM (SELECT DISTINCT prompt FROM l_{m}) q LEFT JOIN p_{m} USING (prompt) GROUP BY q.prompt),
    r_{m} AS (SELECT *, rank() OVER (PARTITION BY prompt ORDER BY score) + (count(*) OVER (PARTITION BY prompt, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY prompt ORDER BY label) + (count(*) OVER (PARTITION BY prompt, label) - 1) / 2 AS rl,
        row_number() OVER (PARTITION BY prompt ORDER BY score DESC, ord) AS r, row_number() OVER (PARTITION BY prompt ORDER BY label DESC, ord) AS i, max(label) OVER (PARTITION BY prompt) AS hi, min(label) OVER (PARTITION BY prompt) AS lo,
        (count(*) FILTER (label > 0.5) OVER (PARTITION BY prompt))::double AS p, count(*) OVER (PARTITION BY prompt) AS c FROM l_{m}),
    g_{m} AS (SELECT prompt, CASE WHEN count(*) >= 2 AND var_pop(rs) * var_pop(rl) > 0 THEN (avg(rs * rl) - avg(rs) * avg(rl)) / sqrt(var_pop(rs) * var_pop(rl)) END AS rho,
        CASE WHEN max(hi) > min(lo) THEN avg(score) FILTER (label = hi) - avg(score) FILTER (label = lo) END AS gap,
        CASE WHEN max(hi) > min(lo) AND count(*) >= 2 THEN CASE WHEN sum(CASE WHEN i <= 4 THEN label / log2(i + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN r <= 4 THEN label / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 4 THEN label / log2(i + 1) ELSE 0 END) ELSE 0 END END AS ndcg,
        CASE WHEN max(p) > 0 AND max(p) < max(c) THEN (sum(rs) FILTER (label > 0.5) - max(p) * (max(p) + 1) / 2) / (max(p) * (max(c) - max(p))) END AS auc FROM r_{m} GROUP BY prompt),
    v_{m} AS (SELECT 'pairwise_acc' AS metric, avg(acc) AS v FROM pp_{m} UNION ALL SELECT 'resolution', avg(res) FROM pp_{m} UNION ALL SELECT 'confident_acc', avg(conf) FROM pp_{m}
        UNION ALL SELECT 'kendall_tau_b', avg(CASE WHEN x * y > 0 THEN net / sqrt(x * y) END) FROM pp_{m} UNION ALL SELECT 'spearman', avg(rho) FROM g_{m} UNION ALL SELECT 'top_bottom_gap', avg(gap) FROM g_{m}
        UNION ALL SELECT 'ndcg@4', avg(ndcg) FROM g_{m} UNION ALL SELECT 'auroc', avg(auc) FROM g_{m})"""


@query(f"WITH {L}, {_mode_sql('c', 'score')}, {_mode_sql('w', 'words')} SELECT metric, round(v_c.v, 4) AS chars, round(v_w.v, 4) AS words FROM v_c JOIN v_w USING (metric)")
def compare_modes(spark, sf_dir):
    return rounded(r.compare_modes({s: labelled(spark, sf_dir, s) for s in ("chars", "words")}))


@query("""WITH s AS (SELECT l_suppkey % 50 AS prompt, l_partkey % 4 AS rubric, l_orderkey % 8 AS answer, avg(l_quantity) AS score, avg(l_extendedprice) AS label FROM lineitem GROUP BY ALL),
    va AS (SELECT prompt, avg(v) AS var_per_answer FROM (SELECT prompt, answer, var_pop(score) AS v FROM s GROUP BY ALL) GROUP BY prompt)
    SELECT prompt, round(var_per_answer, 4) AS var_per_answer FROM va""")
def rubric_agreement_variance(spark, sf_dir):
    return rounded(_agreement(spark, sf_dir).select("prompt", "var_per_answer"))


S_SQL = "s AS (SELECT l_suppkey % 50 AS prompt, l_partkey % 4 AS rubric, l_orderkey % 8 AS answer, avg(l_quantity) AS score, avg(l_extendedprice) AS label, avg(l_linenumber) AS length FROM lineitem GROUP BY ALL)"


def _rho_sql(source: str, by: str, a: str, b: str) -> str:
    """(by, rho) of average ranks of two columns within groups."""
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"
    return f"SELECT {by}, {RHO.format('x', 'y')} AS rho FROM (SELECT {by}, {rank(a)} AS x, {rank(b)} AS y FROM {source}) GROUP BY {by} HAVING count(*) >= 2"


@query(f"""WITH {S_SQL}, pa AS (SELECT prompt, answer, var_pop(score) AS v, avg(score) AS score, avg(label) AS label FROM s GROUP BY ALL),
    met AS (SELECT a.prompt, a.rubric AS i, b.rubric AS j, a.answer, a.score AS sx, b.score AS sy FROM s a JOIN s b ON a.prompt = b.prompt AND a.answer = b.answer AND a.rubric < b.rubric),
    e AS ({_rho_sql('pa', 'prompt', 'score', 'label')}), d AS (SELECT prompt, avg(rho) AS rho FROM ({_rho_sql('s', 'prompt, rubric', 'score', 'label')}) GROUP BY prompt),
    w AS (SELECT prompt, avg(rho) AS rho FROM ({_rho_sql('met', 'prompt, i, j', 'sx', 'sy')}) GROUP BY prompt),
    c AS (SELECT prompt, avg((n <= 1)::int) AS collapsed, avg(length) AS length FROM (SELECT prompt, rubric, count(DISTINCT score) AS n, avg(length) AS length FROM s GROUP BY ALL) GROUP BY prompt)
    SELECT v.prompt, round(v.v, 4) AS var_per_answer, round(w.rho, 4) AS mean_pair_rho, round(e.rho, 4) AS ensemble_rho, round(d.rho, 4) AS individual_rho, round(c.collapsed, 4) AS collapsed_rate, round(c.length, 4) AS mean_length
    FROM (SELECT prompt, avg(v) AS v FROM pa GROUP BY prompt) v LEFT JOIN w USING (prompt) LEFT JOIN e USING (prompt) LEFT JOIN d USING (prompt) LEFT JOIN c USING (prompt)""")
def rubric_agreement(spark, sf_dir):
    return rounded(_agreement(spark, sf_dir))


def _agreement(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_suppkey") % 50).alias("prompt"), (F.col("l_partkey") % 4).alias("rubric"), (F.col("l_orderkey") % 8).alias("answer")]
    s = li.groupBy(*keys).agg(F.avg("l_quantity").alias("score"), F.avg("l_extendedprice").alias("label"), F.avg("l_linenumber").alias("length"))
    return r.agreement(s)
