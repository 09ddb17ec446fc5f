"""Rubric text queries. Documents stand in for rubrics: each line gets a bracket that depends on its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import answers as a
from gradeloom.functions import text as x
from gradeloom.operators.order import number_rows
from gradeloom.plans.ranking import rounded
from gradeloom.plans.registry import query, table

#: Brackets by the length of the line modulo 8; the last two don't make a criterion.
BRACKETS = ("- [+] ", "- [-] ", "[+3] ", "* [–2] ", "- [1+] ", "- [+] [-] ", "- [7] ", "")
B_SQL = ", ".join(f"'{b}'" for b in BRACKETS)
# RE2 has no Unicode \s; the lines of these texts hold plain spaces only.
CRIT = r"^\s*(?:[-*\x{2013}\x{2014}]\s*)?\[(\d*[+\-\x{2013}\x{2014}]+\d*)\]\s*(.+?)(?:\s*\|\s*(?i:tags?)\s*:.*)?$"
RUBRICS = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    l AS (SELECT doc_id, i, [{B_SQL}][length(line) % 8 + 1] || line AS line FROM raw WHERE trim(line) <> ''),
    c AS (SELECT *, regexp_matches(line, '{CRIT}') AS crit, trim(regexp_extract(line, '{CRIT}', 2)) AS body, translate(regexp_extract(line, '{CRIT}', 1), '–—', '--') AS br FROM l)"""


def rubrics(spark, sf_dir):
    some = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    marks = F.array(*[F.lit(b) for b in BRACKETS])
    lines = F.transform(some, lambda v: F.concat(F.get(marks, F.length(v) % 8), v))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("rubric"), "text", "lang", "n_chars")


@query(f"""WITH {RUBRICS}, g AS (SELECT *, sum(crit::int) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS crit_idx FROM c)
    SELECT doc_id, (crit_idx - 1)::bigint AS crit, max(CASE WHEN crit AND contains(br, '-') AND NOT contains(br, '+') THEN '-' WHEN crit THEN '+' END) AS sign,
        string_agg(CASE WHEN crit THEN body ELSE trim(line) END, chr(10) ORDER BY i) AS text FROM g WHERE crit_idx > 0 GROUP BY doc_id, crit_idx""")
def rubric_criteria(spark, sf_dir):
    parsed = rubrics(spark, sf_dir).select("doc_id", F.posexplode(x.parse_rubric("rubric")).alias("crit", "c"))
    return parsed.select("doc_id", F.col("crit").cast("long").alias("crit"), "c.sign", "c.text")


BAD = r"^\s*(?:[-*\x{2013}\x{2014}]\s*)?\[[^\]]*\]\s*.+$"
TWICE = r"^\s*(?:[-*\x{2013}\x{2014}]\s*)?\[[+\-\x{2013}\x{2014}\d]*\]\s*\[[+\-\x{2013}\x{2014}\d]*\]"
COUNTS = f"""{RUBRICS}, n AS (SELECT doc_id, count(*) FILTER (crit) AS n, count(*) FILTER (crit AND (contains(br, '+') OR NOT contains(br, '-'))) AS pos, count(*) AS lines,
    count(*) FILTER (regexp_matches(line, '{BAD}') AND NOT crit) AS bad, count(*) FILTER (regexp_matches(line, '{TWICE}')) AS twice FROM c GROUP BY doc_id)"""


@query(f"""WITH {COUNTS}, q AS (SELECT doc_id, n, pos, n - pos AS neg, CASE WHEN n = 0 THEN -10 WHEN n > 15 THEN -2.0 * (n - 15) / n WHEN n < 3 THEN -2.0 * (3 - n) / 3 ELSE 0 END AS len,
        CASE WHEN n_chars > 750 THEN -1.5 * least((n_chars - 750) / 274, 1) ** 2 ELSE 0 END AS tok, -2.0 * least(bad / 3, 1) AS mal, -5.0 * twice / greatest(n, 1) AS dbl FROM n JOIN documents USING (doc_id))
    SELECT doc_id, n AS n_criteria, pos AS n_positive, neg AS n_negative, round(len, 4) AS length, round(tok, 4) AS token_length, round(mal, 4) AS malformed, round(dbl, 4) AS double_tag, round(len + tok + mal + dbl, 4) AS total FROM q""")
def rubric_quality(spark, sf_dir):
    q = rubrics(spark, sf_dir).filter("rubric <> ''").select("doc_id", x.quality_adjustment(F.col("rubric"), F.col("n_chars")).alias("q")).select("doc_id", "q.*")
    return rounded(q.withColumns({c: F.col(c).cast("long") for c in ("n_criteria", "n_positive", "n_negative")}))


def with_gold(spark, sf_dir):
    """Rubrics with the benchmark text ``gold``, dealt in turn: item number doc_id modulo the number of items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    gold = number_rows(items, ["item_id"], F.floor(F.col("item_id") / 10_000), "g").select("g", "gold")
    return rubrics(spark, sf_dir).join(gold, F.pmod(F.col("doc_id"), F.lit(max(items.count(), 1))) == F.col("g"))


WORDS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}')), lambda w: NOT list_contains([{}], w))"
STOP = ", ".join(f"'{w}'" for w in x.STOP_WORDS)
A, G = WORDS.format("d.text", STOP), WORDS.format("b.text", STOP)


@query(f"""WITH k AS (SELECT doc_id, {A} AS a, {G} AS g FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS g FROM benchmark) b ON b.g = d.doc_id % (SELECT count(*) FROM benchmark)), n AS (SELECT doc_id, len(a) AS na, len(g) AS ng, len(list_intersect(a, g)) AS o FROM k)
    SELECT doc_id, round(CASE WHEN na > 0 AND ng > 0 THEN o / ng ELSE 0 END, 4) AS recall, round(CASE WHEN na > 0 AND ng > 0 THEN o / na ELSE 0 END, 4) AS precision, round(CASE WHEN o > 0 THEN 2.0 * o / (na + ng) ELSE 0 END, 4) AS f1 FROM n""")
def rubric_keyword_scores(spark, sf_dir):
    both = with_gold(spark, sf_dir)
    return rounded(both.select("doc_id", x.keyword_scores("text", "gold").alias("k")).select("doc_id", "k.*"))


@query(f"WITH {COUNTS} SELECT doc_id, round(n / greatest(lines, 1), 4) AS compliance FROM n")
def rubric_compliance(spark, sf_dir):
    return rounded(rubrics(spark, sf_dir).filter("rubric <> ''").select("doc_id", x.format_compliance("rubric").alias("compliance")))


@query(f"""WITH {COUNTS}, k AS (SELECT doc_id, {A} AS a, {G} AS g FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS g FROM benchmark) b ON b.g = d.doc_id % (SELECT count(*) FROM benchmark)),
    f AS (SELECT doc_id, CASE WHEN len(list_intersect(a, g)) > 0 THEN 2.0 * len(list_intersect(a, g)) / (len(a) + len(g)) ELSE 0 END AS f1 FROM k)
    SELECT doc_id, round(5 * f1 + coalesce(n / greatest(lines, 1), 0) + (coalesce(n, 0) BETWEEN 3 AND 15)::int + coalesce((pos > 0 AND n > pos)::int, 0), 4)::double AS score FROM f LEFT JOIN n USING (doc_id)""")
def rubric_composite(spark, sf_dir):
    both = with_gold(spark, sf_dir)
    return rounded(both.select("doc_id", x.composite_score(F.col("rubric"), F.col("gold")).alias("score")))


@query("""WITH g AS (SELECT item_id, lower(trim(text)) AS t FROM benchmark), a AS (SELECT item_id, substr(t, i, 3) AS gram, count(*) AS n FROM (SELECT item_id, t, unnest(range(1, length(t) - 1)) AS i FROM g) GROUP BY ALL),
    p AS (SELECT a.item_id AS a, coalesce(b.item_id, a.item_id + 1) AS b, sum(least(a.n, coalesce(b.n, 0))) AS i FROM a LEFT JOIN a AS b ON b.gram = a.gram AND b.item_id = a.item_id + 1 GROUP BY ALL),
    s AS (SELECT item_id, sum(n) AS n FROM a GROUP BY 1)
    SELECT p.a, p.b, round(i / (x.n + y.n - i), 4) AS jaccard FROM p JOIN s x ON x.item_id = p.a JOIN s y ON y.item_id = p.b""")
def rubric_gram_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("tb")), F.col("b") == F.col("a") + 1)
    return rounded(pairs.select("a", "b", x.gram_jaccard(x.char_grams("ta"), x.char_grams("tb")).alias("jaccard")))


@query()
def rubric_dedup(spark, sf_dir):
    short = F.array_join(F.transform(F.split("text", r"\. "), lambda v: F.concat(F.lit("- [+2] "), v)), "\n")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws("\n", short, short).alias("rubric"))
    return b.select("item_id", x.dedup_criteria("rubric").alias("kept"))


@query("SELECT doc_id, regexp_replace(text, '\\s*\\|\\s*tags?\\s*:.*$', '', 'gim') AS clean FROM documents")
def rubric_strip_tags(spark, sf_dir):
    return rubrics(spark, sf_dir).select("doc_id", x.strip_tags_suffix("text").alias("clean"))


@query("SELECT doc_id, regexp_replace('<think>' || left(text, 40) || '</think> ' || text, '(?s)<think>.*?</think>\\s*', '', 'g') AS clean FROM documents")
def rubric_strip_think(spark, sf_dir):
    return rubrics(spark, sf_dir).select("doc_id", x.strip_think(F.concat(F.lit("<think>"), F.substring("text", 1, 40), F.lit("</think> "), F.col("text"))).alias("clean"))


@query("SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(replace(text, '|', '**'), '\\*\\*([^*]+)\\*\\*', 1), lambda c: trim(lower(c)))))::int AS n FROM documents")
def rubric_bold_concepts(spark, sf_dir):
    return rubrics(spark, sf_dir).select("doc_id", F.size(x.bold_concepts(F.replace("text", F.lit("|"), F.lit("**")))).alias("n"))


@query("SELECT p_partkey, greatest(1, least(10, CASE WHEN w > 0 AND w <= 1 THEN round_even(w * 10, 0) ELSE trunc(w) END))::int AS points, '- [+' || greatest(1, least(10, CASE WHEN w > 0 AND w <= 1 THEN round_even(w * 10, 0) ELSE trunc(w) END))::int || '] ' || p_name AS line FROM (SELECT *, p_size / 20.0::double AS w FROM part)")
def rubric_points(spark, sf_dir):
    points = x.weight_to_points(F.col("p_size") / 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", points.alias("points"), x.rubric_line(F.col("p_name"), points).alias("line"))


@query("SELECT p_partkey, round(greatest(least((1 + 0.1::double * abs(p_size - 25)) * CASE WHEN p_size < 25 THEN 1.5 ELSE 1.0 END, 3.0), 0.5)::double, 4) AS weight FROM part")
def rubric_criterion_weights(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", x.criterion_weight(F.col("p_size") - 25).alias("weight")))


@query("SELECT item_id, 'Q: ' || text || ' / ' || item_id AS prompt FROM benchmark")
def rubric_template(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", x.fill_template("Q: {question} / {id}", question=F.col("text"), id=F.col("item_id").cast("string")).alias("prompt"))


@query("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7f]') AS non_ascii, array_to_string(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')[1:8], ' ') AS opener FROM documents")
def rubric_openers(spark, sf_dir):
    return rubrics(spark, sf_dir).select("doc_id", x.non_ascii(F.col("text")).alias("non_ascii"), x.opener("text").alias("opener"))


# ---- answers: orders stand in for completions

REPLY = """concat(element_at(array('Score: ', '', 'I give ', '{"score": ', '<think>4</think>score = '), int(o_orderkey % 5) + 1), string(o_orderkey % 11),
    element_at(array(' but then Score: 3', '', '/10 overall', '}', '.5'), int(o_orderkey % 5) + 1))"""


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3.0 WHEN 4 THEN least(o_orderkey % 11 + 0.5, 10) ELSE o_orderkey % 11 END::double AS score FROM orders")
def answer_scores(spark, sf_dir):
    replies = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(REPLY).alias("reply"))
    return replies.select("o_orderkey", a.score_from_text("reply").alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE least(o_orderkey % 13, 10) + 7.0 END::double AS total FROM orders")
def answer_score_arrays(spark, sf_dir):
    reply = F.concat(F.lit("Here: ["), F.col("o_orderkey") % 13, F.when(F.col("o_orderkey") % 3 == 0, ", 1, 2").otherwise(", 7.0"), F.lit("] done"))
    scores = a.scores_from_text(reply, F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.aggregate(scores, F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("SELECT o_orderkey, round((o_orderkey % 11 + o_orderkey % 7 - o_orderkey % 5 + 10) / 30 * 10, 4) AS score FROM orders")
def answer_signed_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    scores, signs = F.array(*[(k % n).cast("double") for n in (11, 7, 5)]), F.array(F.lit("+"), F.lit("+"), F.lit("-"))
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", a.signed_to_ten(scores, signs).alias("score")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.1 END::double AS score FROM orders")
def answer_number_score(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reply = F.concat(F.lit("steps\n"), F.when(k % 4 == 0, "no answer ").otherwise("#### 9 then #### "), c + F.when(c % 3 == 0, 0).otherwise(1))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.score_number(reply, c.cast("string"), format_score=0.1).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 1.0 END::double AS exact, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 1.0 END::double AS inside FROM part")
def answer_exact_match(spark, sf_dir):
    reply = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("I say <answer> The "), F.upper("p_name"), F.lit("! </answer>")))
    golds = F.array(F.lit("nothing"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", a.score_exact_match(reply, golds).alias("exact"), a.score_exact_match(reply, golds, substring=True).alias("inside"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN -1.0 ELSE 1.0 END::double AS boxed, CASE WHEN p_size % 3 = 0 THEN -1.0 ELSE 1.0 END::double AS answer FROM part")
def answer_math_scores(spark, sf_dir):
    size = F.col("p_size")
    box = F.concat(F.lit(r"so \boxed{1} no, \boxed{\frac{"), size, F.lit("}{3}"), F.when(size % 4 == 0, "").otherwise("}"))
    said = F.concat(F.lit("Answer: 1\nAnswer: x = $"), size + F.when(size % 3 == 0, 1).otherwise(0), F.lit("$ units"))
    truth = F.concat(F.lit(r"\frac{"), size, F.lit("}{3}"))
    return table(spark, sf_dir, "part").select("p_partkey", a.score_math(box, truth, boxed=True).alias("boxed"), a.score_math(said, size.cast("string")).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::double AS score FROM part")
def answer_score_by_source(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("source", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"))
    return parts.select("p_partkey", a.score_by_source(F.col("source"), {("a", "c"): F.lit(1.0), ("b",): F.lit(0.0)}).alias("score"))


@query("SELECT p_partkey, 'find' AS name, p_size::varchar AS size FROM part")
def answer_tool_calls(spark, sf_dir):
    reply = F.concat(F.lit('x <tool_call>{"name": "find", "arguments": {"size": '), F.col("p_size"), F.lit("}}</tool_call> <tool_call>oops</tool_call>"))
    calls = table(spark, sf_dir, "part").select("p_partkey", F.explode(a.tool_calls(reply)).alias("c"))
    return calls.select("p_partkey", "c.name", F.get_json_object("c.arguments", "$.size").alias("size"))


@query("SELECT p_partkey, p_size % 2 = 0 AS yes FROM part")
def answer_yes_verdict(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", a.yes_verdict(F.when(F.col("p_size") % 2 == 0, " yes. ").otherwise("no")).alias("yes"))


@query("SELECT p_partkey, 'fits ' || p_name AS criterion, greatest(-10, least(10, p_size - 12))::int AS points FROM part WHERE p_size <> 12")
def answer_rubrics(spark, sf_dir):
    n = F.col("p_size") - 12
    as_json = F.concat(F.lit('```json [{"criterion": "fits '), F.col("p_name"), F.lit('", "points": '), n, F.lit("}] ```"))
    as_line = F.concat(F.lit("1. [" ), n, F.lit("] fits "), F.col("p_name"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(a.rubric_from_text(F.when(F.col("p_size") % 2 == 0, as_json).otherwise(as_line))).alias("r"))
    return found.select("p_partkey", "r.criterion", "r.points")
