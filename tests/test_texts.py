import pytest
from pyspark.sql import functions as F

from gradeloom.functions import answers as a
from gradeloom.functions import text as x

RUBRIC = "Title\n- [+] names the topic\nmore on it\n\n* [–2] is rude | tags: tone\n[1+] short\n- [7] no sign\n- [+] [-] twice"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} string" for k in values) if values else "id int")
    return row.select(column.alias("v")).first()["v"]


def test_parse_rubric(spark):
    got = [(c["sign"], c["text"]) for c in one(spark, x.parse_rubric("t"), t=RUBRIC)]
    assert got == [("+", "names the topic\nmore on it"), ("-", "is rude"), ("+", "short\n- [7] no sign"), ("+", "[-] twice")]
    assert one(spark, x.parse_rubric("t"), t="plain sentence") == [] and one(spark, x.malformed_count("t"), t=RUBRIC) == 1 and one(spark, x.double_tag_count("t"), t=RUBRIC) == 1


def test_lines_split_like_python(spark):
    for t in ("a\nb", "a\r\nb\n", "", "a\x0bb c", "a\n\n"):
        assert one(spark, x.lines("t"), t=t) == t.splitlines()


@pytest.mark.parametrize(("n", "tokens", "sign"), [(6, 100, 0), (20, 100, -1), (1, 100, -1), (0, 100, -1), (6, 950, -1)])
def test_quality_penalties(spark, n, tokens, sign):
    q = one(spark, x.quality_adjustment(F.col("t"), F.lit(tokens)), t="\n".join(f"- [+] criterion {i}" for i in range(n)))
    assert (q["total"] < 0) == (sign < 0) and q["n_criteria"] == n
    if n == 0:
        assert q["total"] == -10


def test_gram_jaccard_counts_repeats(spark):
    j = lambda s, t: one(spark, x.gram_jaccard(x.char_grams("a"), x.char_grams("b")), a=s, b=t)
    assert j("hello world", " Hello World ") == 1.0 and j("abc", "xyz") == 0.0 and j("", "") == 0.0 and j("ab", "ab") == 0.0
    assert j("aaaa", "aaa") == 0.5


def test_dedup_keeps_the_first_and_other_lines(spark):
    t = "Header\n- [+3] The answer names the cause\n- [+2] The answer names the causes\n- [-1] Rude\n\n- [+1] Cites two sources"
    assert one(spark, x.dedup_criteria("t"), t=t).split("\n") == ["Header", "- [+3] The answer names the cause", "- [-1] Rude", "", "- [+1] Cites two sources"]
    assert one(spark, x.dedup_criteria("t"), t="") == ""


@pytest.mark.parametrize(("t", "want"), [("7", 7.0), ("Score: 4 then Score: 12", 10.0), ('{"score": 3.5}', 3.5), ("about 6/10", 6.0), ("of 2024 I say 9", 9.0), ("<think>Score: 1</think> 8", 8.0), ("none", None), ("", None)])
def test_score_from_text(spark, t, want):
    assert one(spark, a.score_from_text("t"), t=t) == want


def test_score_arrays(spark):
    s = lambda t, n, **k: one(spark, a.scores_from_text("t", F.lit(n), **k), t=t)
    assert s("x [1, 11, -2] y", 3) == [1.0, 10.0, 0.0] and s("[1, 2]", 3) is None and s("1 and 2", 2) is None and s("1 and 2", 2, fallback=True) == [1.0, 2.0]


def test_rubric_from_text(spark):
    got = lambda t: [(r["criterion"], r["points"]) for r in one(spark, a.rubric_from_text("t"), t=t)]
    assert got('```json\n[{"criterion": "a", "points": 99}, {"criterion": "b", "points": 0}]\n```') == [("a", 10)]
    assert got("- [+3] first\n2. [-4] second\nnothing") == [("first", 3), ("second", -4)]


def test_rule_scorers(spark):
    assert one(spark, a.final_number("t"), t="#### 1 so #### 1,234") == "1234" and one(spark, a.final_number("t"), t="12") is None
    assert one(spark, a.final_number("t", strict=False), t="it is 12 .") == "12"
    assert one(spark, a.last_boxed("t"), t=r"\boxed{1} \boxed{\frac{1}{2}} x") == r"\frac{1}{2}" and one(spark, a.last_boxed("t"), t=r"\boxed{1") is None
    assert one(spark, a.score_exact_match("t", F.array(F.lit("Paris"))), t="<answer>the  paris!</answer>") == 1.0
    assert one(spark, a.normalise_final_answer("t"), t="x = 1,234 dollars") == "1234"
    with pytest.raises(Exception, match="no scoring rule"):
        one(spark, a.score_by_source(F.col("t"), {("a",): F.lit(1.0)}), t="b")


def test_templates_are_filled_once(spark):
    assert one(spark, x.fill_template("{q}-{r}", q=F.col("t"), r=F.lit("z")), t="{r}") == "{r}-z"


def test_template_values_are_not_looked_at(spark):
    df = spark.createDataFrame([("{b}\u00010\u0001", None), ("x", "{a}")], "a string, b string")
    out = [r[0] for r in df.select(x.fill_template("{a}-{b}-{a}-{c}\u00011\u0001", a=F.col("a"), b=F.col("b"))).collect()]
    assert out == ["{b}\u00010\u0001--{b}\u00010\u0001-{c}\u00011\u0001", "x-{a}-x-{c}\u00011\u0001"]
    assert df.select(x.fill_template("{a}")).first()[0] == "{a}"
