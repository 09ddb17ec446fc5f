"""Queries that must look at all of their input, on small tables of their own."""

import __spark_entry__ as entry

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_monitors_read_whole_texts_and_lines(spark, tmp_path):
    common = " ".join(f"c{i}" for i in range(40))
    texts = [f"{common} " + " ".join(f"{k}{i}" for i in range(200)) for k in "ab"]
    d = put(spark, tmp_path / "a", "documents", [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    assert [r["collapse"] for r in entry.queries()["monitor_collapse_rate"](spark, d).collect()] == [0.5]
    text = f"{'x ' * 45} zebra\na zebra ran off."  # lines of 95 and 16 letters: only the second is a criterion
    d = put(spark, tmp_path / "b", "documents", [(0, text, "en", "s", len(text))], DOC)
    assert entry.queries()["monitor_topic_specificity"](spark, d).first()["criteria"] == 1.0


def test_every_benchmark_item_is_a_gold_side(spark, tmp_path):
    put(spark, tmp_path, "documents", [(i, f"apple pear{i}", "en", "s", 9) for i in range(120)], DOC)
    d = put(spark, tmp_path, "benchmark", [(3 * i, f"apple pear{i} item{i}") for i in range(60)], "item_id long, text string")
    for name in ("rubric_keyword_scores", "rubric_composite"):
        assert sorted(r["doc_id"] for r in entry.queries()[name](spark, d).collect()) == list(range(120))


def test_reorder_of_a_multiple_of_seven(spark, tmp_path):
    d = put(spark, tmp_path, "benchmark", [(i, "x") for i in range(14)], "item_id long, text string")
    got = {r["item_id"]: r["ord"] for r in entry.queries()["prep_reorder"](spark, d).collect()}
    assert got == {i: 13 - i for i in range(14)}
