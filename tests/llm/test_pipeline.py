"""The pipeline on a small corpus: every stage against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_operators import components


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(12)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    item = prose(30)
    rows = []
    for i in range(400):
        text = prose(60)
        if i % 10 == 0:
            text = " ".join(f"{w}### $$$" for w in text.split())
        elif i % 10 == 1:
            text = rows[-2][1] if len(rows) > 2 else text
        elif i % 10 == 2:
            text = f"{text} {item}"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(400, None, "en", None, 0), (401, "", None, "src0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages_take_effect(spark, corpus, tmp_path):
    path, rows, item = corpus
    texts = {r[0]: r[1] for r in rows}
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "shards":
            assert docs.columns == columns
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert not [i for i in ids["quality"] if i < 400 and i % 10 == 0] and len([i for i in ids["quality"] if i < 400]) > 350
    kept = components([(i, texts[i]) for i in ids["quality"]], 5, 80)
    assert sorted(ids["near_duplicates"]) == sorted(i for i, (_, c) in kept.items() if c == i)
    assert sorted(ids["decontamination"]) == sorted(i for i in ids["near_duplicates"] if item not in (texts[i] or ""))
    assert set(ids["mix"]) <= set(ids["decontamination"]) and max(map(ids["mix"].count, set(ids["mix"]))) <= 2
    assert len(ids["shards"]) == len(ids["mix"])
    sizes = [r["sum(size)"] for r in seen["shards"].groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_run_agrees_with_itself(spark, corpus):
    path = corpus[0]
    a, b = (corpus_pipeline.run(spark, path).select("doc_id", "shard", "slot", F.col("size")) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stages_take_nulls_repeats_extra_columns_and_nothing(spark, corpus):
    """Rows with null texts and ids, rows that are there twice, and columns named as the stages' own; and no rows at all."""
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "src0", 1), (500, None, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(odd)
    clash = docs.selectExpr("*", "1 AS score", "2 AS gone", "3 AS leaked", "4 AS mix", "5 AS mix_size", "6 AS slot")
    for given in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, path)
            n = out.count()
            assert (n == 0) == (given is not clash), name
            if name not in ("mix", "shards"):
                assert out.columns == given.columns and n <= given.count(), name
