"""The corpus pipeline: from raw documents to sharded training data, each stage one operator of gradeloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return the columns that they get, further ones
and ones whose names clash with an operator's own included. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, mixing, near_dedup, quality_fm, sharding
from gradeloom.llm.common import materialize, scratch_path, table

MIN_SCORE = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
WEIGHTS, BUDGET_RATIO, MAX_EPOCHS = (3, 1, 2), 1.5, 2.0
N_SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more.

    Null and empty texts have a score as others have, from the machine's bias and text statistics; repeated rows score alike and stay together; without labels every score is 0.5 and all go.
    """
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, machine).filter(F.col("score") >= MIN_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more, whole texts.

    Null and empty texts are like nothing and stay, shorter texts are one shingle, and of rows that repeat an id one stays.
    """
    return near_dedup.keep_one(docs, near_dedup.near_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing; a benchmark without items keeps all; very long texts are searched to their end; repeated rows go or stay together.
    """
    return decontaminate.drop_leaks(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), cut=True))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's target wants it.

    A null source is one of its own, last in the order of weights; texts without words have size 0; repeated rows are mixed each, in an order that their texts break.
    """
    return mixing.expand(mixing.mix_sources(docs, WEIGHTS, BUDGET_RATIO, MAX_EPOCHS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each record of the mix goes: (doc_id, lang, source, size, text_crc32, virtual_slot, shard, slot).

    Null texts have size 1 and the checksum of an empty one; copies of a record have places of their own; null ids go to a slot as others do.
    """
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_records(records, scratch_path(spark, "slot-map"), N_SHARDS, key_cols=("doc_id", "text_crc32"), size=F.col("size"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: SQL has neither the trained classifier nor the seeded hashes; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
