"""Sharding through fixed virtual slots.

A record's hash picks one of thousands of virtual slots for good. A small versioned table maps slots to shards;
rebalancing or growing edits that table and never rehashes a record. All of it is DataFrame operations. The tables
with a row a slot have ``n_slots`` rows, whatever the input, which is why they may be broadcast and folded in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import materialize, unused_name

N_SLOTS = 4096


def slot_of(key_cols: Sequence[str], n_slots: int = N_SLOTS) -> Column:
    """Virtual slot of a record: its hash modulo the fixed number of slots. Nulls hash like any value."""
    return F.pmod(F.xxhash64(*key_cols), F.lit(n_slots)).cast("int")


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of a map (version, slot, shard): equal runs of slots."""
    slot = F.col("id").cast("int")
    return spark.range(0, n_slots, 1, 1).select(F.lit(1).alias("version"), slot.alias("slot"), F.expr(f"int(id * {n_shards} div {n_slots})").alias("shard"))


def slot_loads(records: DataFrame, size: Column) -> DataFrame:
    """(slot, bytes, n) for records that have a column ``virtual_slot``; a null size counts as 0."""
    return records.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _evict(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The map with bytes and ``stays``: each shard keeps its largest slots up to an equal share of all bytes."""
    with_bytes = slot_map.join(F.broadcast(loads), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / F.lit(n_shards))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot"))
    return with_bytes.withColumn("stays", (upto <= share) | (F.col("bytes") == 0))


def _edited(slot_map: DataFrame, edits: DataFrame) -> DataFrame:
    edits = edits.select("slot", F.col("shard").alias("to"))
    return slot_map.join(F.broadcast(edits), "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard"))


def rebalance(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version: slots above a shard's equal share of bytes move, largest first, to the emptiest shard."""
    state = _evict(slot_map, loads, n_shards)
    kept = [F.coalesce(F.sum(F.when((F.col("shard") == k) & F.col("stays"), F.col("bytes"))), F.lit(0)).cast("long") for k in range(n_shards)]
    moved = F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "slot"))))
    one = state.agg(F.array(*kept).alias("filled"), moved.alias("moved"))

    def put(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["filled"], F.array_min(acc["filled"])).cast("int") - 1
        return F.struct(F.transform(acc["filled"], lambda v, i: v - F.when(i == to, x["minus"]).otherwise(F.lit(0))).alias("filled"), F.array_append(acc["to"], to).alias("to"))

    start = F.struct(F.col("filled"), F.expr("cast(array() as array<int>)").alias("to"))
    dealt = one.select("moved", F.aggregate("moved", start, put)["to"].alias("to"))
    edits = dealt.select(F.explode(F.arrays_zip(F.col("moved"), F.col("to"))).alias("e")).select(F.col("e.moved.slot").alias("slot"), F.col("e.to").alias("shard"))
    return _edited(slot_map, edits)


def grow(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard number ``n_shards`` added: it takes slots from the others, which exchange none."""
    state = _evict(slot_map, loads, n_shards + 1)
    return _edited(slot_map, state.filter(~F.col("stays")).select("slot", F.lit(n_shards).alias("shard")))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    all_versions = spark.read.schema("slot int, shard int, version int").parquet(path)
    wanted = F.lit(version) if version is not None else F.max("version").over(Window.partitionBy())
    return all_versions.withColumn("_wanted", wanted).filter("version = _wanted").select("version", "slot", "shard")


def shard_records(records: DataFrame, map_path: str, n_shards: int = 8, n_slots: int = N_SLOTS, *, key_cols: Sequence[str] = ("doc_id",), size: Column) -> DataFrame:
    """``records`` with ``virtual_slot``, ``shard`` and ``slot`` (place in the shard, from 0 without gaps).

    Stores versions 1 (equal runs of slots) and 2 (rebalanced by the bytes in each slot) under ``map_path`` and
    deals by version 2. Null keys hash like other values; rows that agree in all key columns share a slot. Columns of
    ``records`` with one of the three names are replaced; others may have any name. An empty table gives an empty result and a
    map of equal runs.
    """
    spark = records.sparkSession
    records = records.drop("virtual_slot", "shard", "slot").withColumn("virtual_slot", slot_of(key_cols, n_slots))
    loads = materialize(slot_loads(records, size), "slot-loads")  # n_slots rows at most
    save_map(first_map(spark, n_shards, n_slots), map_path)
    save_map(rebalance(load_map(spark, map_path), loads, n_shards), map_path)
    counted = load_map(spark, map_path).join(F.broadcast(loads), "slot", "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    own_slot, before_, inside_ = (unused_name(records, c) for c in ("own_slot", "before", "inside"))
    places = counted.select(F.col("slot").alias(own_slot), "shard", F.coalesce(before, F.lit(0)).alias(before_))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*key_cols)) - 1
    placed = records.withColumn(inside_, inside).join(F.broadcast(places), F.col("virtual_slot") == F.col(own_slot))
    return placed.withColumn("slot", (F.col(before_) + F.col(inside_)).cast("long")).drop(own_slot, before_, inside_)
