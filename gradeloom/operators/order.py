"""Global numbering without a global sort in one task.

A bucket is any column that rises with the wanted order. Rows are numbered inside their bucket, and a table with a row a bucket gives what
stands before it. Where no column of the table is such a bucket, ``range_bucket`` makes one from splitters that a bounded sample gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType


#: Buckets that ``range_bucket`` makes, at least and for each shuffle partition, and rows that are sampled for each.
LEAST_BUCKETS, BUCKETS_PER_PARTITION, SAMPLED_PER_BUCKET = 64, 4, 16


def range_bucket(df: DataFrame, order: Sequence[Column]) -> Column:
    """A number that rises with ``order`` (ascending, nulls first) and has about as many rows for each value.

    The splitters come from a sample of bounded size, chosen by hash and fetched once, so every use of the column deals the rows in the same way.
    Rows that are equal in all columns of ``order`` share a bucket. A row finds its bucket by binary search.
    """
    n = max(LEAST_BUCKETS, BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*[c.alias(f"c{k}") for k, c in enumerate(order)])
    sample = keys.orderBy(F.xxhash64(*keys.columns)).limit(n * SAMPLED_PER_BUCKET)
    placed = sample.agg(F.sort_array(F.collect_list(F.struct(*keys.columns))).alias("s"))
    chosen = placed.select(F.filter("s", lambda _, i: (i + 1) % SAMPLED_PER_BUCKET == 0).alias("s"))
    found, text = chosen.select(F.size("s"), F.to_json("s")).first()
    if not found:
        return F.lit(0)
    splitters = F.from_json(F.lit(text), chosen.schema["s"].dataType)
    own = F.struct(*[c.alias(name) for c, name in zip(order, keys.columns, strict=True)])
    # how many splitters are at or before the row: the answer grows by the largest powers of two that still fit
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(found.bit_length()))])
    return F.aggregate(jumps, F.lit(0), lambda upto, jump: F.when(F.get(splitters, upto + jump - 1) <= own, upto + jump).otherwise(upto))


def _before(df: DataFrame, bucket: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_bucket", bucket)
    sums = marked.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_sum").over(Window.partitionBy())
    return marked, sums.select(F.col("_bucket").alias("_b"), F.coalesce(upto, F.lit(0)).alias("_before"), total.alias("_total"))


def number_rows(df: DataFrame, order: Sequence[Column | str], bucket: Column, out: str, total: str | None = None) -> DataFrame:
    """``out``: place from 0 in the order, and the number of rows in ``total`` where it is named."""
    marked, before = _before(df, bucket, F.lit(1))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    placed = marked.withColumn("_inside", inside).join(before, F.col("_bucket").eqNullSafe(F.col("_b")))
    placed = placed.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
    return (placed.withColumn(total, F.col("_total")) if total else placed).drop("_bucket", "_b", "_inside", "_before", "_total")


def first_rows(df: DataFrame, order: Sequence[Column | str], bucket: Column, k: int) -> DataFrame:
    """The first ``k`` rows in the order. Only buckets that begin before place ``k`` are dealt out and sorted, each by itself."""
    marked, before = _before(df, bucket, F.lit(1))
    near = marked.join(F.broadcast(before.filter(F.col("_before") < k)), F.col("_bucket").eqNullSafe(F.col("_b")))
    placed = near.withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return placed.filter(F.col("_place") <= k).drop("_bucket", "_b", "_before", "_total", "_place")


def running_sum(df: DataFrame, value: str, order: Sequence[Column | str], bucket: Column, out: str, total: str) -> DataFrame:
    """``out``: sum of ``value`` up to and with each row, and ``total``: the sum of all."""
    marked, before = _before(df, bucket, F.col(value))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.withColumn("_inside", inside).join(before, F.col("_bucket").eqNullSafe(F.col("_b")))
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).withColumn(total, F.col("_total")).drop("_bucket", "_b", "_inside", "_before", "_total")


def _sortable(df: DataFrame, name: str) -> list[Column]:
    """A column's parts that literals can stand for in its order: fields of structs, microseconds of timestamps."""
    kind, found = df.schema[name].dataType, F.col(name)
    parts = [(f.dataType, found[f.name]) for f in kind.fields] if isinstance(kind, StructType) else [(kind, found)]
    return [F.unix_micros(c) if isinstance(t, TimestampType) else c for t, c in parts]


#: Rows of a log that may share a window. Logs of more are cut into ranges of their order; the last rows of each block are copied to the next one.
BLOCK_ROWS = 65_536


def _any_above(df: DataFrame, by: str, rows: int) -> bool:
    return df.groupBy(by).count().filter(F.col("count") > rows).limit(1).count() > 0


def _in_ranges(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    return df.withColumn("_bucket", range_bucket(df, [c for name in (by, *order) for c in _sortable(df, name)]))


def number_within(df: DataFrame, by: str, order: Sequence[str], out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``out``: place from 0 in the order inside each ``by``. Where one has more than ``rows`` rows, all are cut into ranges of the order, so that no window holds more than a range, or a row a range."""
    return _numbered(df, by, order, out, _any_above(df, by, rows))


def _numbered(df: DataFrame, by: str, order: Sequence[str], out: str, hot: bool) -> DataFrame:
    if not hot:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
    marked = _in_ranges(df, by, order)
    counts = marked.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_by", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    placed = marked.withColumn("_inside", inside).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_by", "_b", "_inside", "_before")


def framed(df: DataFrame, by: str, order: Sequence[str], before: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows numbered in ``_k`` inside each ``by`` and dealt to ``_block``s of ``rows`` rows, so that a frame of a row and ``before`` rows ahead of it ends inside its block:
    the rows ahead of a block are in it too, with ``_copy`` true. Where no ``by`` has more than ``rows`` rows, each is one block."""
    hot = _any_above(df, by, rows)
    placed = _numbered(df, by, order, "_k", hot)
    if not hot:
        return placed.withColumn("_block", F.lit(0)).withColumn("_copy", F.lit(False))
    size = max(rows, before)
    own = F.floor(F.col("_k") / size)
    again = F.col("_k") % size >= size - before
    both = placed.withColumn("_block", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    return both.withColumn("_copy", F.col("_block") != own)


def last_known(df: DataFrame, column: str, by: str, order: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``out``: the latest value of ``column`` that isn't null, up to each row in the order inside ``by``; where one has more than ``rows`` rows, a table with a row a range of the order carries it on from range to range."""
    if not _any_above(df, by, rows):
        return df.withColumn(out, F.last(column, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    marked = _in_ranges(df, by, [order])
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = marked.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_b")).agg(F.max(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))["v"].alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_by", "_b", carried.alias("_carried"))
    placed = marked.withColumn("_inside", inside).join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn(out, F.coalesce("_inside", "_carried")).drop("_bucket", "_by", "_b", "_inside", "_carried")
