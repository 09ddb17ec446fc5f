"""Helpers that the training-data operators share: words, scratch tables and checked broadcasts."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as text and as a class for regular expressions.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_numbers = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder and a cluster gets an error,
    because a machine-local folder there would lose files.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext
    if not app.master.startswith("local") or app.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app.applicationId not in _own_dirs:
        _own_dirs[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, one for each call."""
    return f"{shared_dir(spark)}/gradeloom/{spark.sparkContext.applicationId}/{next(_numbers):05d}-{label}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_FIXED = {"bigint": 8, "int": 8, "smallint": 8, "tinyint": 8, "double": 8, "float": 8, "boolean": 8, "timestamp": 8, "date": 8}


def fits_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> bool:
    """Whether a materialized table has at most ``max_rows`` rows and ``max_bytes``.

    Numbers count 8 bytes each; columns of other types are measured by their JSON text.
    """
    loose = [c for c, t in df.dtypes if t not in _FIXED]
    size = F.sum(F.octet_length(F.to_json(F.struct(*loose)))) if loose else F.lit(0)
    rows, loose_bytes = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and 8 * rows * (len(df.columns) - len(loose)) + (loose_bytes or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast of a materialized table that ``fits_broadcast``; a larger one is joined by shuffle."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def n_words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, WS_RE))).cast("long")


def makedirs(path: str):
    """pyarrow file system and path for a folder in the shared store, which is created if it is missing.

    Used inside tasks for file formats that Spark has no writer for.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    system.create_dir(at, recursive=True)
    return system, at
