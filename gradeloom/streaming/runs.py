"""Incremental runs with Structured Streaming: files that arrive step by step, scored or folded as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradeloom.sources.io import step_of

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def stream_files(spark: SparkSession, path: str, schema: str, kind: str = "json", files_at_once: int = 100) -> DataFrame:
    """New files of a folder as a stream, each row with its file's step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(kind).load(path).withColumn("step", step_of(F.col("_metadata.file_name")))


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``each(batch, number)`` for what has arrived, then stop. The checkpoint makes a restart go on behind the last whole batch."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor_steps(stream: DataFrame, per_step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A per-step table for each batch, in ``out/batch=n``; a batch that is run again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        per_step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run_batches(stream, each, checkpoint)


def with_state_on_disk(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state is kept in RocksDB; the session's own setting is as it was afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_to_files(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files, each once, until nothing more is there. The checkpoint makes a restart go on with the state."""
    sink = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return with_state_on_disk(rows.sparkSession, sink.start)


def score_as_it_comes(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> StreamingQuery:
    """Score the first row of each key and add it to ``out/batch=n``.

    The keys seen are state of the run, dealt by key, so earlier results are never read again. A batch that is run again meets the state that it met before, and replaces its own folder.
    """
    return with_state_on_disk(stream.sparkSession, lambda: monitor_steps(stream.dropDuplicates([key]), scorer, out, checkpoint))


def grow_dataset(stream: DataFrame, keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's rows that ``keep`` lets through to a dataset."""
    return monitor_steps(stream, keep, out, checkpoint)


class _HeldSteps(StatefulProcessor):
    """Of each run: sums of the steps that may still grow, how far it was seen, what was folded last, and what the fold carries on."""

    def __init__(self, delay: int, start: Sequence[float], fold: Callable[[list[float], float, int], list[float]], columns: list[str]):
        self.delay, self.start, self.fold, self.columns = delay, list(start), fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "step long", "total double, n long")
        self.run = handle.getValueState("run", "low long, seen long, done long, carry array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        low, seen, done, carry = self.run.get() if self.run.exists() else (LAST, FIRST, FIRST, self.start)
        new, ended = {}, False
        for pdf in rows:
            for step, total, n, end in zip(pdf["step"], pdf["total"], pdf["n"], pdf["ended"], strict=True):
                ended |= bool(end)
                if not end:
                    at = new.setdefault(int(step), [0.0, 0])
                    at[0] += float(total) if n else 0.0
                    at[1] += int(n)
        out = [(key[0], step, *self._sums(*new.pop(step)), *[None] * len(carry), True) for step in sorted(new) if step <= done]
        for step, (total, n) in new.items():
            if self.held.containsKey((step,)):
                was = self.held.getValue((step,))
                total, n = was[0] + total, was[1] + n
            self.held.updateValue((step,), (total, n))
            low, seen = min(low, step), max(seen, step)
        upto = LAST - 1 if ended else max(seen - self.delay, FIRST)
        if low <= upto:
            held = sorted((k[0], v[0], v[1]) for k, v in self.held.iterator())
            for step, total, n in held:
                if step > upto:
                    break
                carry = self.fold(list(carry), total, n)
                out.append((key[0], step, *self._sums(total, n), *carry, False))
                self.held.removeKey((step,))
                done = step
            low = min((step for step, _, _ in held if step > upto), default=LAST)
        self.run.update((low, seen, done, list(carry)))
        yield pd.DataFrame(out, columns=self.columns).astype({"step": "int64", "n": "int64", "total": "float64", "late": "bool"})

    @staticmethod
    def _sums(total: float, n: int) -> tuple[float | None, int]:
        return (total if n else None), n

    def close(self) -> None:
        pass


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["run", "step", "ended"]).aggregate([("value", "sum"), ("value", "count")])
        yield from sums.rename_columns({"value_sum": "total", "value_count": "n"}).select(["run", "step", "ended", "total", "n"]).to_batches()


def fold_steps(stream: DataFrame, run: str, step: str, value: str, delay: int, carry: Mapping[str, float], fold: Callable[[list[float], float, int], list[float]]) -> DataFrame:
    """(run, step, total, n, *carry, late): one row for each step of each run, however many batches bring its rows and in whatever order.

    A step is held until its run was seen ``delay`` steps further on, or ended: a row whose step is null ends its run for now (what is held is folded; later steps may follow). Steps are
    then folded in order, ``fold(carried, total, n)`` giving what is carried on. Each run keeps its own time, so a slow run loses nothing to a fast one. A step
    that comes when one not below it was folded isn't lost either: it gives a row of its own with ``late`` true and nothing carried. Null values count neither in ``total`` nor in ``n``;
    ``total`` is null where all are. Rows are summed up in their own task before they meet by run, and a run's state is the steps that are held.
    """
    kind = stream.schema[run].dataType.simpleString()
    at = F.col(step).cast("long")
    rows = stream.select(F.col(run).alias("run"), F.coalesce(at, F.lit(0)).alias("step"), at.isNull().alias("ended"), F.col(value).cast("double").alias("value"))
    sums = rows.mapInArrow(_partial_sums, f"run {kind}, step long, ended boolean, total double, n long")
    columns = ["run", "step", "total", "n", *carry, "late"]
    schema = f"run {kind}, step long, total double, n long, {''.join(f'{c} double, ' for c in carry)}late boolean"
    return sums.groupBy("run").transformWithStateInPandas(_HeldSteps(delay, list(carry.values()), fold, columns), schema, "append", "none")


def step_totals(stream: DataFrame, run: str = "run", step: str = "step", value: str = "value", delay: int = 0) -> DataFrame:
    """(run, step, total, n, late), as ``fold_steps`` says."""
    return fold_steps(stream, run, step, value, delay, {}, lambda carried, total, n: carried)


def smooth_stream(stream: DataFrame, run: str = "run", step: str = "step", value: str = "value", keep: float = 0.9, low: float = 0.1, delay: int = 0) -> DataFrame:
    """(run, step, ema, factor, late) by ``fold_steps``: exponential mean of the steps' means from 1, and a factor that never falls. A step without values changes neither."""

    def fold(carried: list[float], total: float, n: int) -> list[float]:
        ema, factor = carried
        ema = keep * ema + (1 - keep) * total / n if n else ema
        return [ema, max(factor, low + (1 - low) * ema)]

    return fold_steps(stream, run, step, value, delay, {"ema": 1.0, "factor": low}, fold).drop("total", "n")
