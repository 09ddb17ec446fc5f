"""Extension points: scorers and generators that a user gives, run over partitions with ``mapInPandas``.

A scorer is a function Iterator[pandas.DataFrame] -> Iterator[pandas.DataFrame], so it can open a client once a task. Results are
cached under a key, so a failed run goes on where it stopped. What a model gave is written to ``path`` before it is used, so
nothing is asked twice, however often the result is read.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.sources.io import cache_key, split_cached

REWARD_MANAGERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def reward_manager(name: str):
    """Register a function DataFrame -> DataFrame that adds a column ``score``."""

    def add(f):
        REWARD_MANAGERS[name] = f
        return f

    return add


def apply_scorer(df: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """All rows of a partition pass through the scorer in batches."""
    return df.mapInPandas(scorer, schema)


def safe_scorer(score_row: Callable[[dict], float], seconds: float = 10.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A scorer that adds ``score`` row by row; a row that fails, gives null or takes longer than ``seconds`` scores 0.

    The rows of a batch run in one worker thread, which is watched. The task gives up a late row after ``seconds`` and goes on behind it with a new worker; a row
    that never comes back leaves its idle thread behind until the Python worker ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, names = list(zip(*(pdf[c] for c in pdf.columns), strict=True)), list(pdf.columns)
            out, first = [0.0] * len(rows), 0
            while first < len(rows):
                worker = _Worker(score_row, names, rows, out, first, seconds)
                first = worker.wait()
            yield pdf.assign(score=out)

    return run


class _Worker:
    """Scores ``rows`` from ``first`` on into ``out`` in a thread of its own; ``wait`` returns where the next worker has to go on."""

    def __init__(self, score_row: Callable[[dict], float], names: list[str], rows: list[tuple], out: list[float], first: int, seconds: float):
        self.score_row, self.names, self.rows, self.out, self.seconds = score_row, names, rows, out, seconds
        self.at, self.since, self.left, self.error, self.lock = first, time.monotonic(), False, None, threading.Lock()
        self.thread = threading.Thread(target=self.work, daemon=True)
        self.thread.start()

    def work(self) -> None:
        try:
            while self.at < len(self.rows):
                try:
                    value = float(self.score_row(dict(zip(self.names, self.rows[self.at], strict=True))))
                except Exception:
                    value = 0.0
                with self.lock:
                    if self.left:
                        return
                    now = time.monotonic()
                    self.out[self.at] = value if value == value and now - self.since <= self.seconds else 0.0
                    self.at, self.since = self.at + 1, now
        except BaseException as e:
            self.error = e

    def wait(self) -> int:
        while True:
            self.thread.join(max(0.0, self.since + self.seconds - time.monotonic()) + 0.001)
            with self.lock:
                if not self.thread.is_alive() or self.at >= len(self.rows):
                    if self.error is not None:
                        raise self.error
                    return self.at
                if time.monotonic() - self.since > self.seconds:
                    self.left = True
                    return self.at + 1


def hash_scorer(text: str, salt: str = "") -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A deterministic stand-in for a judge: 0 to 10 from the md5 of the text, in ``response``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            digests = [hashlib.md5(f"{salt}{t}".encode()).digest()[0] % 11 for t in pdf[text]]
            yield pdf.assign(response=[f"Score: {d}" for d in digests])

    return run


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_scores(work: DataFrame, cache: DataFrame, scorer, *key_columns: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with ``response``, new cache rows): the scorer sees only rows whose key isn't in the cache (cache_key, response), and each once."""
    keyed = work.withColumn("cache_key", cache_key(*[F.col(c) for c in key_columns]))
    hits, misses = split_cached(keyed, cache)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", response string"
    fresh = _kept(apply_scorer(misses, scorer, schema), path)
    return hits.unionByName(fresh), fresh.select("cache_key", "response").distinct()


def generate_with_retry(df: DataFrame, generate: Callable[[DataFrame, int], DataFrame], path: str, rounds: int = 3) -> DataFrame:
    """``generate(rows, round)`` adds ``output``; rows whose output is empty go to the next round, the last round's stay as they are.

    Each round is written to ``path/round=k`` and read from there. Rounds end when no row is left.
    """
    out, left = None, df
    for k in range(rounds):
        got = _kept(generate(left, k), f"{path}/round={k}")
        good = F.trim(F.coalesce("output", F.lit(""))) != ""
        part = got if k == rounds - 1 else got.filter(good)
        out = part if out is None else out.unionByName(part)
        left = got.filter(~good).drop("output")
        if left.isEmpty():
            break
    return out
