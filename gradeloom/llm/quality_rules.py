"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text when a statistic is above a cutoff. Cutoffs come from labelled documents, by stratum: one half of the
good ones (chosen by a hash of the text, so copies are in one half, and counted once a stratum) proposes, for each of a few levels, the cutoffs that leave that share of them above (or a multiple of
their largest value), rule by rule; the other half tests the proposals. With k of n good texts of that holdout rejected by any rule, a level is certified if the
exact (Clopper-Pearson) upper bound of the false rejection rate is at most ``risk``. Levels are tested from the mildest on until one
fails, which needs no correction, and the confidence is divided by the number of strata (Bonferroni), so with probability
1 - ``delta`` no stratum rejects more than ``risk`` of its good texts. Among its certified levels a stratum takes the one that best separates bad
from good texts of the proposing half; one without a certified level rejects nothing by these rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small
from gradeloom.llm.textops import IS_POINT, IS_WS, chunks, gram_ids, places, utf8, word_ids, word_spans

#: Proposed cutoffs from the mildest on: (share of good texts left above, factor on that quantile).
LEVELS = ((0.0, 3.0), (0.0, 2.0), (0.0, 1.5), (0.0005, 1.0), (0.001, 1.0), (0.002, 1.0), (0.005, 1.0), (0.01, 1.0), (0.02, 1.0))
#: No cutoff on a share is below this.
FLOOR = 0.02
RULES = ("symbol_share", "capital_share", "shout_share", "repeat_share", "stutter_share", "dup_line_share", "word_length")
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITALS = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)
_NAMES = [x.split()[0] for x in STATS.split(", ")]


def _per_doc(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The columns STATS for a column of whole texts; nulls are empty, and shares of nothing are 0."""
    data, at = utf8(column)
    n = len(column)
    starts, ends, doc = word_spans(data, at)
    ids, _ = word_ids(data, starts, ends)
    n_words = np.diff(doc)
    owner = np.repeat(np.arange(n), n_words)
    space = IS_WS[data]
    word_chars = _per_doc(IS_POINT[data] & ~space, at)
    n_symbols = _per_doc(_SYMBOLS[data], at)

    # lines: all bytes but the line feeds, cut at line feeds and at the ends of texts
    feed = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1], feed + 1]))
    line_owner = np.minimum(np.searchsorted(at, line_starts, "right") - 1, n - 1)
    # an empty text begins where the next one does; its one line is empty, whoever is taken for its owner
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), at[line_owner + 1])
    line_ends = np.where((line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else False, line_ends - 1, line_ends)
    filled = np.concatenate([[0], np.cumsum(~space)])
    worded = filled[line_ends] > filled[line_starts]
    s, e, o = line_starts[worded], line_ends[worded], line_owner[worded]
    keep = np.zeros(len(data) + 1, np.int64)
    np.add.at(keep, s, 1)
    np.add.at(keep, e, -1)
    inside = np.cumsum(keep[:-1]) > 0
    offsets = np.concatenate([[0], np.cumsum(e - s)])
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    line_ids = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    dup = pd.Series(o * (len(lines.dictionary) + 1) + line_ids).duplicated().to_numpy()
    n_lines, n_dup = np.bincount(o, minlength=n), np.bincount(o[dup], minlength=n)

    where, window_owner = places(doc, 8)
    grams = gram_ids(ids, 8)[where] if len(ids) >= 8 else where
    again = pd.Series(window_owner * (grams.max(initial=0) + 1) + grams).duplicated(keep=False).to_numpy()
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, where[again], 1)
    np.add.at(cover, where[again] + 8, -1)
    n_repeat = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)

    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    stutter = np.flatnonzero((ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])) + 1
    shares = [
        n_symbols / chars,
        _per_doc(_CAPITALS[data], at) / chars,
        _per_doc(data == 33, at) / chars,
        n_repeat / words,
        np.bincount(owner[stutter], minlength=n) / words,
        n_dup / np.maximum(n_lines, 1),
        word_chars / words,
    ]
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, *shares]


def rule_stats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(id, stratum, twin, STATS), a row a document; ``twin`` is a hash of the text.

    A null or empty text has no words and counts of 0. Null ids and strata stay null, repeated rows give a row each, other columns are not
    looked at, and an empty table gives an empty result. ``key`` names a whole number, or text that is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            stats = [pa.array(a.astype(np.float64 if name in RULES else np.int64)) for name, a in zip(_NAMES, statistics(batch.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stratum"), batch.column("twin"), *stats], ["id", "stratum", "twin", *_NAMES])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(stratum).cast("string").alias("stratum"), F.xxhash64(text).alias("twin"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id long, stratum string, twin long, {STATS}")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from exact logarithms of the ratios of neighbouring terms."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + np.log(p / (1 - p)))]) + n * np.log1p(-p)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n have probability ``delta``; 1 where nothing was seen."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.1, *, key: str = "doc_id", label: str = "quality", base=None) -> DataFrame:
    """(stratum, level, bound, cutoffs array<double>): the chosen place in LEVELS of each labelled stratum; null cutoffs where none is certified.

    Labels with a null id or label are left out; ids labelled twice count with their larger label. A text counts once in a stratum and for a label, however
    many copies of it are labelled: the exact bound needs trials that are independent. A null stratum is one of its own. Texts that ``base`` (a condition on stats) rejects are neither proposed nor tested. The work is joins and aggregates
    over labelled rows; what is left for one task is a row for each stratum and level.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).alias("good"))
    rows = stats.join(marks, "id").dropDuplicates(["stratum", "twin", "good"]).withColumn("half", F.pmod("twin", F.lit(2)))
    if base is not None:
        rows = rows.filter(~base)
    good = rows.filter("half = 0 and good = 1")
    shares = F.array(*[F.lit(1 - share) for share, _ in LEVELS])
    factors = F.array(*[F.lit(factor) for _, factor in LEVELS])
    cuts = good.groupBy("stratum").agg(*[F.percentile_approx(r, shares, 10000).alias(r) for r in RULES])
    by_level = F.transform(F.sequence(F.lit(0), F.lit(len(LEVELS) - 1)), lambda i: F.array(*[F.greatest(F.get(F.col(r), i) * F.get(factors, i), F.lit(FLOOR)) for r in RULES]))
    cuts = cuts.select(F.col("stratum").alias("_stratum"), F.posexplode(by_level).alias("level", "cutoffs"))
    above = [F.col(r) > F.get(F.col("cutoffs"), F.lit(i)) for i, r in enumerate(RULES)]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    tried = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum"))).groupBy("stratum", "level").agg(
        F.first("cutoffs").alias("cutoffs"),
        *[F.count(F.when(cond, 1)).alias(name) for name, cond in (
            ("n", (F.col("half") == 1) & (F.col("good") == 1)), ("k", (F.col("half") == 1) & (F.col("good") == 1) & rejected),
            ("good_a", (F.col("half") == 0) & (F.col("good") == 1)), ("good_a_out", (F.col("half") == 0) & (F.col("good") == 1) & rejected),
            ("bad_a", (F.col("half") == 0) & (F.col("good") == 0)), ("bad_a_out", (F.col("half") == 0) & (F.col("good") == 0) & rejected))])
    n_strata = tried.select("stratum").distinct().count()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        best, best_gain = None, 0.0
        bound = 1.0
        for row in pdf.sort_values("level").itertuples():
            bound_here = upper_bound(int(row.k), int(row.n), delta / max(n_strata, 1))
            if bound_here > risk:
                break
            gain = row.bad_a_out / max(row.bad_a, 1) - row.good_a_out / max(row.good_a, 1)
            if best is None or gain > best_gain + 1e-12:
                best, best_gain, bound = row, gain, bound_here
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "level": [best.level if best else None], "bound": [bound if best else None], "cutoffs": [best.cutoffs if best else None]})

    return tried.groupBy("stratum").applyInPandas(choose, "stratum string, level int, bound double, cutoffs array<double>")


def apply_rules(stats: DataFrame, cutoffs: DataFrame, base) -> DataFrame:
    """``stats`` with ``base_failed``, ``failed_rule`` (the first rule above its cutoff, or null) and ``kept``.

    A stratum without a row in ``cutoffs``, or with null cutoffs there, has no rule that fails; a null stratum is one of its own. Every row
    stays, repeated ones too.
    """
    chosen = broadcast_if_small(cutoffs.select(F.col("stratum").alias("_stratum"), "cutoffs"))
    joined = stats.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.coalesce(*[F.when(F.col(r) > F.get(F.col("cutoffs"), F.lit(i)), F.lit(r)) for i, r in enumerate(RULES)])
    return joined.withColumn("base_failed", base).withColumn("failed_rule", failed).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("_stratum", "cutoffs")
