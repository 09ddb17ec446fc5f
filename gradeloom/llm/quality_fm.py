"""Quality classifier: a factorisation machine over hashed words and text statistics.

score = sigmoid(w0 + sum_j w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)): the pairwise interactions of all
features in time linear in their number. Features come from the text alone: lower-cased words hashed into buckets
(square roots of counts, scaled to length 1 a document), and binned statistics of structure and of the text as a whole (length, lines,
symbols, capitals, punctuation, repeated words).

Fitting takes a bounded sample of the labelled rows (``max_rows``, the first in the order of a hash of the id), whose features, not
texts, come to the driver. Scoring is a pass over the documents with the weights (about 0.6 MB, fixed by the number of buckets and factors)
in the task's closure; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import materialize
from gradeloom.llm.textops import IS_POINT, IS_WS, LOWER, chunks, hash_words, utf8, word_ids, word_spans

BUCKETS = 1 << 14
FACTORS = 8
MAX_ROWS = 6000
BINS = 12
#: Classes of bytes whose share of a text is a statistic.
_CLASSES = [np.isin(np.arange(256), list(c)) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&<>", b"|", b"\n", b"()[]{}\"'/\\_=+-@~^`")] + [np.arange(256) >= 128]
#: Upper ends of the bins of a share; equal shares fall below their end.
_ENDS = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6])
N_STATS = len(_CLASSES) + 6


def _counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and n + 1 offsets of a column of texts. Empty and null texts have statistics only."""
    data, at = utf8(column)
    n = len(column)
    starts, ends, doc = word_spans(data, at)
    size = np.maximum(np.diff(at), 1)
    shares = [_counts(c[data], at) / size for c in _CLASSES]
    n_words = np.diff(doc)
    ids, distinct = word_ids(LOWER[data], starts, ends)
    owner = np.repeat(np.arange(n), n_words)
    width = max(len(distinct), 1)
    n_distinct = np.bincount(pd.unique(owner * width + ids) // width, minlength=n) if len(ids) else np.zeros(n, np.int64)
    points = _counts(IS_POINT[data], at)
    letters = points - _counts(IS_WS[data], at)
    words = np.maximum(n_words, 1)
    bins = [np.searchsorted(_ENDS, s, "left") for s in shares]
    bins.append(np.searchsorted(_ENDS, 1 - n_distinct / words, "left"))
    bins.append(np.minimum(np.log2(n_words + 1).astype(np.int64), BINS - 1))
    bins.append(np.minimum((letters / words).astype(np.int64), BINS - 1))
    lines = _counts(data == 10, at) + 1
    bins.append(np.minimum(np.log2(n_words / lines + 1).astype(np.int64), BINS - 1))
    # words that end in a sign are frequent in running text only at ends of clauses
    signed = np.bincount(owner, weights=_CLASSES[3][data[ends - 1]] | _CLASSES[4][data[ends - 1]], minlength=n) if len(ends) else np.zeros(n)
    bins.append(np.searchsorted(_ENDS, signed / words, "left"))
    again = np.flatnonzero((ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])) + 1
    bins.append(np.searchsorted(_ENDS, np.bincount(owner[again], minlength=n) / words, "left"))
    stat_ids = BUCKETS + np.arange(N_STATS) * BINS + np.stack(bins, axis=1)
    bucket = (hash_words(distinct, 7) % np.uint64(BUCKETS)).astype(np.int64)
    pair, count = np.unique(owner * BUCKETS + bucket[ids], return_counts=True)
    word_owner, word_bucket, value = pair // BUCKETS, pair % BUCKETS, np.sqrt(count)
    norm = np.sqrt(np.bincount(word_owner, weights=count, minlength=n))
    value = value / np.maximum(norm, 1)[word_owner]
    all_owner = np.concatenate([word_owner, np.repeat(np.arange(n), N_STATS)])
    order = np.argsort(all_owner, kind="stable")
    number = np.concatenate([word_bucket, stat_ids.reshape(-1)])[order]
    value = np.concatenate([value, np.full(n * N_STATS, 1 / np.sqrt(N_STATS))])[order]
    return number, value, np.searchsorted(all_owner[order], np.arange(n + 1))


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, number: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Linear part and interactions; the sum-of-squares identity makes them one pass over the features."""
        if len(at) == 1:
            return np.zeros(0)
        vx = self.v[number] * value[:, None]
        sums = np.add.reduceat(vx, at[:-1])
        squares = np.add.reduceat((vx**2).sum(axis=1), at[:-1])
        return self.w0 + np.add.reduceat(self.w[number] * value, at[:-1]) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def score(self, number: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(number, value, at), -30, 30)))


def fit(number: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """Logistic loss by Adam over shuffled batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    total = BUCKETS + N_STATS * BINS
    share = np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99)
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(total), rng.normal(0, 0.05, (total, FACTORS)))
    params = np.concatenate([fm.w[:, None], fm.v], axis=1)
    m, s, t = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            sizes = at[rows + 1] - at[rows]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(at[rows] - upto[:-1], sizes) + np.arange(upto[-1])
            j, x = number[pick], value[pick]
            fm.w, fm.v = params[:, 0], params[:, 1:]
            p = fm.score(j, x, upto)
            err = np.repeat((p - label[rows]) / len(rows), sizes)
            vx = fm.v[j] * x[:, None]
            sums = np.repeat(np.add.reduceat(vx, upto[:-1]), sizes, axis=0)
            grad_rows = np.concatenate([(err * x)[:, None], err[:, None] * x[:, None] * (sums - vx)], axis=1)
            uniq, inverse = np.unique(j, return_inverse=True)
            grad = np.zeros((len(uniq), 1 + FACTORS))
            for k in range(1 + FACTORS):
                grad[:, k] = np.bincount(inverse, weights=grad_rows[:, k], minlength=len(uniq))
            grad += decay * params[uniq]
            t += 1
            m[uniq] = 0.9 * m[uniq] + 0.1 * grad
            s[uniq] = 0.99 * s[uniq] + 0.01 * grad**2
            params[uniq] -= rate * (m[uniq] / (1 - 0.9**t)) / (np.sqrt(s[uniq] / (1 - 0.99**t)) + 1e-6)
            fm.w0 -= rate * float((p - label[rows]).mean())
    return FactorisationMachine(fm.w0, params[:, 0].astype(np.float32), params[:, 1:].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out (crc32 of the id as text, modulo 4, is not 2).

    Rows with a null id or label are left out. Without any row left the machine gives each text 0.5.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    sample = usable.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = F.broadcast(materialize(sample, "label-sample"))  # at most max_rows rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            number, value, at = features(batch.column("text"))
            listed = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(a)) for a in (number.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *listed], ["id", "label", "number", "value"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(sample, "id").select("id", "label", "text")
    got = rows.mapInArrow(extract, "id long, label double, number array<int>, value array<float>").toArrow().combine_chunks().sort_by("id")
    if not got.num_rows:
        return FactorisationMachine(0.0, np.zeros(BUCKETS + N_STATS * BINS, np.float32), np.zeros((BUCKETS + N_STATS * BINS, FACTORS), np.float32))
    lists = [got[c].combine_chunks() for c in ("number", "value")]
    sizes = np.array([len(x) for x in lists[0]], np.int64)
    number, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    return fit(number.astype(np.int64), value.astype(np.float64), np.concatenate([[0], np.cumsum(sizes)]), got["label"].to_numpy())


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def score(docs: DataFrame, machine: FactorisationMachine, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1; null and empty texts get one too. A column ``score`` of ``docs`` is replaced."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.score(*features(batch.column(text))).astype(np.float64))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


