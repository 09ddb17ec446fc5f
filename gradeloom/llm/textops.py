"""Vectorised text work inside tasks: exact word and n-gram ids for the documents of an Arrow batch.

A chunk is about 2 MB of consecutive documents, so memory stays bounded however long a batch or a text is
(one text is always whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

IS_WS = np.zeros(256, bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
IS_POINT = (np.arange(256) & 0xC0) != 0x80
CHUNK_BYTES = 2 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + max_bytes, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = IS_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of the documents into them; ``apart`` says which bytes stand between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray = IS_WS) -> tuple[np.ndarray, pa.Array]:
    """An exact id for each word of the chunk, and the distinct words by id."""
    kept = data[~apart[data]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter(map(lambda w: xxhash.xxh3_64_intdigest(w, seed), words.to_pylist()), np.uint64, len(words))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact id for each pair of ids."""
    if not len(a):
        return a
    return pd.factorize(a * (b.max() + 1) + b)[0].astype(np.int64)


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """An exact id for the ``n`` ids from each place on (len(ids) - n + 1 of them), by doubling."""
    if n == 1:
        return ids
    half = n // 2
    part = gram_ids(ids, half)
    both = _pair(part[: len(part) - half], part[half:]) if len(part) > half else part[:0]
    return both if n == 2 * half else _pair(both[: len(ids) - n + 1], ids[n - 1 :]) if len(ids) >= n else ids[:0]


def places(at: np.ndarray, n: int) -> np.ndarray:
    """The places at which ``n`` words in a row belong to one document, and in the second row that document."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.vstack([start, doc])
