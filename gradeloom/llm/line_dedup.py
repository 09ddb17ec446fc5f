"""Line dedup through a sharded minimal perfect hash.

Every distinct line key has a 128-bit hash. All of them go, by hash, to shards of bounded size; each shard is a folder with a
minimal perfect hash (levels of bit sets: a key sits in the first level where no other key of the shard falls on its bit,
and the rank of that bit is its place), an array of 32-bit fingerprints and one of document counts, both in the order of
the places. Keepers are stored for the keys that enough documents hold alone; a bit set beside the counts marks these, and the
rank of a key's bit is its keeper's place. Documents probe the arrays, in blocks and shard by shard, instead of joining
their lines to a table of lines, so texts are never shuffled and a very common line costs no more than a rare one.

Keys that are probed come from the documents that were indexed, so each is in the index and its count is exact; fingerprints
guard the probing of other documents, of whose keys one in 2^32 may be taken for another.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import WS, makedirs, materialize, scratch_path
from gradeloom.llm.textops import chunks

KEYS_PER_SHARD = 500_000
_CACHE_BYTES = 128 << 20
#: Text whose lines are looked up at a time; larger blocks go through the shards less often.
BLOCK_BYTES = 8 << 20
_WS_BYTES = WS.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line that counts: stripped of ASCII white space, A-Z lower-cased, ``min_chars`` code points or more."""
    key = line.strip(_WS_BYTES).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct pairs of 64-bit numbers; ``place`` gives -1 or any place for other pairs."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels, self.n = levels, n
        done, self.ranks = 0, []
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(done + np.cumsum(counts) - counts)
            done += int(counts.sum())

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, n = [], len(hi)
        while len(hi):
            size = -(-max(64, int(gamma * len(hi))) // 64) * 64
            at = (_mix(hi, lo, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(levels, n)

    def place(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(hi[open_], lo[open_], level) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


class RankedBits:
    """A bit set that says how many bits are set before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(flags) // 64) * 64, bool)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view("<u8")

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bit is set, and how many are before it."""
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return (word >> bit) & np.uint64(1) == 1, self.before[at >> 6] + below


def _write_shard(root: str, min_docs: int, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["hi", "lo"])
    hi, lo = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
    index = PerfectHash.build(hi, lo)
    order = np.argsort(index.place(hi, lo))
    # a key that only rows with null ids hold has no keeper and counts as one that nobody holds
    counts = np.where(pdf["keeper"].isna(), 0, pdf["n"]).astype(np.int64)[order]
    shared = counts >= max(min_docs, 1)
    arrays = {
        "bits": np.concatenate([np.zeros(0, "<u8"), *index.levels]),
        "ends": np.cumsum([len(b) for b in index.levels], dtype=np.int64),
        "fingerprints": (lo[order] >> np.uint64(32)).astype(np.uint32),
        "counts": np.minimum(counts, 0xFFFFFFFF).astype(np.uint32),
        "shared": RankedBits.pack(shared),
        "keepers": pdf["keeper"].to_numpy()[order][shared].astype(np.int64),
    }
    shard = int(pdf["shard"].iloc[0])
    system, at = makedirs(f"{root}/{shard:06d}")
    for name, array in arrays.items():
        out = io.BytesIO()
        np.save(out, array)
        # every attempt writes the same bytes, so a second one may replace the first
        part = f"{at}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(out.getvalue())
        system.move(part, f"{at}/{name}.npy")
    return pd.DataFrame({"shard": [shard], "n_keys": [len(pdf)]})


class LineIndex:
    """Maps shards into memory where the shared store is a mounted file system, so the workers of a machine share its
    page cache; from other stores it reads shards as they are needed and keeps the last used ones, up to a fixed
    number of bytes."""

    def __init__(self, root: str, n_shards: int):
        self.root, self.n_shards, self.kept, self.held = root, n_shards, OrderedDict(), 0
        self.system, self.at = makedirs(root)

    def _array(self, k: int, name: str) -> np.ndarray:
        path = f"{self.at}/{k:06d}/{name}.npy"
        if isinstance(self.system, fs.LocalFileSystem):
            return np.load(path, mmap_mode="r")
        with self.system.open_input_stream(path) as f:
            return np.load(io.BytesIO(f.read()))

    def shard(self, k: int):
        if k not in self.kept:
            levels = np.split(np.asarray(self._array(k, "bits")), self._array(k, "ends")[:-1])
            arrays = [self._array(k, name) for name in ("fingerprints", "counts", "keepers")]
            shared = RankedBits(np.asarray(self._array(k, "shared")))
            size = sum(a.nbytes for a in (*levels, *arrays, shared.words)) + 8 * sum(map(len, (*levels, shared.words)))
            self.kept[k] = (PerfectHash(levels, len(arrays[0])), shared, *arrays, size)
            self.held += size
            while len(self.kept) > 1 and self.held > _CACHE_BYTES:
                self.held -= self.kept.popitem(last=False)[1][-1]
        self.kept.move_to_end(k)
        return self.kept[k]

    def look_up(self, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not in the index, or of null ids alone) and keepers (where the key is shared) for keys of 16 bytes each, one after another."""
        pairs = np.frombuffer(keys, "<u8").reshape(-1, 2)
        hi, lo = pairs[:, 0].copy(), pairs[:, 1].copy()
        counts, keepers = np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        if not self.n_shards:
            return counts, keepers
        shard = (hi % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for k in np.flatnonzero(np.diff(ends)):
            mine = order[ends[k] : ends[k + 1]]
            index, shared, fingerprints, n, keeper, _ = self.shard(int(k))
            at = index.place(hi[mine], lo[mine])
            hit = at >= 0
            hit[hit] = fingerprints[at[hit]] == (lo[mine[hit]] >> np.uint64(32)).astype(np.uint32)
            mine, at = mine[hit], at[hit]
            counts[mine] = n[at]
            is_shared, place = shared.look(at)
            keepers[mine[is_shared]] = keeper[place[is_shared]]
        return counts, keepers


def _keys_of(text: bytes | None, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or b"").split(b"\n")]


def build_index(docs: DataFrame, root: str, min_chars: int, min_docs: int, key: str, text: str, keys_per_shard: int) -> int:
    """Write the index of all line keys; returns the number of shards."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            keys, ids = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                own = {k for k in _keys_of(t, min_chars) if k}
                keys += own
                ids += [i] * len(own)
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "id"])

    held = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(emit, "hi long, lo long, id long")
    lines = materialize(held.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")), "lines")
    n_shards = -(-lines.count() // keys_per_shard)
    if n_shards:
        # the unsigned remainder of hi, as LineIndex takes it
        high = F.shiftrightunsigned("hi", 1)
        shard = ((high % n_shards) * 2 + F.col("hi").bitwiseAND(1)) % n_shards
        built = lines.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(lambda pdf: _write_shard(root, min_docs, pdf), "shard int, n_keys long")
        built.agg(F.sum("n_keys")).collect()
    return n_shards


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, *, key: str = "doc_id", text: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept_text``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of ``min_chars`` code points or
    more that ``min_docs`` rows or more hold lose all their lines except in the rows with the largest id that holds
    them. Each row counts as a document, repeated rows too. A null or empty text is one empty line. A null id is
    below all others, and a key that only rows with null ids hold stays. Columns of ``docs`` with one of the three names
    are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    root = scratch_path(docs.sparkSession, "line-index")
    n_shards = build_index(docs, root, min_chars, min_docs, key, text, keys_per_shard)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(root, n_shards)
        for batch in chunks(batches, text, BLOCK_BYTES):
            ids = batch.column(key).to_pylist()
            lines = [(t or b"").split(b"\n") for t in batch.column(text).cast(pa.large_binary()).to_pylist()]
            keys = [[line_key(x, min_chars) for x in own] for own in lines]
            counts, keepers = index.look_up(b"".join(k for own in keys for k in own if k))
            found = iter(zip(counts.tolist(), keepers.tolist(), strict=True))
            kept_texts, dropped = [], []
            for i, own, own_keys in zip(ids, lines, keys, strict=True):
                kept = []
                for line, k in zip(own, own_keys, strict=True):
                    n, keeper = next(found) if k else (0, 0)
                    if n < max(min_docs, 1) or keeper == i:
                        kept.append(line)
                kept_texts.append(b"\n".join(kept))
                dropped.append(len(own) - len(kept))
            kept_text = pa.array(kept_texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()), kept_text], [*batch.schema.names, "n_lines", "n_dropped", "kept_text"])

    out = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_lines long, n_dropped long, kept_text string").fields])
    return docs.mapInArrow(probe, out)
