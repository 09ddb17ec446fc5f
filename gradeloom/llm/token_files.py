"""Token ids in Arrow IPC files of equal-length sequences.

Documents are range-partitioned and sorted by id; each task encodes its documents, ends each with an end id, runs the
ids together and writes them as record batches with two fixed-size-list columns, ``ids`` (uint16 or uint32) and ``mask``
(false for the padding behind a file's last id). Fixed-size lists of numbers have no offsets, so a memory-mapped file gives
any sequence of any batch without a copy. A second file beside it says where each document begins.

Encoding: the tokenizer must split at white space before anything else that reaches across words, so that a text's ids are those of
its words one after another; a file for which probes show another behaviour is an error. Each distinct word of a block is encoded once; words of ASCII and Latin-1
letters, digits and signs are split by the pre-tokenizer's own pattern and their pieces go to the tokenizer's model through a bounded cache, all
other words through the whole tokenizer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import makedirs, materialize
from gradeloom.llm.textops import chunks, utf8, word_ids, word_spans

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
_CACHE = 600_000
#: Text that is encoded at a time; larger blocks repeat fewer distinct words.
BLOCK_BYTES = 8 << 20
# The tokenizer's pre-tokenizer pattern, for words of ASCII and Latin-1 letters after lower-casing.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Words that tell the pre-tokenizer's pattern from others.
_PROBES = ("Hello", "don't", "WE'LL", "abc123def", "12,345.67", "x!!y", "...", "Straße", "ÀÉ×÷", "a-b_c", "naïve2x", "'s", "(see)", "http://a.b/c?d=1")
# Byte-level alphabet: a printable Latin-1 byte stands for itself, the others for the characters from U+0100 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_OTHERS)}


class WordEncoder:
    """Ids of single words under a tokenizer file that lower-cases and drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if whole(" ".join(_PROBES)) != [i for w in _PROBES for i in whole(w)]:
            raise ValueError(f"{path}: ids of a text aren't those of its words one after another")
        # a tokenizer with another pre-tokenizer gets every word whole
        self.fast = True
        self.fast = all(np.frombuffer(self.word(w.encode()), self.dtype).tolist() == whole(w) for w in _PROBES)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        got = np.array([t.id for t in self.model.tokenize(text)], self.dtype).tobytes()
        if len(self.pieces) >= _CACHE:
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.fast or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        lower = text.lower()
        if lower.isalpha():
            return self.pieces.get(lower) or self._piece(lower)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(lower)])

    def texts(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, each followed by ``end_id``, and the number of ids of each."""
        data, at = utf8(column)
        starts, ends, doc = word_spans(data, at)
        words, distinct = word_ids(data, starts, ends)
        coded = [self.word(w) for w in distinct.to_pylist()]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(coded), self.dtype)
        first = np.cumsum(lengths) - lengths
        n = lengths[words]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[words] - upto[:-1], n) + np.arange(upto[-1])]
        ends_at = upto[doc[1:]]
        return np.insert(ids, ends_at, end_id), np.diff(upto[doc]) + 1


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, so its cache serves all tasks that the worker runs."""
    return WordEncoder(path)


class SequenceFile:
    """Writes a stream of ids as one Arrow file of equal-length sequences, padded at the end."""

    def __init__(self, out, dtype: np.dtype, sequence: int):
        self.dtype, self.sequence = dtype, sequence
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = ipc.new_file(out, self.schema)
        self.rest, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        block = self.sequence * SEQUENCES_PER_BATCH
        if self.held >= block:
            joined = np.concatenate(self.rest)
            for i in range(0, len(joined) // block * block, block):
                self._put(joined[i : i + block], block)
            self.rest = [joined[len(joined) // block * block :]]
            self.held = len(self.rest[0])

    def _put(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(a), self.sequence) for a in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.sequence) * self.sequence, self.dtype)
            ids[: self.held] = np.concatenate(self.rest)
            self._put(ids, self.held)
        self.writer.close()


def open_ipc(path: str) -> ipc.RecordBatchFileReader:
    """A memory-mapped reader where the store is a mounted file system, else one over ranges of the object."""
    system, at = makedirs(path.rpartition("/")[0])
    at = f"{at}/{path.rpartition('/')[2]}"
    return ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at))


def sequence_at(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the mapped file) and mask of sequence number ``i``."""
    reader = open_ipc(path)
    batch, row = reader.get_batch(i // SEQUENCES_PER_BATCH), i % SEQUENCES_PER_BATCH
    ids, mask = (batch.column(k).slice(row, 1).flatten() for k in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int, *, sequence: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending order of id; returns (part, file, n_tokens, base), a row a file.

    ``base`` is the number of ids in all files before. A null text is empty and gets its end id; null ids come first;
    rows that repeat an id follow each other in the order of a hash of the text. Each attempt of a task writes
    files of its own; only those of attempts that ended well are in the returned table.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = word_encoder(tokenizer)
        system, at = makedirs(root)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        total = 0
        with system.open_output_stream(f"{at}/{name}") as out, system.open_output_stream(f"{at}/{name}.index") as index_out, ipc.new_file(index_out, index) as docs_out:
            ids_out = SequenceFile(out, encoder.dtype, sequence)
            for batch in chunks(batches, "text", BLOCK_BYTES):
                ids, n = encoder.texts(batch.column("text"), end_id)
                ids_out.add(ids)
                docs_out.write_batch(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=index))
                total += int(n.sum())
            ids_out.close()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{root}/{name}"]), pa.array([total], pa.int64())], ["part", "file", "n_tokens"])

    files = materialize(dealt.mapInArrow(write, "part int, file string, n_tokens long"), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0)))


#: Ids of the documents that are handed on together.
SLAB_IDS = 1 << 20


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian uint32), a row a document, from the files of write_tokens.

    Repeated and null ids come back as they were written; no files give no rows. Documents are handed on in slabs of SLAB_IDS ids at most, a longer one alone, so
    memory is bounded by the longest text and not by how many long ones stand together; a document of more than 2^29 ids is beyond what a binary value holds.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, index = open_ipc(file), open_ipc(f"{file}.index")
                held, first, block = np.zeros(0, np.uint32), 0, 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    ends, lo = np.cumsum(sizes), 0
                    while lo < len(starts):
                        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + SLAB_IDS, "right")))
                        s, n = starts[lo:hi], sizes[lo:hi]
                        parts, upto = [held[s[0] - first :]], first + len(held)
                        while upto < s[-1] + n[-1]:
                            got = reader.get_batch(block)
                            values = got.column(0).flatten().to_numpy()[got.column(1).flatten().to_numpy(zero_copy_only=False)]
                            parts.append(values)
                            upto += len(values)
                            block += 1
                        held, first = np.concatenate(parts).astype("<u4"), s[0]
                        ids = [held[a - first : a - first + m].tobytes() for a, m in zip(s, n, strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0).slice(lo, len(s)), pa.array(base + s), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        lo = hi

    return files.select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


