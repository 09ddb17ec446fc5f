"""Data sources for files that Spark's readers take as one string: text logs by byte ranges, and JSON documents element by element.

A range or a document is read as a stream, so memory holds a line or an element and never a file. Folders are read with all that is below them, but for names
that begin with ``_`` or ``.``; patterns aren't expanded. Files ending in a known compression are unpacked; those can't be cut into ranges.
"""

from __future__ import annotations

import codecs
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a log that are one range, bytes that a task is given (a file counts ``OPEN_COST`` beside its size), and bytes and rows of a batch of rows.
RANGE_BYTES, TASK_BYTES, OPEN_COST, BATCH_BYTES, BATCH_ROWS = 64 << 20, 128 << 20, 4 << 20, 4 << 20, 10_000
PACKED = (".gz", ".bz2", ".zst", ".lz4")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def files_below(path: str) -> list[tuple[str, int]]:
    """(path in its file system, size) of a file, or of the files of a folder."""
    system, at = store(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda name: any(part.startswith(("_", ".")) for part in name[len(at) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


@dataclass
class Pieces(InputPartition):
    """(file, first byte, end) of what a task reads."""

    pieces: list[tuple[str, int, int]]


def packed(pieces: list[tuple[str, int, int]], cores: int = 1) -> list[Pieces]:
    """Pieces by tasks: of ``TASK_BYTES``, or of a core's share where that is less."""
    share = sum(end - start + OPEN_COST for _, start, end in pieces) // cores
    most = min(TASK_BYTES, max(share, OPEN_COST))
    tasks, size = [], most
    for piece in pieces:
        if size >= most:
            tasks.append(Pieces([]))
            size = 0
        tasks[-1].pieces.append(piece)
        size += piece[2] - piece[1] + OPEN_COST
    return tasks


def lines_of(raw: io.BufferedReader, start: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte is in ``start`` .. ``end``; the last may reach further. Nothing behind ``end`` is read to find the first."""
    at = max(start - 1, 0)
    if at:
        raw.seek(at)
    while start and at < end:
        skipped = raw.readline(1 << 20)
        at += len(skipped)
        if not skipped or skipped.endswith(b"\n"):
            break
    while at < end and (line := raw.readline()):
        at += len(line)
        yield line


class Elements:
    """The elements of one JSON document, read in chunks: (name, JSON text).

    ``part`` names what they are: "" the elements of a list (a document that isn't a list is its one element), "*" the members of an object, any other
    name the elements of the list under that name (none where it is missing or null). An empty file has none. Broken or truncated JSON raises ValueError.
    """

    def __init__(self, raw, part: str, chunk: int = 1 << 20):
        self.raw, self.part, self.chunk = raw, part, chunk
        self.text, self.at, self.ended = "", 0, False
        self.decoder, self.bytes = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()

    def more(self) -> None:
        rest = len(self.text) - self.at
        found = self.raw.read(max(self.chunk, rest))  # doubles, so a long element is tried a few times only
        self.ended = not found
        self.text, self.at = self.text[self.at :] + self.bytes.decode(found, self.ended), 0

    def peek(self) -> str:
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"one of {wanted!r} is expected, not {found!r}")
        self.at += 1
        return found

    def value(self) -> str:
        self.peek()
        while True:
            try:
                end = self.decoder.raw_decode(self.text, self.at)[1]
                if end < len(self.text) or self.ended:  # a number may go on in the next chunk
                    break
            except ValueError:
                if self.ended:
                    raise
            self.more()
        found, self.at = self.text[self.at : end], end
        return found

    def items(self) -> Iterator[tuple[str | None, str]]:
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield None, self.value()
            if self.take(",]") == "]":
                return

    def members(self) -> Iterator[tuple[str | None, str]]:
        self.take("{")
        if self.peek() == "}":
            self.take("}")
            return
        while True:
            name = json.loads(self.value()).encode("utf-8", "replace").decode()  # half a surrogate pair has no bytes
            self.take(":")
            if self.part == name != "*" and self.peek() == "[":
                yield from self.items()
            else:
                value = self.value()
                if self.part == "*":
                    yield name, value
            if self.take(",}") == "}":
                return

    def __iter__(self) -> Iterator[tuple[str | None, str]]:
        first = self.peek()
        if not first:
            return
        if self.part:
            yield from self.members()
        elif first == "[":
            yield from self.items()
        else:
            yield None, self.value()
        if self.peek():
            raise ValueError("text behind the document")


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches that a long last column ends early."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.cores = options["path"], int(options.get("bytes", RANGE_BYTES)), int(options.get("cores", 1))

    def partitions(self) -> list[InputPartition]:
        return packed([(name, start, min(start + cut, size)) for name, size in files_below(self.path) for cut in [size if name.endswith(PACKED) else self.size] for start in range(0, size, max(cut, 1))], self.cores)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)

        def rows():
            for name, start, end in partition.pieces:
                whole = name.endswith(PACKED)
                with system.open_input_stream(name) if whole else system.open_input_file(name) as f:
                    for i, line in enumerate(lines_of(io.BufferedReader(f, 1 << 20), start, 1 << 62 if whole else end)):
                        yield name, start, i, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")

        return batches(rows(), pa.schema([("path", pa.string()), ("start", pa.int64()), ("i", pa.int64()), ("line", pa.string())]))


class LogLines(DataSource):
    """(path, start, i, line): lines of text files, ``i`` from 0 in the range that begins at byte ``start``. Options ``bytes``: of a range, ``cores``: to be kept busy."""

    @classmethod
    def name(cls) -> str:
        return "gradeloom_lines"

    def schema(self) -> str:
        return "path string, start long, i long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _ElementReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part, self.cores = options["path"], options.get("part", ""), int(options.get("cores", 1))

    def partitions(self) -> list[InputPartition]:
        return packed([(name, 0, size) for name, size in files_below(self.path)], self.cores)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)

        def rows():
            for name, _, _ in partition.pieces:
                with system.open_input_stream(name) as f:
                    try:
                        for i, (key, value) in enumerate(Elements(f, self.part)):
                            yield name, i, key, value
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e

        return batches(rows(), pa.schema([("path", pa.string()), ("i", pa.int64()), ("name", pa.string()), ("json", pa.string())]))


class JsonElements(DataSource):
    """(path, i, name, json): what ``Elements`` gives of each file. Options ``part``, as there, and ``cores``: to be kept busy."""

    @classmethod
    def name(cls) -> str:
        return "gradeloom_elements"

    def schema(self) -> str:
        return "path string, i long, name string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _ElementReader(self.options)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(LogLines)
    return spark.read.format(LogLines.name()).option("bytes", range_bytes).option("cores", spark.sparkContext.defaultParallelism).load(path)


def read_elements(spark: SparkSession, path: str, part: str = "") -> DataFrame:
    spark.dataSource.register(JsonElements)
    return spark.read.format(JsonElements.name()).option("part", part).option("cores", spark.sparkContext.defaultParallelism).load(path)
