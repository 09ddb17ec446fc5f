"""WARC archives: write pages as records, read archives back, and reassemble segmented records.

Pages become ``response`` records (an HTTP message in chunked transfer framing) or, when a page with a smaller id has the
same payload, ``revisit`` records without one. A record longer than ``segment_bytes`` is cut: its first part stays a
response with segment number 1, and ``continuation`` records, in an archive of their own, carry the rest. Reading gives
a row a record; continuation records are then grouped by the identifier of their origin, put in the order of their
segment numbers, checked against the total length and joined, before the chunked framing is taken off.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, makedirs, materialize

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4096
_CRLF = b"\r\n"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "file string, page_id long, record_id string, record_type string, date string, refers_to string, payload_digest string, segment_number int, segment_origin string, segment_total long, block binary, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 4 + size > len(body) or body[end + 2 + size : end + 4 + size] != _CRLF:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message, with chunked framing taken off."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return gzip.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def first_holders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, first, repeats): the smallest page_id for each payload digest that several rows have, and how many rows have that id."""
    held = pages.filter(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("repeats"), F.sum("n").alias("n"))
    return held.filter("n > 1 and first is not null").select("digest", "first", "repeats")


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _first_urn(page_id: int, digest: str) -> str:
    """The record id of the response that revisits of a payload refer to."""
    return _urn(f"response/{page_id}/{digest}")


def write_warc(pages: DataFrame, root: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0, date: datetime.datetime | None = None) -> DataFrame:
    """Write a record for each row of (page_id, url, html) and return the table (file, n_records) of the archives.

    A null html is an empty payload, a null url is about:blank, a null page_id counts as the largest. Rows that repeat
    the smallest page_id of a payload are all responses, and revisits refer to the record of one of them. ``date`` (now, by default) is the WARC-Date of all
    records, to the second and in UTC. Other columns are not looked at; an empty table gives no archives. Each attempt of a task writes files of its own, and only those
    of attempts that ended well are in the returned table, so a lost executor leaves no half archive in it.
    """
    stamp = (date or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    firsts = broadcast_if_small(materialize(first_holders(pages, min_revisit_bytes), "warc-firsts"))
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    dealt = pages.join(firsts, "digest", "left").withColumn("again", F.lit(0))
    again = is_first & (F.col("repeats") > 1)
    if not firsts.filter("repeats > 1").isEmpty():
        # one of the rows that repeat an id owns the record that revisits name
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) - 1
        dealt = dealt.filter(~F.coalesce(again, F.lit(False))).unionByName(dealt.filter(again).withColumn("again", number))
    role = F.when(is_first & (F.col("again") == 0), "first").when(F.col("first").isNotNull() & ~is_first, "revisit")
    dealt = dealt.select("page_id", "url", "html", "digest", "first", role.alias("role"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = makedirs(root)
        name = f"{at}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        counts = {f"{name}.warc.gz": 0, f"{name}-continued.warc.gz": 0}
        main, more = (system.open_output_stream(f, compression=None) for f in counts)

        def put(out, path: str, kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> None:
            out.write(_record([("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", stamp), *fields], block))
            counts[path] += 1

        first_path, more_path = counts
        row = 0
        for batch in batches:
            for page_id, url, html, digest, first, role in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "role")), strict=True):
                payload = html.encode()
                record_id = _first_urn(page_id, digest) if role == "first" else _urn(f"{name}/{row}")
                row += 1
                shared = [("WARC-Page-ID", page_id), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                if role == "revisit":
                    put(main, first_path, "revisit", record_id, [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _first_urn(first, digest)), ("WARC-Refers-To-Date", stamp), *shared], b"")
                    continue
                block = _HTTP_HEAD + chunked(payload)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                put(main, first_path, "response", record_id, [*shared, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
                for i, part in enumerate(parts[1:], 2):
                    total = len(block) if i == len(parts) else None
                    put(more, more_path, "continuation", _urn(f"{record_id}/{i}"), [("WARC-Target-URI", _clean(url)), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part)
        main.close()
        more.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{f.rpartition('/')[2]}" for f in counts]), pa.array(list(counts.values()), pa.int64())], ["file", "n_records"])

    return materialize(dealt.mapInArrow(write, "file string, n_records long"), "warc-files").filter("n_records > 0")


def _members(stream, block: int = 1 << 14) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members of a stream, each unpacked; for one that is broken or cut short, what could be read and why it ends there."""
    data = b""
    unpack, out = zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                if out:
                    yield b"".join(out), "truncated gzip member"
                return
        try:
            out.append(unpack.decompress(data))
        except zlib.error as e:
            yield b"".join(out), f"broken gzip member: {e}"
            return
        data = b""
        if unpack.eof:
            yield b"".join(out), None
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []


def _parsed(file: str, member: bytes, error: str | None) -> tuple:
    """A row of RECORDS; ``error`` says what keeps the record from being whole."""
    head, found, rest = member.partition(b"\r\n\r\n")
    h = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda k: int(h[k]) if h.get(k, "").strip().lstrip("-").isdigit() else None
    size = number("content-length")
    lacking = [k for k in ("warc-record-id", "warc-type", "warc-date", "content-length") if k not in h]
    if error is None and (not found or lacking):
        error = f"header lacks {', '.join(lacking)}" if lacking else "header without end"
    content = rest[: max(size or 0, 0)]
    if error is None and (size is None or len(content) < size):
        error = "block shorter than its stated length"
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return file, number("warc-page-id"), h.get("warc-record-id"), h.get("warc-type"), h.get("warc-date"), h.get("warc-refers-to"), digest, number("warc-segment-number"), h.get("warc-segment-origin-id"), number("warc-segment-total-length"), content, error


def _records(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[tuple]:
    """The records of the archives that column ``file`` names, one after another."""
    for batch in batches:
        for file in batch.column("file").to_pylist():
            system, at = makedirs(file.rpartition("/")[0])
            with system.open_input_stream(f"{at}/{file.rpartition('/')[2]}", compression=None) as stream:
                for member, error in _members(stream):
                    row = _parsed(file, member, error)
                    if strict and row[-1]:
                        raise ValueError(f"{file}, record {row[2]}: {row[-1]}")
                    yield row


def read_warc(files: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each record of the archives in column ``file``, with its block as it stands; each file is one task's.

    A record that is cut short, broken or without one of the headers that every record has is an error, or, where ``strict`` is false, a
    row whose ``error`` says what is wrong with it. Repeated files are read as often as they are named; no files give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _records(batches, strict):
            rows.append(row)
            held += len(row[-2])
            if held > 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return files.select("file").mapInArrow(read, RECORDS)


_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_NAMES = [field.split()[0] for field in RECORDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole response records: (page_id, record_id, payload_digest, blocks array<binary>, complete).

    Only segmented records are shuffled, by the identifier of their first segment; a group is the parts of one record.
    ``complete`` is false where a segment is missing or repeated or the lengths don't add up to the stated total; segments
    without a first one give a row with a null page_id. Records with an ``error`` take no part, so what they belong to isn't complete.
    An empty table gives an empty result.
    """
    records = records.filter("error is null")
    whole = records.filter("record_type = 'response' and segment_number is null").select("page_id", "record_id", "payload_digest", F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    origin = F.when(F.col("record_type") == "response", F.col("record_id")).otherwise(F.col("segment_origin"))
    parts = records.filter("segment_number is not null").groupBy(origin.alias("record_id")).agg(
        F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.max("segment_total").alias("total"), F.max("segment_number").alias("last"),
        F.countDistinct("segment_number").alias("n_numbers"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block")).alias("size"),
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("parts"))
    complete = (F.col("n") == F.col("last")) & (F.col("n_numbers") == F.col("n")) & F.col("size").eqNullSafe(F.col("total"))
    joined = parts.select("page_id", "record_id", "payload_digest", F.transform("parts", lambda p: p["block"]).alias("blocks"), complete.alias("complete"))
    return whole.unionByName(joined)


def payloads(responses: DataFrame) -> DataFrame:
    """(page_id, record_id, payload binary, payload_bytes, payload_digest, ok) of reassembled responses.

    ``ok`` says that all segments were there, the framing was whole and the digest is the one the record states; the
    payload is null where the framing is broken. Every row stays, repeated ones too.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [http_payload(b"".join(parts)) for parts in batch.column("blocks").to_pylist()]
            digests = [None if p is None else base32_sha1(p) for p in got]
            ok = [d is not None and c and d == stated for d, c, stated in zip(digests, batch.column("complete").to_pylist(), batch.column("payload_digest").to_pylist(), strict=True)]
            sizes = pa.array([None if p is None else len(p) for p in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_id"), pa.array(got, pa.binary()), sizes, pa.array(digests, pa.string()), pa.array(ok, pa.bool_())], ["page_id", "record_id", "payload", "payload_bytes", "payload_digest", "ok"])

    return responses.mapInArrow(decode, "page_id long, record_id string, payload binary, payload_bytes long, payload_digest string, ok boolean")


_PAGES = "page_id long, record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, ok boolean"
_PARTS = [("origin", pa.string()), ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("ok", pa.bool_()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]


def read_pages(files: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each page of the archives, from one pass over them: (page_id, record_id, record_type, refers_to, payload_digest, payload_bytes, ok).

    Records that are whole are decoded where they are read, and of them no more than these fields goes on. Parts of segmented records meet by the identifier of their
    first segment and come in the order of their numbers, so a task holds the parts of one record at a time. ``refers_to`` is the record id that a revisit names; its size is null. ``ok``
    says that all segments were there, the framing was whole and the digest is the stated one (true for revisits); the digest is that of the payload, or the stated one where there
    is none. Segments without a first one give a row with a null page_id; records with an error (``strict=False``) give none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for k, (file, page_id, record_id, kind, _, refers_to, digest, number, origin, total, block, error) in enumerate(_records(batches, strict)):
            if error or kind not in ("response", "revisit", "continuation"):
                continue
            alone = f"{file}#{k}"
            if kind == "revisit":
                rows.append((alone, page_id, record_id, kind, refers_to, digest, None, True, None, None, None))
            elif kind == "response" and number is None:
                rows.append((alone, page_id, record_id, kind, None, *_checked(block, digest), None, None, None))
            else:
                rows.append((record_id if kind == "response" else origin, page_id, record_id if kind == "response" else None, kind, None, digest, None, None, number, total, block))
                held += len(block)
            if held > 4 << 20 or len(rows) > 10_000:
                yield _columns(rows)
                rows, held = [], 0
        if rows:
            yield _columns(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c, _ in _PARTS), strict=True):
                if parts and (row[0] != parts[0][0] or row[8] is None):
                    out.append(_joined(parts))
                    parts = []
                if row[8] is None:
                    out.append(row[1:8])
                else:
                    parts.append(row)
            if len(out) > 10_000:
                yield _pages(out)
                out = []
        if parts:
            out.append(_joined(parts))
        if out:
            yield _pages(out)

    schema = ", ".join(f"{c} {t}" for c, t in zip((c for c, _ in _PARTS), ("string", "long", "string", "string", "string", "string", "long", "boolean", "int", "long", "binary"), strict=True))
    met = files.select("file").mapInArrow(read, schema).repartition("origin").sortWithinPartitions("origin", "number")
    return met.mapInArrow(join, _PAGES)


def _checked(block: bytes, stated: str | None) -> tuple[str | None, int | None, bool]:
    """(digest, size, ok) of the payload of an HTTP message."""
    payload = http_payload(block)
    if payload is None:
        return stated, None, False
    digest = base32_sha1(payload)
    return digest, len(payload), digest == stated


def _joined(parts: list[tuple]) -> tuple:
    """The row of a segmented record, whose parts are in the order of their numbers."""
    first = parts[0] if parts[0][3] == "response" else None
    block = b"".join(p[-1] for p in parts)
    whole = first is not None and [p[8] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][9] == len(block)
    digest, size, ok = _checked(block, first[5] if first else None)
    return first[1] if first else None, parts[0][0], "response", None, digest, size, whole and ok


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PARTS, strict=True)], [c for c, _ in _PARTS])


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PARTS[1:8], strict=True)], [c for c, _ in _PARTS[1:8]])
