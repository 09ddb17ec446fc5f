"""Secret scans that confirm what they find by its structure.

Three kinds are told by their looks (assignments, access key ids, long hex strings). Others are reported only when what they encode is whole: base64 and hex candidates are
decoded, the nested lengths of a key encoding (DER or the OpenSSH container) must add up to exactly the bytes that are there and its fields be those of a
private key, and a token's header and payload must be JSON with a signing algorithm. Certificates, public keys, pictures and random strings fail that.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradeloom.llm.textops import chunks

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")
SPAN = "array<struct<kind:string,start:long,end:long,detail:string>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# maximal runs, so one that is too short holds none that is long enough
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_LINE_END = r"(?:\r?\n|\\r\\n|\\n)"
_B64 = "A-Za-z0-9+/"
#: Base64 of a DER sequence or of the OpenSSH container, at the head of a run or of a line of a quoted file. Broken lines have 32 characters or more.
_BASE64 = re.compile(rf"(?:(?<![{_B64}_-])|(?<=\\n))(?=M[{_B64}]|b3BlbnNzaC1rZXktdjEA)[{_B64}]++(?:(?<=[{_B64}]{{32}}){_LINE_END}[{_B64}]++)*+={{0,2}}(?![{_B64}=_-])")
_URL_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M[A-Za-z0-9_-]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9_-]{48,}+(?![A-Za-z0-9+/=_-])")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])(?:(?=30)|(?=6[fF]70656[eE]7373682[dD]))(?:[0-9a-fA-F]{2}){32,}+(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.+/-])(e[wy][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)((?:\.[A-Za-z0-9_-]++){2})?(?![A-Za-z0-9_.-])")
_BREAKS = re.compile(_LINE_END)

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``data`` exactly; None if a length is broken, longer than what is left, or not the shortest form."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + k])
            at += k
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _private_fields(items: list[tuple[int, bytes]]) -> str | None:
    tags = [t for t, _ in items]
    if tags[:2] == [_SEQUENCE, _OCTETS] and len(tags) == 2:
        # an encrypted key: the scheme is of the password-based families
        scheme = der_items(items[0][1])
        wrapped = scheme and scheme[0][0] == _OID and scheme[0][1].startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")))
        return "encrypted" if wrapped and items[1][1] else None
    if not tags or tags[0] != _INTEGER or len(items[0][1]) != 1 or items[0][1][0] > 1:
        return None
    version, rest = items[0][1][0], items[1:]
    numbers = [int.from_bytes(v) for t, v in rest if t == _INTEGER]
    if tags[1:3] == [_SEQUENCE, _OCTETS] and all(t & 0xC0 == 0x80 for t in tags[3:]):
        algorithm = der_items(rest[0][1])
        return "pkcs8" if algorithm and algorithm[0][0] == _OID and algorithm[0][1] and rest[1][1] else None
    if tags[1:] == [_INTEGER] * 8 or version == 1 and tags[1:] == [_INTEGER] * 8 + [_SEQUENCE]:
        # two-prime keys must have their modulus from their primes
        return "rsa" if numbers[0] and (version == 1 or numbers[0] == numbers[3] * numbers[4]) else None
    if version == 0 and tags[1:] == [_INTEGER] * 5:
        p, q, g, y, x = numbers
        return "dsa" if q and (p - 1) % q == 0 and p.bit_length() >= 512 else None
    if version == 1 and tags[1:2] == [_OCTETS] and len(rest[0][1]) >= 16 and len(rest) > 1 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec"
    return None


def der_key(data: bytes) -> str | None:
    """What kind of private key ``data`` encodes, if it is one whole DER sequence with the fields of one."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return None
    items = der_items(outer[0][1])
    return _private_fields(items) if items else None


def _strings(data: bytes, n: int) -> tuple[list[bytes], int] | None:
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def ssh_key(data: bytes) -> str | None:
    """The cipher of an OpenSSH private key whose nested lengths add up."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    rest = data[len(magic) :]
    head = _strings(rest, 3)
    if head is None or len(rest) < head[1] + 4:
        return None
    n = int.from_bytes(rest[head[1] : head[1] + 4])
    tail = _strings(rest[head[1] + 4 :], n + 1) if 1 <= n <= 16 else None
    if tail is None or head[1] + 4 + tail[1] != len(rest):
        return None
    secret = tail[0][-1]
    # without a password the two check numbers at the head of the secret part are equal
    whole = len(secret) % 8 == 0 and len(secret) >= 8 and (head[0][0] != b"none" or secret[:4] == secret[4:8])
    return head[0][0].decode("ascii", "replace") if whole else None


def _from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _json(text: str) -> object:
    raw = _from_base64(text)
    try:
        return json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None


def token_header(match: re.Match) -> str | None:
    """The algorithm of a signed or encrypted token: its header must be JSON with one, and a signed payload a JSON object."""
    header = _json(match[1])
    if not isinstance(header, dict) or not isinstance(alg := header.get("alg"), str) or not alg or alg.lower() == "none":
        return None
    if match[4]:
        return alg if isinstance(header.get("enc"), str) else None
    return alg if match[3] and isinstance(_json(match[2]), dict) else None


def _cut(text: str) -> str:
    """Broken lines as far as the length at the head of a key says, where a line ends there; else all of them."""
    parts = _BREAKS.split(text)
    head = _from_base64(parts[0][:8]) or b""
    if len(parts) == 1 or head[:1] != b"\x30" or len(head) < 6:
        return text
    size = 2 + head[1] if head[1] < 0x80 else 2 + (k := head[1] & 0x7F) + int.from_bytes(head[2 : 2 + k])
    held = at = 0
    for part, end in zip(parts, [*_BREAKS.finditer(text), None], strict=True):
        held, at = held + len(part), end.start() if end else len(text)
        if held >= -(-size * 4 // 3):
            return text[:at] if held == -(-size * 4 // 3) else text
    return text


def confirmed(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of the candidates whose structure is whole."""
    taken = set()
    for pattern, cut, decode in ((_BASE64, _cut, lambda x: _from_base64(_BREAKS.sub("", x))), (_URL_BASE64, str, _from_base64), (_HEX_KEY, str, bytes.fromhex)):
        for m in pattern.finditer(text):
            held = cut(m[0])
            span = m.start(), m.start() + len(held)
            data = decode(held) if span not in taken else None
            for kind, parse in (("der_key", der_key), ("ssh_key", ssh_key)):
                if data and (found := parse(data)):
                    taken.add(span)
                    yield kind, *span, found
    for m in _TOKEN.finditer(text):
        if found := token_header(m):
            yield "signed_token", *m.span(), found


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """All spans of a text, by start and kind; places are code points, ends exclusive."""
    found = [("assign", *m.span(), m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span(), "") for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), "") for m in _HEX.finditer(text)]
    found += confirmed(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end, detail) of every span in the whole text, by start and kind.

    ``assign`` (detail: the name in lower case), ``access`` and ``hex`` are told by their looks, leftmost and not overlapping in each kind; ``der_key`` (pkcs8, rsa, dsa, ec or encrypted),
    ``ssh_key`` (its cipher) and ``signed_token`` (its algorithm) by their structure. A key's span is its encoded part with the line ends in it. Null and empty texts
    have none; repeated rows are scanned each; a column named ``secrets`` is replaced; an empty table stays empty.
    """
    docs = docs.drop("secrets")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))
    names = ("kind", "start", "end", "detail")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = [[dict(zip(names, s, strict=True)) for s in spans(t or "")] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "secrets"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("secrets", T._parse_datatype_string(SPAN))]))
