"""Media columns with signature sniffing.

Payloads are stored as binary columns in a media container together with the type that was
declared for them. Reading does not trust the declaration: an Aho-Corasick automaton finds
every magic number in the stored bytes, a validator for each format confirms structure and
lengths, the type that is valid at offset 0 corrects the declared one, and every other
confirmed file that lies within the bytes is carved out with its place.

Defined results: null and empty texts are stored as one unit of padding; an unknown or
damaged form sniffs as application/octet-stream and nothing is carved from damaged files;
media that are null or hold no whole stored payload have no payload columns (null) and are
digested as they are; repeated rows are stored each; equal inputs give equal values; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tempora.llm.common import stream, table, written

#: Payloads are padded with this byte to a positive multiple of this many bytes.
UNIT, FILL = 576, b"\xff"
#: Samples a second that the header of a stored payload declares.
SAMPLE_RATE = 8000
UNKNOWN = "application/octet-stream"
#: Bytes that are unpacked at a time.
PIECE = 4096


@dataclass(frozen=True)
class Found:
    offset: int
    length: int
    kind: str


def padded(data: bytes) -> bytes:
    return data + FILL * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """8-bit mono PCM samples in a RIFF container: one sample for each byte, nothing lost."""
    even = len(payload) + len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + even, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (even - len(payload))


def riff_chunks(data: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """(name, begin, length) of the chunks from `at` to `end`; empty if they don't tile it."""
    out = []
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > end:
            return []
        out.append((name, at + 8, n))
        at += 8 + n + n % 2
    return out if at in (end, end + 1) else []


def wav(data: bytes, at: int) -> int:
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    chunks = {name: (begin, n) for name, begin, n in riff_chunks(data, at + 12, end)}
    if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
        return 0
    _, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", data, chunks[b"fmt "][0])
    whole = channels and bits and align == channels * bits // 8 and speed == rate * align and chunks[b"data"][1] % align == 0
    return end - at if whole else 0


def png(data: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, i)
        if i + 12 + n > len(data) or first != (name == b"IHDR") or first and n != 13 or struct.unpack_from(">I", data, i + 8 + n)[0] != zlib.crc32(data[i + 4 : i + 8 + n]):
            return 0
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i - at
    return 0


def gif(data: bytes, at: int) -> int:
    if at + 13 > len(data) or data[at + 4 : at + 6] not in (b"7a", b"9a"):
        return 0
    flags, i = data[at + 10], at + 13
    i += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while i < len(data):
        mark = data[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 < len(data):
            local = data[i + 9]
            i += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return 0
        while i < len(data) and data[i]:
            i += data[i] + 1
        i += 1
    return 0


def jpeg(data: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(data) and data[i] == 0xFF:
        mark = data[i + 1]
        if mark == 0xD9:
            return 0  # no scan before the end
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1:
            return 0
        n = struct.unpack_from(">H", data, i + 2)[0]
        if n < 2:
            return 0
        i += 2 + n
        if mark == 0xDA:
            end = data.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def bmp(data: bytes, at: int) -> int:
    if at + 26 > len(data):
        return 0
    size, kept, begin, head = struct.unpack_from("<IIII", data, at + 2)
    return size if kept == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= begin <= size <= len(data) - at else 0


def gzipped(data: bytes, at: int) -> int:
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return 0
    unpack, i = zlib.decompressobj(31), at
    try:
        while i < len(data) and not unpack.eof:  # piece by piece: damaged data end it early, and what comes out isn't kept
            rest, i = data[i : i + PIECE], i + PIECE
            while rest and not unpack.eof:
                unpack.decompress(rest, 1 << 16)
                rest = unpack.unconsumed_tail
    except zlib.error:
        return 0
    return min(i, len(data)) - at - len(unpack.unused_data) if unpack.eof else 0


def places(data: bytes, mark: bytes) -> list[int]:
    """Where the mark stands; its callers look it up once for all files that a blob may hold."""
    out, at = [], data.find(mark)
    while at >= 0:
        out.append(at)
        at = data.find(mark, at + 1)
    return out


@lru_cache(maxsize=1)
def pdf_ends(data: bytes) -> tuple[list[int], list[int]]:
    return places(data, b"%%EOF"), places(data, b"startxref")


def pdf(data: bytes, at: int) -> int:
    ends, tables = pdf_ends(data)
    k, x = bisect_left(ends, at), bisect_left(tables, at)
    return ends[k] + 5 - at if k < len(ends) and x < len(tables) and tables[x] + 9 <= ends[k] else 0


@lru_cache(maxsize=1)
def archives(data: bytes) -> dict[int, int]:
    """Begin and end of what the end records of archives speak of: the first whole one for each begin."""
    out: dict[int, int] = {}
    for end in places(data, b"PK\x05\x06"):
        if end + 22 > len(data):
            continue
        size, begin, note = struct.unpack_from("<IIH", data, end + 12)
        at = end - begin - size
        if at >= 0 and end + 22 + note <= len(data) and (not size or data[at + begin : at + begin + 4] == b"PK\x01\x02"):
            out.setdefault(at, end + 22 + note)
    return out


def zipped(data: bytes, at: int) -> int:
    return archives(data).get(at, at) - at


def ogg(data: bytes, at: int) -> int:
    i, last = at, False
    while not last and data[i : i + 5] == b"OggS\0" and i + 27 <= len(data):
        table_end = i + 27 + data[i + 26]
        end = table_end + sum(data[i + 27 : table_end])
        if end > len(data):
            return 0
        last, i = bool(data[i + 5] & 4), end
    return i - at if last else 0


#: Magic numbers, the types they stand for and what confirms them (returns the length, 0: no).
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"RIFF", "audio/wav", wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF8", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gzipped),
    (b"%PDF-", "application/pdf", pdf),
    (b"PK\x03\x04", "application/zip", zipped),
    (b"OggS", "audio/ogg", ogg),
]

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            a.add_word(magic.decode("latin-1"), k)
        a.make_automaton()
        _automaton = a
    return _automaton


def sniff(data: bytes) -> list[Found]:
    """Every confirmed file in the bytes, by offset; those within a damaged one are found as well."""
    out = []
    for last, k in automaton().iter(data.decode("latin-1")):
        magic, kind, confirm = FORMATS[k]
        at = last - len(magic) + 1
        if n := confirm(data, at):
            out.append(Found(at, n, kind))
    return sorted(out, key=lambda f: (f.offset, -f.length))


def true_type(data: bytes) -> tuple[str, list[Found]]:
    """The confirmed type at offset 0, and the files embedded after it."""
    found = sniff(data)
    kind = next((f.kind for f in found if f.offset == 0), UNKNOWN)
    return kind, [f for f in found if f.offset]


def load(data: bytes) -> bytes:
    """The samples of a stored payload, from its bytes alone."""
    if not wav(data, 0):
        raise ValueError("not a whole stored payload")
    return next(data[begin : begin + n] for name, begin, n in riff_chunks(data, 12, len(data)) if name == b"data")


def media_column(rows: DataFrame, declared: str = "image/png") -> DataFrame:
    """doc_id, declared type and media (binary) of each row's text, stored as samples."""

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode("utf-8", "replace") for t in block.column(1).to_pylist()]
        media = [store(padded(t)) for t in texts]
        return pa.RecordBatch.from_arrays([block.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([declared] * len(texts), pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return stream(rows, ["doc_id", "text"], step, "doc_id long, n_bytes long, declared string, media binary")


def carve(rows: DataFrame) -> DataFrame:
    """(doc_id, corrected type, carved: offset, length, kind and bytes of each embedded file)."""

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        kinds, carved = [], []
        for data in block.column(1).to_pylist():
            kind, inner = true_type(data or b"")
            kinds.append(kind)
            carved.append([{"offset": f.offset, "length": f.length, "kind": f.kind, "bytes": (data or b"")[f.offset : f.offset + f.length]} for f in inner])
        one = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("bytes", pa.binary())])
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(kinds, pa.string()), pa.array(carved, pa.list_(one))], ["doc_id", "corrected", "carved"])

    return stream(rows, ["doc_id", "media"], step, "doc_id long, corrected string, carved array<struct<offset: long, length: long, kind: string, bytes: binary>>", text="media")


def read(payload: bytes) -> tuple[int, str, int]:
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: checksums of the samples and of the stored form, types and carved files."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for declared, held in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), strict=True):
            data = held or b""
            kind, inner = true_type(data)
            payload = load(data) if kind == "audio/wav" else None
            embedded = ",".join(f"{f.kind}@{f.offset}+{f.length}" for f in inner)
            for column, value in zip(out, (*(read(payload) if payload is not None else (None, None, None)), len(data), hashlib.sha256(data).hexdigest(), f"declared={declared};type={kind};corrected={str(kind != declared).lower()};embedded={embedded}"), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([block.column(0), block.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)

    return stream(media, ["doc_id", "n_bytes", "declared", "media"], step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", text="media")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder, and what it holds there is digested."""
    return digest(written(spark, media_column(table(spark, sf_dir, "documents")), "media", "zstd"))
