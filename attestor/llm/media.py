"""Media columns: texts as 8-bit audio, and signature sniffing.

Aho-Corasick finds the magic bytes of all formats in one pass; a validator for
each format then walks its structure and gives its length, or rejects the place;
what it looks for at the end of a file is found once for a payload (`seen`).
What stands at offset 0 corrects the declared type; what stands elsewhere, and
outside of what was already carved, is embedded media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, scratch, slices, table, text_parts

RATE = 8000


def wav(payload: bytes) -> bytes:
    """Mono audio of 8-bit samples, one for each byte of payload, which has an even length."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def _riff(b: bytes, at: int, seen: dict) -> int | None:
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    seen, x = set(), at + 12
    while x + 8 <= end:
        seen.add(b[x : x + 4])
        n = int.from_bytes(b[x + 4 : x + 8], "little")
        x += 8 + n + n % 2
    return end - at if x == end and {b"fmt ", b"data"} <= seen else None


def _png(b: bytes, at: int, seen: dict) -> int | None:
    x, first = at + 8, True
    while x + 12 <= len(b):
        n, kind = int.from_bytes(b[x : x + 4], "big"), b[x + 4 : x + 8]
        if x + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13 or zlib.crc32(b[x + 4 : x + 8 + n]) != int.from_bytes(b[x + 8 + n : x + 12 + n], "big"):
            return None
        x, first = x + 12 + n, False
        if kind == b"IEND":
            return x - at
    return None


def _gif(b: bytes, at: int, seen: dict) -> int | None:
    if len(b) - at < 13:
        return None
    flags = b[at + 10]
    x = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(x: int) -> int:
        while x < len(b) and b[x]:
            x += 1 + b[x]
        return x + 1

    while x < len(b):
        if b[x] == 0x3B:
            return x + 1 - at
        if b[x] == 0x21:
            x = blocks(x + 2)
        elif b[x] == 0x2C and x + 10 <= len(b):
            local = b[x + 9]
            x = blocks(x + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, seen: dict) -> int | None:
    x, frame = at + 2, False
    while x + 4 <= len(b) and b[x] == 0xFF:
        kind = b[x + 1]
        if kind in (0x01, 0xD8) or 0xD0 <= kind <= 0xD7:
            return None
        n = int.from_bytes(b[x + 2 : x + 4], "big")
        if n < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        x += 2 + n
        if kind == 0xDA:
            while True:
                x = b.find(b"\xff", x)
                if x < 0 or x + 1 >= len(b):
                    return None
                if b[x + 1] == 0xD9:
                    return x + 2 - at if frame else None
                if b[x + 1] == 0 or 0xD0 <= b[x + 1] <= 0xD7:
                    x += 2
                    continue
                break
    return None


def _bmp(b: bytes, at: int, seen: dict) -> int | None:
    if len(b) - at < 30:
        return None
    size, pixels, header, width, height, planes, depth = struct.unpack_from("<I4xIIiiHH", b, at + 2)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    return size if at + size <= len(b) and 14 + header <= pixels and pixels + (width * depth + 31) // 32 * 4 * abs(height) <= size else None


def _gzip(b: bytes, at: int, seen: dict) -> int | None:
    inflate = zlib.decompressobj(31)
    try:
        for x in range(at, len(b), 1 << 16):
            piece = b[x : x + (1 << 16)]
            while piece and not inflate.eof:  # output in bounded pieces
                inflate.decompress(piece, 1 << 20)
                piece = inflate.unconsumed_tail
            if inflate.eof:
                return x + min(1 << 16, len(b) - x) - len(inflate.unused_data) - at
    except zlib.error:
        return None
    return None


def _pdf(b: bytes, at: int, seen: dict) -> int | None:
    """Up to the last end mark before the next header: updates that were appended belong to the file."""
    if "pdf" not in seen:
        seen["pdf"] = [m.end() for m in PDF_END.finditer(b)], [m.start() for m in PDF_HEAD.finditer(b)]
    ends, heads = seen["pdf"]
    i = bisect_right(heads, at)
    last = bisect_right(ends, heads[i] if i < len(heads) else len(b)) - 1
    return ends[last] - at if last >= 0 and ends[last] > at else None


def _zip(b: bytes, at: int, seen: dict) -> int | None:
    """Up to the end record whose sizes lead back to this place."""
    if "zip" not in seen:
        found = seen["zip"] = {}
        x = b.find(b"PK\x05\x06")
        while x >= 0 and x + 22 <= len(b):
            size, offset, comment = struct.unpack_from("<IIH", b, x + 12)
            start = x - offset - size
            if start >= 0 and b[start + offset : start + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") and x + 22 + comment <= len(b):
                found.setdefault(start, x + 22 + comment)
            x = b.find(b"PK\x05\x06", x + 1)
    end = seen["zip"].get(at)
    return end - at if end is not None else None


PDF_HEAD, PDF_END = re.compile(rb"%PDF-"), re.compile(rb"startxref\s+\d+\s+%%EOF")
FORMATS = {
    b"RIFF": ("audio/wav", _riff),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic in FORMATS:
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def parts(self, data: bytes) -> list[tuple[int, int, str]]:
        """(offset, length, type) of validated media: first what begins at 0, then in order what neither lies in a part carved before nor begins at 0."""
        out, free, seen = [], 0, {}
        for end, magic in self.automaton.iter(data.decode("latin-1")):
            at = end + 1 - len(magic)
            if at and at < free:
                continue
            kind, length_of = FORMATS[magic]
            if (n := length_of(data, at, seen)) is not None and n > 0:
                out.append((at, n, kind))
                free = max(free, at + n) if at else 0
        return out

    def sniff(self, data: bytes, declared: str | None) -> tuple[str, list[tuple[int, int, str]]]:
        """The corrected type (the declared one, or application/octet-stream, where nothing is recognised) and embedded parts."""
        found = self.parts(data)
        kind = next((k for at, _, k in found if at == 0), declared or "application/octet-stream")
        return kind, [x for x in found if x[0]]


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, n_bytes, declared, media): each text's UTF-8, padded with zeros to a positive multiple of 64, as audio.  Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_parts(batch):
                raw = [t.as_buffer().to_pybytes() for t in texts]
                media = [wav(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in raw]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    in_batches(rows, run, "doc_id long, n_bytes long, declared string, media binary").write.option("compression", "zstd").parquet(path)


def sniffed(media: DataFrame) -> DataFrame:
    """media (any columns, with declared and media) with kind, the corrected type, and embedded, an array of (offset, length, kind).  Null media is empty."""
    schema = media.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        part = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [sniffer.sniff(m.as_buffer().to_pybytes() if m.is_valid else b"", d.as_py()) for m, d in zip(batch.column("media"), batch.column("declared"), strict=True)]
            parts = [[{"offset": a, "length": n, "kind": k} for a, n, k in p] for _, p in found]
            yield pa.record_batch([*batch.columns, pa.array([k for k, _ in found]), pa.array(parts, part)], names=[*batch.schema.names, "kind", "embedded"])

    return in_batches(media, run, f"{schema}, kind string, embedded array<struct<offset:bigint,length:bigint,kind:string>>")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sniffer = Sniffer()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        media = batch.column("media")
        sizes = np.fromiter((len(m.as_buffer()) for m in media), np.int64, len(media))
        for a, b in slices(sizes, 8 << 20):
            out = []
            for m, declared in zip(media.slice(a, b - a), batch.column("declared").slice(a, b - a), strict=True):
                data = m.as_buffer().to_pybytes()
                kind, parts = sniffer.sniff(data, declared.as_py())
                payload = data[44 : 44 + int.from_bytes(data[40:44], "little")]
                samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                embedded = ",".join(f"{k}@{at}+{n}" for at, n, k in parts)
                feature = f"{kind};energy={int((samples * samples).sum())};crossings={int((np.diff(np.sign(samples)) != 0).sum())};embedded={embedded}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = [list(x) for x in zip(*out, strict=True)]
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5])], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents."""
    path = scratch(spark, "media")
    store(table(spark, sf_dir, "documents"), path)
    rows = spark.read.schema("doc_id long, n_bytes long, declared string, media binary").parquet(path)
    return in_batches(rows, _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
