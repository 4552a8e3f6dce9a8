"""Media columns: signature sniffing over byte columns, and texts stored as lossless images.

``sniff`` finds every known magic with one Aho-Corasick pass, then a validator for each format confirms
structure and length from the bytes themselves. What validates gives the true type (whatever was declared)
and its exact extent, so embedded media can be carved out of any host bytes.

The stored form of a payload is a 24-bit bitmap, 64 pixels (192 bytes) wide, so every byte is one 8-bit
sample and the padded payload is a whole number of rows. Reading back goes the same way as for foreign
bytes: sniff, validate, carve, then take the samples.

Everything is row-local: one narrow Arrow pass without shuffle, memory bounded by a slice of a batch plus
the largest single value.

Defined cases: null and empty texts are one row of padding; unknown bytes sniff as
``application/octet-stream`` with no part; equal bytes give equal values; columns of the input other than
id and text are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gistra.llm.text import column, slices, utf8

ROW, PAD = 192, b" "
UNKNOWN = "application/octet-stream"


class Part(NamedTuple):
    start: int
    end: int
    kind: str


def _bmp(b: memoryview, i: int) -> int | None:
    """End of a bitmap that begins at i, if its header is sound and the bytes are there."""
    if len(b) < i + 54:
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, i + 2)
    if zero or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    need = offset + (width * bits + 31) // 32 * 4 * abs(height)
    return i + size if offset >= 14 + header and need <= size <= len(b) - i else None


def _png(b: memoryview, i: int) -> int | None:
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if first and kind != b"IHDR" or at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def _gif(b: memoryview, i: int) -> int | None:
    def blocks(at):
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    if len(b) < i + 14:
        return None
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: memoryview, i: int) -> int | None:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        if b[at + 1] == 0xD9:
            return at + 2
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        scan, at = b[at + 1] == 0xDA, at + 2 + n
        while scan and at + 1 < len(b) and not (b[at] == 0xFF and b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7):
            at += 1
    return at + 2 if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] == 0xD9 else None


def _riff(form: bytes) -> Callable[[memoryview, int], int | None]:
    def end(b: memoryview, i: int) -> int | None:
        if len(b) < i + 12 or bytes(b[i + 8 : i + 12]) != form:
            return None
        stop = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
        at = i + 12
        while at + 8 <= stop <= len(b):
            at += 8 + (n := struct.unpack_from("<I", b, at + 4)[0]) + n % 2
        return stop if stop <= len(b) and at in (stop, stop + 1) and stop > i + 12 else None

    return end


#: Magic bytes, media type and validator of each format.
FORMATS = [
    (b"BM", "image/bmp", _bmp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, _, _ in FORMATS):
        a.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
    a.make_automaton()
    return a


def sniff(data: bytes, found: ahocorasick.Automaton) -> list[Part]:
    """The validated media in ``data``, outermost only, in order."""
    view, parts, past = memoryview(data), [], 0
    hits = sorted((at - n + 1, formats) for at, (n, formats) in found.iter(data.decode("latin-1"))) if data else []
    for at, formats in hits:
        if at < past:
            continue
        for kind, check in formats:
            if end := check(view, at):
                parts.append(Part(at, end, kind))
                past = end
                break
    return parts


def correct(data: bytes, declared: str, found: ahocorasick.Automaton) -> tuple[str, list[Part]]:
    """The true type of ``data`` and what else it embeds; the declared type only stands if bytes can't tell."""
    parts = sniff(data, found)
    if parts and parts[0].start == 0:
        return parts[0].kind, parts[1:]
    known = {kind for _, kind, _ in FORMATS}
    return (UNKNOWN if declared in known else declared), parts


def padded(payload: bytes) -> bytes:
    return payload + PAD * (-len(payload) % ROW if payload else ROW)


def store(samples: bytes) -> bytes:
    """A bitmap whose sample bytes are ``samples`` (rows from the top, so in their own order)."""
    rows = len(samples) // ROW
    header = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(samples), 0, 54, 40, ROW // 3, -rows, 1, 24, 0, len(samples), 2835, 2835, 0, 0)
    return header + samples


def read_back(media: bytes, found: ahocorasick.Automaton) -> tuple[bytes, str, list[Part]]:
    """(samples, feature, embedded parts) of stored bytes, from what sniffing says they are."""
    kind, _ = correct(media, UNKNOWN, found)
    if kind != "image/bmp":
        raise ValueError(f"stored bytes are {kind}")
    offset, width, height = struct.unpack_from("<I", media, 10)[0], *struct.unpack_from("<ii", media, 18)
    samples = media[offset : offset + width * 3 * abs(height)]
    inside = sniff(samples, found)
    carved = ",".join(f"{p.kind}@{p.start}-{p.end}" for p in inside)
    return samples, f"{kind};{width}x{abs(height)}x24;adler={zlib.adler32(samples):08x};parts={len(inside)}" + (f";{carved}" if carved else ""), inside


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Texts stored as bitmaps and read back: id, digests, feature and (``keep_media``) the stored bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches):
        found = automaton()
        for batch in batches:
            for part in slices(batch, text_col):
                rows = []
                for text in utf8(part, text_col):
                    media = store(padded(text))
                    back, feature, _ = read_back(media, found)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + keep_media]
                yield pa.RecordBatch.from_arrays([column(part, id_col), *[pa.array([r[i] for r in rows]) for i in range(len(names))]], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
