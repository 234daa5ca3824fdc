"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; a
validator for each format confirms structure and length at every hit. The format of the medium
that begins the value corrects the declared type; media inside, at any depth, are found with their extents: in the
samples that are read back, or in the bytes of other media as far as they are stored uncompressed.

Defined cases: a null value has no media; a null or wrong declared type is corrected by what is found;
bytes without valid media keep type "unknown"; empty tables give empty results; repeated rows
one row each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_pandas, pick, table

WIDTH = 576

#: Magic bytes of each format.
MAGIC = {
    "wav": b"RIFF",
    "png": b"\x89PNG\r\n\x1a\n",
    "bmp": b"BM",
    "pgm": b"P5",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
    "gzip": b"\x1f\x8b\x08",
    "zip": b"PK\x03\x04",
    "pdf": b"%PDF-",
}
STORED = ("wav", "png", "bmp", "pgm")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes, kind: str) -> bytes:
    """payload, a multiple of 576 bytes, as 8-bit samples of a sound or image."""
    rows = len(payload) // WIDTH
    if kind == "wav":
        pad = len(payload) % 2
        return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad
    if kind == "png":
        lines = np.zeros((rows, WIDTH + 1), np.uint8)  # a filter byte 0 before each row
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
        return MAGIC["png"] + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    if kind == "bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        at = 54 + len(palette)
        return b"BM" + struct.pack("<IHHI", at + len(payload), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    raise ValueError(kind)


def load(data: bytes, kind: str) -> bytes:
    """The samples of a valid medium of store()'s kinds."""
    if kind == "wav":
        at = 12
        while data[at : at + 4] != b"data":
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]
    if kind == "png":
        at, idat, width, rows = 8, [], *struct.unpack_from(">II", data, 16)
        while at + 12 <= len(data):
            n, name = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
            if name == b"IDAT":
                idat.append(data[at + 8 : at + 8 + n])
            at += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(rows, width + 1)
        if lines[:, 0].any():
            raise ValueError("filtered rows")
        return lines[:, 1:].tobytes()
    if kind == "bmp":
        at, width, rows = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<ii", data, 18)
        lines = np.frombuffer(data, np.uint8, abs(rows) * ((width + 3) // 4 * 4), at).reshape(abs(rows), -1)[:, :width]
        return (lines if rows < 0 else lines[::-1]).tobytes()
    if kind == "pgm":
        width, rows = map(int, data.split(None, 3)[1:3])
        return data[len(data) - width * rows :]
    raise ValueError(kind)


class Marks:
    """Where a mark stands next, for positions that only rise: the bytes are searched once for each mark."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, {}

    def after(self, mark: bytes, at: int, end: int) -> int:
        """The first place of the mark in data[at:end], or -1."""
        found = self.at.get(mark, 0)
        if 0 <= found < at or mark not in self.at:
            found = self.at[mark] = self.data.find(mark, at)
        return found if 0 <= found <= end - len(mark) else -1


# Validators: the length of the medium at data[at:], none of it at `end` or beyond, or 0.


def _wav(d: bytes, at: int, end: int, marks: Marks) -> int:
    if d[at + 8 : at + 12] != b"WAVE" or end < at + 20:
        return 0
    last, pos, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, set()
    while last <= end and pos + 8 <= last:
        seen.add(d[pos : pos + 4])
        n = struct.unpack_from("<I", d, pos + 4)[0]
        pos += 8 + n + n % 2
    return last - at if last <= end and pos == last and {b"fmt ", b"data"} <= seen else 0


def _png(d: bytes, at: int, end: int, marks: Marks) -> int:
    pos, first = at + 8, True
    while pos + 12 <= end:
        n, name = struct.unpack_from(">I", d, pos)[0], d[pos + 4 : pos + 8]
        if first != (name == b"IHDR") or pos + 12 + n > end or zlib.crc32(memoryview(d)[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", d, pos + 8 + n)[0]:
            return 0
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return pos - at
    return 0


def _bmp(d: bytes, at: int, end: int, marks: Marks) -> int:
    if end < at + 54:
        return 0
    size, zero, start, header, width, rows, planes, bits = *struct.unpack_from("<III", d, at + 2), *struct.unpack_from("<IiiHH", d, at + 14)
    if zero or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or rows == 0 or start < 14 + header:
        return 0
    compression = struct.unpack_from("<I", d, at + 30)[0]
    body = (width * bits + 31) // 32 * 4 * abs(rows)
    return size if at + size <= end and (compression or start + body == size) else 0


def _pgm(d: bytes, at: int, end: int, marks: Marks) -> int:
    fields, pos = [], at + 2
    for _ in range(3):
        begin = pos
        while pos < end and d[pos] in b" \t\r\n" and pos - begin < 8:
            pos += 1
        digits = pos
        while pos < end and 48 <= d[pos] <= 57 and pos - digits < 10:
            pos += 1
        if begin == digits or digits == pos:
            return 0
        fields.append(int(d[digits:pos]))
    width, rows, most = fields
    last = pos + 1 + width * rows * (1 + (most > 255))
    return last - at if 0 < most < 65536 and width * rows and pos < end and d[pos] in b" \t\r\n" and last <= end else 0


def _gif(d: bytes, at: int, end: int, marks: Marks) -> int:
    if d[at + 4 : at + 6] not in (b"7a", b"9a") or end < at + 13:
        return 0
    table = lambda flags: 3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0
    pos = at + 13 + table(d[at + 10])
    while pos < end:
        kind = d[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x2C and pos + 10 < end:
            pos += 11 + table(d[pos + 9])
        elif kind == 0x21:
            pos += 2
        else:
            return 0
        while pos < end and d[pos]:
            pos += 1 + d[pos]
        pos += 1
    return 0


def _jpeg(d: bytes, at: int, end: int, marks: Marks) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= end and d[pos] == 0xFF:
        kind = d[pos + 1]
        n = struct.unpack_from(">H", d, pos + 2)[0]
        if kind < 0xC0 or n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xC2
        pos += 2 + n
        if kind == 0xDA:  # entropy-coded bytes up to a marker that isn't stuffing or a restart
            while (pos := d.find(b"\xff", pos, end)) >= 0 and pos + 1 < end and (d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= end:
                return 0
            if d[pos + 1] == 0xD9:
                return pos + 2 - at if frame else 0
    return 0


def _gzip(d: bytes, at: int, end: int, marks: Marks) -> int:
    z, pos, part, view = zlib.decompressobj(31), at, 65536, memoryview(d)
    try:
        while pos < end and not z.eof:
            z.decompress(view[pos : min(pos + part, end)], part)
            pos = min(pos + part, end)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, part)
    except zlib.error:
        return 0
    return pos - len(z.unused_data) - at if z.eof else 0


def _zip(d: bytes, at: int, end: int, marks: Marks) -> int:
    mark = marks.after(b"PK\x05\x06", at, end)
    if mark < 0 or mark + 22 > end:
        return 0
    size, offset, note = struct.unpack_from("<IIH", d, mark + 12)
    return mark + 22 + note - at if at + offset + size == mark and mark + 22 + note <= end else 0


def _pdf(d: bytes, at: int, end: int, marks: Marks) -> int:
    mark = marks.after(b"%%EOF", at, end)
    return mark + 5 - at if mark >= 0 and marks.after(b"startxref", at, mark) >= 0 else 0


VALID = {"wav": _wav, "png": _png, "bmp": _bmp, "pgm": _pgm, "gif": _gif, "jpeg": _jpeg, "gzip": _gzip, "zip": _zip, "pdf": _pdf}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def _found(data: bytes | None, nested: bool) -> list[tuple[str, int, int]]:
    """One pass of the automaton: a hit is looked at within the innermost medium that is still open there; unless nested, only outside all."""
    data = data or b""
    out, open_, marks = [], [len(data)], Marks(data)  # the ends of the open media, the innermost last
    for last, (kind, n) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        while len(open_) > 1 and open_[-1] <= at:
            open_.pop()
        if (nested or len(open_) == 1) and (length := VALID[kind](data, at, open_[-1], marks)):
            out.append((kind, at, length))
            open_.append(at + length)
    return out


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of every valid medium, outermost: what lies inside a found one isn't looked at again."""
    return _found(data, False)


def within(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of every valid medium and of what lies in its bytes, at any depth, by offset."""
    return _found(data, True)


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch.pop("text"):
            raw = (text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))
            kind = STORED[zlib.crc32(payload) % len(STORED)]
            rows.append((len(raw), f"{'image' if len(raw) % 2 else 'audio'}/{STORED[len(raw) % len(STORED)]}", store(payload, kind)))
        yield batch.assign(**{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("n_bytes", "int64"), ("declared", object), ("media", object)))})


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: each text as the samples of a medium, under a type that may be wrong. All follow from the text."""
    return map_pandas(pick(docs, "doc_id", "text"), _store, "doc_id long, n_bytes long, declared string, media binary", "doc_id")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for declared, data in zip(batch.pop("declared"), batch.pop("media"), strict=True):
            found = sniff(data)
            kind = found[0][0] if found and found[0][1] == 0 else "unknown"
            payload = load(data[: found[0][2]], kind) if kind in STORED else b""
            # the samples of the first medium are looked at as they are read, the bytes of others as they stand
            raw = found[kind in STORED :]
            deeper = [(k, o + 1 + at, n) for _, o, size in raw for k, at, n in within(data[o + 1 : o + size])]
            rows.append(
                {
                    "declared": declared,
                    "kind": kind,
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(data or b""),
                    "media_sha256": hashlib.sha256(data or b"").hexdigest(),
                    "found": [{"kind": k, "offset": o, "length": n} for k, o, n in sorted(found + deeper, key=lambda x: (x[1], -x[2]))],
                    "inside": [{"kind": k, "offset": o, "length": n} for k, o, n in within(payload)],
                }
            )
        columns = ["declared", "kind", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "found", "inside"]
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)


def sniffed(media: DataFrame, *keys: str) -> DataFrame:
    """Of a table (keys, declared, media): the corrected kind, digests of the stored and read bytes, what was found in the stored ones, and what lies inside the read ones."""
    kept = "".join(f"`{k}` {dict(media.dtypes)[k]}, " for k in keys)
    return map_pandas(
        pick(media, *keys, "declared", "media"),
        _read,
        f"{kept}declared string, kind string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, found array<struct<kind:string,offset:long,length:long>>, inside array<struct<kind:string,offset:long,length:long>>",
        *[k for k in keys if dict(media.dtypes)[k] == "bigint"],
    )


def _carve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, k, o, data[o : o + n]) for key, data in zip(batch.iloc[:, 0], batch["media"], strict=True) for k, o, n in sniff(data)]
        yield pd.DataFrame(rows, columns=[batch.columns[0], "kind", "offset", "carved"])


def carved(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The found media themselves: key, kind, offset, carved."""
    kind = dict(media.dtypes)[key]
    return map_pandas(pick(media, key, "media"), _carve, f"`{key}` {kind}, kind string, offset long, carved binary", *[key] * (kind == "bigint"))


def op7_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: declared>kind, each medium as kind@offset+length, and those inside the samples after payload/."""
    stored = stored_texts(table(spark, sf_dir, "documents"))
    read = sniffed(stored, "doc_id", "n_bytes")
    listed = lambda media, place: F.transform(media, lambda f: F.concat_ws("", F.lit(place), f["kind"], F.lit("@"), f["offset"].cast("string"), F.lit("+"), f["length"].cast("string")))
    feature = F.concat_ws(
        ";",
        F.concat_ws(">", "declared", "kind"),
        F.array_join(F.concat(listed("found", ""), listed("inside", "payload/")), ";"),
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "kind")
