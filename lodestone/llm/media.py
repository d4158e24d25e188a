"""Media columns: type sniffing by signatures, checked by structure.

One Aho-Corasick automaton finds all magic bytes of a value in one scan; the
validator of each format then confirms structure and length at that place.
A value's true type is that of the format found valid at its start; valid
media further in are carved out as embedded.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, only, steps

# --- fixed values: magic bytes of each format, and the media types ---
MAGIC = {
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"P5\n": "image/x-portable-graymap",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
    b"OggS": "audio/ogg",
}
UNKNOWN = "application/octet-stream"
# --- end of fixed values ---

WIDTH = 64


class Value:
    """A value's bytes, with what several places of it ask for found once, so
    that many false magics cost no more than one scan of it."""

    def __init__(self, data: bytes):
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.blocks: dict[int, int] = {}
        self.pages: dict[int, int] = {}
        self.deflated: dict[int, int] = {}
        self.parts: dict[int, tuple[int, bool]] = {0: (0, False)}
        self.chunks: dict[int, tuple[int, int, int, int, int]] = {}

    @functools.cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)

    def after_zero(self, at: int) -> int:
        """The place after the first zero byte from ``at`` on; 0: none."""
        k = int(np.searchsorted(self.zeros, at))
        return int(self.zeros[k]) + 1 if k < len(self.zeros) else 0

    def after_deflated(self, at: int) -> int:
        """The place after deflated data and its check sums; 0: not valid."""
        if at not in self.deflated:
            self.deflated[at] = self._inflate(at)
        return self.deflated[at]

    def _inflate(self, at: int) -> int:
        d, crc, size = zlib.decompressobj(-15), 0, 0
        while not d.eof and at < len(self.data):
            chunk = self.data[at : at + 4096]
            at += len(chunk)
            while chunk and not d.eof:
                try:
                    out = d.decompress(chunk, 1 << 20)
                except zlib.error:
                    return 0
                crc, size, chunk = zlib.crc32(out, crc), size + len(out), d.unconsumed_tail
        at -= len(d.unused_data)
        return at + 8 if d.eof and self.data[at : at + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0

    def next_mark(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on; -1: none."""
        if mark not in self.marks:
            found, p = [], self.data.find(mark)
            while p >= 0:
                found.append(p)
                p = self.data.find(mark, p + 1)
            self.marks[mark] = found
        places = self.marks[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def follow(self, known: dict[int, int], at: int, step) -> int:
        """Where the chain of ``step`` (the next place, or minus one less than
        the result where it ends) leads from ``at``.  Chains that meet go on
        alike, so every place is passed once."""
        passed = []
        while at >= 0 and at not in known:
            passed.append(at)
            at = step(at)
        end = known[at] if at >= 0 else -1 - at
        known.update(dict.fromkeys(passed, end))
        return end

    def after_blocks(self, at: int) -> int:
        """The place after a GIF's chain of sub-blocks; 0: it does not end."""
        b = self.data
        return self.follow(self.blocks, at, lambda p: -1 if p >= len(b) else p + 1 + b[p] if b[p] else -1 - (p + 1))

    def after_pages(self, at: int) -> int:
        """The place after the last page of an Ogg stream; 0: it does not end."""
        b = self.data

        def step(p: int) -> int:
            if p + 27 > len(b) or b[p : p + 5] != b"OggS\0":
                return -1
            n = b[p + 26]
            end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
            return -1 if end > len(b) else -1 - end if b[p + 5] & 4 else end

        return self.follow(self.pages, at, step)

    def after_parts(self, at: int) -> tuple[int, bool]:
        """The place after a GIF's extensions and images, and whether there is
        an image; 0: they do not end.  Every part is passed once."""
        b, passed = self.data, []
        while at not in self.parts:
            mark = b[at] if at < len(b) else -1
            if mark == 0x3B:
                self.parts[at] = (at + 1, False)
                break
            image = mark == 0x2C and at + 10 <= len(b)
            passed.append((at, image))
            if image:
                at = self.after_blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0))
            else:
                at = self.after_blocks(at + 2) if mark == 0x21 else 0
        end, images = self.parts[at]
        for p, image in reversed(passed):
            images |= image
            self.parts[p] = (end, images)
        return end, images

    def chunk(self, at: int) -> tuple[int, int, int, int, int]:
        """Of the RIFF chunk at a place: the next chunk's place, a place some
        chunks on, the number of chunks from here on, and the places of the
        next format and data chunks.  Places past the end stand for none.

        Chains that meet go on alike, so every chunk is read once; the places
        further on are spaced so that a search takes logarithmic time."""
        b, chunks, passed, none = self.data, self.chunks, [], len(self.data) + 1
        p = at
        while p not in chunks:
            if p + 8 > len(b):
                chunks[p] = (none, none, 0, none, none)
                break
            n = struct.unpack_from("<I", b, p + 4)[0]
            after = min(p + 8 + n + n % 2, none)
            passed.append((p, after, b[p : p + 4] == b"fmt " and n >= 16, b[p : p + 4] == b"data"))
            p = after
        for p, after, fmt, data in reversed(passed):
            _, far, depth, next_fmt, next_data = chunks[after]
            _, further, far_depth, _, _ = chunks.get(far, (none, none, 0, none, none))
            further_depth = chunks[further][2] if further in chunks else 0
            jump = further if depth - far_depth == far_depth - further_depth else after
            chunks[p] = (after, jump, depth + 1, p if fmt else next_fmt, p if data else next_data)
        return chunks[at]

    def reaches(self, at: int, end: int) -> bool:
        """Whether the chain of chunks from ``at`` on has one that ends at ``end``."""
        while at < end:
            after, far, *_ = self.chunk(at)
            at = far if far <= end else after
        return at == end


def _wav(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or max(value.chunk(at + 12)[3:]) >= end:
        return 0
    return end - at if value.reaches(at + 12, end) else 0


def _bmp(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 54:
        return 0
    size, reserved, start, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header < 40 or width <= 0 or not height or at + size > len(b):
        return 0
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if packing or start + rows <= size else 0


def _pgm(b: bytes, at: int, value: Value) -> int:
    head = b[at : at + 64].split(b"\n", 3)
    try:
        width, height = map(int, head[1].split())
        if len(head) < 4 or int(head[2]) != 255 or width <= 0 or height <= 0:
            return 0
    except (ValueError, IndexError):
        return 0
    size = sum(map(len, head[:3])) + 3 + width * height
    return size if at + size <= len(b) else 0


def _png(b: bytes, at: int, value: Value) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 14:
        return 0
    end, images = value.after_parts(at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0))
    return end - at if images else 0


def _jpeg(b: bytes, at: int, value: Value) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 - at if frame else 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:  # coded data, up to a marker other than a stuffed byte or a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return 0
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return 0


def _zip(b: bytes, at: int, value: Value) -> int:
    end = value.next_mark(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b)
    return end + 22 + note - at if ok else 0


def _gzip(b: bytes, at: int, value: Value) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    p, flags = at + 10, b[at + 3]
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for bit in (8, 16):  # name and comment, each up to a zero byte
        if flags & bit and not (p := value.after_zero(p)):
            return 0
    return max(0, value.after_deflated(p + (flags & 2)) - at)


def _pdf(b: bytes, at: int, value: Value) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    mark = value.next_mark(b"startxref", at)
    end = value.next_mark(b"%%EOF", mark) if mark >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def _ogg(b: bytes, at: int, value: Value) -> int:
    return max(0, value.after_pages(at) - at)


VALIDATORS = {"audio/wav": _wav, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/zip": _zip, "application/gzip": _gzip, "application/pdf": _pdf, "audio/ogg": _ogg}


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all valid media in ``data``, in order.  Those
    that lie within one already found are left to it, except within a value
    that is itself one medium, whose content is searched as well."""
    found, end, value = [], 0, Value(data)
    for last, (kind, n) in _automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at >= end and (size := VALIDATORS[kind](data, at, value)):
            found.append((kind, at, size))
            if at or size < len(data):
                end = at + size
    return found


def sniff(rows: DataFrame, content: str, declared: str) -> DataFrame:
    """``rows`` with ``media_type`` (the type found at the start, of the whole
    value or of its beginning; else the declared one if no magic contradicts
    it), ``corrected`` and ``embedded`` (type, offset, length).

    A declared type that has a validator, which fails, becomes the unknown
    type.  Defined cases: null content has the declared type and nothing
    embedded; a null declared type counts as unknown; empty content is
    unknown; repeated rows give repeated results; an empty table gives no
    rows; columns of ``rows`` named as a result are replaced.
    """
    own = ("media_type", "corrected", "embedded")
    rows = rows.drop(*own)
    schema = f"{_ddl(rows)}, media_type string, corrected boolean, embedded array<struct<type: string, offset: long, length: long>>"
    item = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for batch in steps(batches, content):
            kinds, fixed, inner = [], [], []
            for data, said in zip(column(batch, content).to_pylist(), column(batch, declared).to_pylist(), strict=True):
                said = said or UNKNOWN
                found = find_media(data) if data else []
                kind = said if data is None else found[0][0] if found and found[0][1] == 0 else UNKNOWN if said in VALIDATORS else said
                kinds.append(kind)
                fixed.append(kind != said)
                inner.append([{"type": k, "offset": at, "length": n} for k, at, n in found if at or n < len(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(inner, item)], [*batch.schema.names, *own])

    return rows.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def store(payload: bytes, kind: str) -> bytes:
    """The payload, a positive multiple of 64 bytes, as 8-bit samples of ``kind``."""
    height = len(payload) // WIDTH
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "image/bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        start = 54 + len(grey)
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, WIDTH, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + payload
    if kind == "image/x-portable-graymap":
        return b"P5\n%d %d\n255\n" % (WIDTH, height) + payload
    if kind == "image/png":
        lines = np.zeros((height, WIDTH + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
        chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def samples(data: bytes, kind: str) -> bytes:
    """The samples of a medium that ``store`` can make, read by its structure."""
    if kind == "audio/wav":
        p = 12
        while data[p : p + 4] != b"data":
            n = struct.unpack_from("<I", data, p + 4)[0]
            p += 8 + n + n % 2
        return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]
    if kind == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", data, 10)
        return data[start : start + width * abs(height)]
    if kind == "image/x-portable-graymap":
        head = data[:64].split(b"\n", 3)
        width, height = map(int, head[1].split())
        start = sum(map(len, head[:3])) + 3
        return data[start : start + width * height]
    if kind == "image/png":
        width, height = struct.unpack_from(">II", data, 16)
        p, coded = 8, []
        while p < len(data):
            n, name = struct.unpack_from(">I4s", data, p)
            if name == b"IDAT":
                coded.append(data[p + 8 : p + 8 + n])
            p += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(coded)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()
    raise ValueError(kind)


STORED = ("audio/wav", "image/bmp", "image/x-portable-graymap", "image/png")


def store_texts(documents: DataFrame) -> DataFrame:
    """Every text's UTF-8 bytes, with zero bytes up to a positive multiple of
    64, as a medium: ``doc_id``, ``n_bytes``, ``media``, ``declared``.

    The payload's hash picks one of four formats; all are declared to be of
    the unknown type, so that readers have to sniff.  The media go on as a
    column, in Arrow batches, to whatever reads them.

    Defined cases: null and empty texts are 64 zero bytes, of length 0; equal
    texts have equal media; repeated rows give repeated results; an empty table
    gives no rows; a null ``doc_id`` stays null; columns other than ``doc_id``
    and ``text`` are ignored; a text of any length is one medium.
    """

    def run(batches):
        for batch in steps(batches):
            sizes, media = [], []
            for text in column(batch, "text").to_pylist():
                payload = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(payload))
                payload += b"\0" * (-len(payload) % WIDTH or (0 if payload else WIDTH))
                media.append(store(payload, STORED[zlib.crc32(payload) % len(STORED)]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(media))], ["doc_id", "n_bytes", "media", "declared"])

    return only(documents, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


def features(stored: DataFrame) -> DataFrame:
    """Reads the samples of each stored medium by its sniffed type and computes
    its features.

    ``feature``: type, number of samples, their sum, sum of squares, distinct
    values, sum of absolute steps, and the number and bytes of embedded media.

    Defined cases: as for ``store_texts``, whose rows these are; a medium that
    ``store`` cannot have made is an error.
    """
    sniffed = sniff(stored.select("doc_id", "n_bytes", "media", "declared"), "media", "declared")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"

    def run(batches):
        for batch in steps(batches, "media"):
            rows = []
            for doc_id, n, data, kind, fixed, inner in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_type", "corrected", "embedded")), strict=True):
                payload = samples(data, kind)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                values = np.arange(256)
                moved = int(np.abs(np.diff(np.frombuffer(payload, np.uint8).astype(np.int16))).sum())
                feature = f"{kind};samples={len(payload)};sum={int(counts @ values)};squares={int(counts @ values**2)};distinct={int((counts > 0).sum())};steps={moved};embedded={len(inner)}:{sum(x['length'] for x in inner)}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, fixed))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return sniffed.mapInArrow(run, schema)
