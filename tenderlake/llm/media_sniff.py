"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass. At each place that it names, the format's
validator reads the structure there (chunk sizes, headers, check sums, trailers) and either confirms a medium with its exact length or
rejects the place. The medium confirmed at offset 0 corrects the declared type; confirmed media further inside, those not
within another confirmed one, are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import arrow_fields, map_batches, text_of
from tenderlake.sources.tables import load_table, materialize

#: Magic bytes and media types, as the formats' public specifications give them.
MAGIC = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "png"),
    (b"GIF87a", "gif"),
    (b"GIF89a", "gif"),
    (b"\xff\xd8\xff", "jpeg"),
    (b"BM", "bmp"),
    (b"%PDF-", "pdf"),
    (b"PK\x03\x04", "zip"),
    (b"\x1f\x8b\x08", "gzip"),
    (b"fLaC", "flac"),
    (b"OggS", "ogg"),
)
BLOCK = 64
#: Of check sums from the start of the bytes.
STRIDE = 4096
WAV_HEAD = 44


class Chain:
    """Lists that are linked through the bytes (chunks, pages, blocks): each place is looked at once, however many heads lead to it.

    ``step(place)`` gives the next place, which is larger, and None, or None and the result of a list that ends there. A place remembers the next one, a far one
    and the result, so any place of its list is found in a logarithm of steps.
    """

    def __init__(self, step: Callable[[int], tuple[int | None, object]]) -> None:
        self.step = step
        self.next: dict[int, int] = {}
        self.far: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.result: dict[int, object] = {}

    def end(self, place: int) -> object:
        """The result of the list from ``place`` on."""
        way, p = [], place
        while p not in self.result:
            q, result = self.step(p)
            if q is None:
                self.next[p] = self.far[p] = p
                self.depth[p], self.result[p] = 0, result
                break
            way.append((p, q))
            p = q
        for p, q in reversed(way):
            self.next[p], self.depth[p], self.result[p] = q, self.depth[q] + 1, self.result[q]
            far = self.far[q]
            self.far[p] = self.far[far] if self.depth[q] - self.depth[far] == self.depth[far] - self.depth[self.far[far]] else q
        return self.result[place]

    def upto(self, place: int, target: int) -> int:
        """The first place of the list from ``place`` on that isn't before ``target``, or the list's last."""
        self.end(place)
        while place < target and self.next[place] != place:
            place = self.far[place] if self.far[place] <= target else self.next[place]
        return place


class Marks:
    """What validators find out about the bytes once, for all heads: places of marks, linked lists, check sums."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.chains: dict[str, Chain] = {}
        self.sums: list[int] = []

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, -1 if there is none."""
        if mark not in self.places:
            found, p = [], self.data.find(mark)
            while p >= 0:
                found.append(p)
                p = self.data.find(mark, p + 1)
            self.places[mark] = found
        places = self.places[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def chain(self, name: str, step: Callable[[bytes, int], tuple[int | None, object]]) -> Chain:
        if name not in self.chains:
            self.chains[name] = Chain(lambda p: step(self.data, p))
        return self.chains[name]

    def crc32(self, low: int, high: int) -> int:
        """Of the bytes from ``low`` to ``high``; a long stretch from sums that are kept for every ``STRIDE`` bytes from the start."""
        if high - low <= STRIDE:
            return zlib.crc32(self.data[low:high])
        if not self.sums:
            self.sums.append(0)
            for p in range(0, len(self.data) - STRIDE + 1, STRIDE):
                self.sums.append(zlib.crc32(self.data[p : p + STRIDE], self.sums[-1]))
        upto = lambda p: zlib.crc32(self.data[p // STRIDE * STRIDE : p], self.sums[p // STRIDE])
        return upto(high) ^ shifted(upto(low), high - low)


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2**power zero bytes do to a CRC-32, as a matrix over bits."""
    if power == 0:
        rows = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit: the format's polynomial, reflected
        for _ in range(3):
            rows = [_times(rows, r) for r in rows]
        return tuple(rows)
    half = list(_zeros(power - 1))
    return tuple(_times(half, r) for r in half)


def shifted(crc: int, n: int) -> int:
    """A CRC-32 as it goes on over ``n`` zero bytes, without what begins and ends it."""
    power = 0
    while n:
        if n & 1:
            crc = _times(list(_zeros(power)), crc)
        n >>= 1
        power += 1
    return crc


# Each validator takes the bytes, a place, and what is known about the bytes, and returns (media type, length) or None.
def _riff_step(b: bytes, p: int) -> tuple[int | None, object]:
    if p + 8 > len(b):
        return None, None
    n = struct.unpack_from("<I", b, p + 4)[0]
    return (p + 8 + n + (n & 1), None) if p + 8 + n + (n & 1) <= len(b) else (None, None)


def _riff_next(name: bytes) -> Callable[[bytes, int], tuple[int | None, object]]:
    """A list's result is where its first chunk of that name is."""

    def step(b: bytes, p: int) -> tuple[int | None, object]:
        return (None, p) if b[p : p + 4] == name else _riff_step(b, p)

    return step


def _riff(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    length = 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    if kind is None or at + length > len(b) or length <= 12 or marks.chain("riff", _riff_step).upto(at + 12, at + length) != at + length:
        return None
    needed = {"audio/wav": (b"fmt ", b"data")}.get(kind, ())
    found = [marks.chain(f"riff {name}", _riff_next(name)).end(at + 12) for name in needed]
    return (kind, length) if all(p is not None and p < at + length for p in found) else None


def _png(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    def step(b: bytes, p: int) -> tuple[int | None, object]:
        if p + 12 > len(b):
            return None, None
        end = p + 12 + struct.unpack_from(">I", b, p)[0]
        name = b[p + 4 : p + 8]
        if end > len(b) or not name.isalpha() or marks.crc32(p + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
            return None, None
        return (None, end) if name == b"IEND" else (end, None)

    # The head chunk has 13 bytes.
    end = marks.chain("png", step).end(at + 8) if b[at + 8 : at + 16] == b"\0\0\0\rIHDR" else None
    return ("image/png", end - at) if end else None


def _blocks_step(b: bytes, p: int) -> tuple[int | None, object]:
    """A run of GIF sub-blocks; its result is its end."""
    if p >= len(b):
        return None, None
    return (p + 1 + b[p], None) if b[p] else (None, p + 1)


def _gif(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    def step(b: bytes, p: int) -> tuple[int | None, object]:
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            inner = p + 2
        elif b[p] == 0x2C and p + 10 < len(b):
            inner = p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return None, None
        return marks.chain("gif blocks", _blocks_step).end(inner), None

    if at + 13 > len(b):
        return None
    end = marks.chain("gif", step).end(at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0))
    return ("image/gif", end - at) if end else None


def _jpeg_step(b: bytes, state: int) -> tuple[int | None, object]:
    """From segment to segment. A state is twice the place, and one more once there was a scan."""
    p, scan = state >> 1, state & 1
    if p + 2 > len(b) or b[p] != 0xFF:
        return None, None
    mark = b[p + 1]
    if mark == 0xD9:
        return None, p + 2 if scan else None
    if p + 4 > len(b):
        return None, None
    p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    if mark == 0xDA:
        scan = 1
        while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
            p += 2
        if p < 0 or p + 1 >= len(b):
            return None, None
    return 2 * p + scan, None


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.chain("jpeg", _jpeg_step).end(2 * (at + 2))
    return ("image/jpeg", end - at) if end else None


def _bmp(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    length, spare, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = spare == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= start < length <= len(b) - at
    return ("image/bmp", length) if good else None


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.next(b"%%EOF", at)
    good = end >= 0 and b[at + 5 : at + 8].replace(b".", b"").isdigit() and 0 <= marks.next(b"startxref", at) < end
    return ("application/pdf", end + 5 - at) if good else None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, comment = struct.unpack_from("<IIH", b, end + 12)
    good = at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + comment <= len(b)
    return ("application/zip", end + 22 + comment - at) if good else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    reader = zlib.decompressobj(31)
    try:
        p = at
        while not reader.eof and p < len(b):
            piece = b[p : p + (1 << 16)]
            while piece and not reader.eof:
                reader.decompress(piece, 1 << 20)
                piece = reader.unconsumed_tail
            p += 1 << 16
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(reader.unused_data) - at) if reader.eof else None


def crc_table(polynomial: int, bits: int) -> list[int]:
    """Of a check sum whose highest bit goes first, for each byte."""
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = x << 1 ^ (polynomial if x >> (bits - 1) & 1 else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return out


#: Fixed values of the format: the polynomials of a frame head's and a frame's check sum.
CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def _flac(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """A stream's frames don't say how long they are, but each has a check sum over its head and another over itself.

    The first frame must stand right behind the metadata. A running sum over the bytes is zero again where a frame ends, and there the next one begins
    or the stream has ended; heads of frames and ends are looked for in one pass.
    """
    p, last, first = at + 4, False, True
    while not last:
        if p + 4 > len(b):
            return None
        kind, n = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first != (kind == 0) or first and n != 34 or p + 4 + n > len(b):
            return None
        last, first = b[p] >> 7 == 1, False
        p += 4 + n

    def head(q: int) -> bool:
        """Whether a frame's head stands at ``q``: the sync code, a number of up to seven bytes, and the sum over it."""
        if q + 6 > len(b) or b[q] != 0xFF or b[q + 1] & 0xFE != 0xF8 or b[q + 3] & 1:
            return False
        lead = b[q + 4]
        more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        end = q + 5 + more + {6: 1, 7: 2}.get(b[q + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[q + 2] & 15, 0)
        if end >= len(b):
            return False
        total = 0
        for x in b[q:end]:
            total = CRC8[total ^ x]
        return total == b[end]

    if not head(p):
        return None
    total, end = 0, None
    for q in range(p, len(b)):
        total = (total << 8 & 0xFFFF) ^ CRC16[total >> 8 ^ b[q]]
        # A sum of nothing is zero as well, so a frame has its head and two bytes of sum at least.
        if total == 0 and q - p > 8:
            end = q + 1
            if head(end):
                p, total = end, 0
            elif len(b) - end < 6 or b[end : end + 2] != b"\xff\xf8" and b[end : end + 2] != b"\xff\xf9":
                return "audio/flac", end - at
    return None


def _ogg_step(b: bytes, p: int) -> tuple[int | None, object]:
    """From page to page, to the one that says it is the last."""
    if p + 27 > len(b) or b[p : p + 5] != b"OggS\0":
        return None, None
    table = b[p + 27 : p + 27 + b[p + 26]]
    end = p + 27 + len(table) + sum(table)
    if len(table) < b[p + 26] or end > len(b):
        return None, None
    return (None, end) if b[p + 5] & 4 else (end, None)


def _ogg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.chain("ogg", _ogg_step).end(at)
    return ("audio/ogg", end - at) if end else None


VALIDATORS = {"riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg}


def automaton() -> ahocorasick.Automaton:
    """Over latin-1 text, in which a byte is a character."""
    out = ahocorasick.Automaton()
    for magic, name in MAGIC:
        out.add_word(magic.decode("latin-1"), (len(magic), name))
    out.make_automaton()
    return out


def sniff(data: bytes, words: ahocorasick.Automaton) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Confirmed media (offset, length, type) in order: those not inside another, and of the first one at offset 0, those next within it."""
    marks = Marks(data)
    out: list[tuple[int, int, str]] = []
    inner: list[tuple[int, int, str]] = []
    free = inner_free = 0
    for end, (n, name) in words.iter(data.decode("latin-1")):
        at = end + 1 - n
        if at < free:
            # Within the medium that begins the bytes: carved too, if it ends there.
            if out[0][0] == 0 and at < out[0][1] and at >= inner_free and (found := VALIDATORS[name](data, at, marks)) and at + found[1] <= out[0][1]:
                inner.append((at, found[1], found[0]))
                inner_free = at + found[1]
        elif found := VALIDATORS[name](data, at, marks):
            out.append((at, found[1], found[0]))
            free = at + found[1]
    return out, inner


def media_inside(data: bytes, words: ahocorasick.Automaton) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The type of the medium that begins the bytes (null if none does), and the media carved from within it or behind it."""
    found, inner = sniff(data, words)
    if not found or found[0][0]:
        return None, found
    return found[0][2], inner + found[1:]


CARVED = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
SNIFFED = arrow_fields(id="long", declared="text", actual="text", corrected="flag", media_bytes="long", media_sha256="text", carved=CARVED)


def sniff_media(df: DataFrame, id_col: str, media_col: str, declared_col: str | None = None) -> DataFrame:
    """One row for each row of ``df``: id, declared and actual type, whether they differ, size and digest, and carved media.

    Null bytes count as empty: no type, nothing carved. Without a confirmed medium at the start the actual type is null and the declared
    one isn't corrected. Repeated rows repeat; other columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = []
            for i, declared, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = data or b""
                actual, carved = media_inside(data, words)
                rows.append({"id": i, "declared": declared, "actual": actual, "corrected": actual is not None and actual != declared, "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "carved": [{"offset": a, "length": n, "type": t} for a, n, t in carved]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SNIFFED)

    declared = F.col(f"`{declared_col}`").cast("string") if declared_col else F.lit(None).cast("string")
    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), declared, F.col(f"`{media_col}`").cast("binary")), SNIFFED, run)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit unsigned mono samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n & 1)


def from_wav(data: bytes) -> bytes:
    """The samples of the data chunk."""
    p = 12
    while data[p : p + 4] != b"data":
        p += 8 + (n := struct.unpack_from("<I", data, p + 4)[0]) + (n & 1)
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def padded(text: str) -> bytes:
    """UTF-8, zeros up to a positive multiple of 64 bytes."""
    raw = text.encode()
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, to three places."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean**2)))
    held = p[p > 0]
    return f"mean={mean:.3f};deviation={deviation:.3f};entropy={float(-(held * np.log2(held)).sum()):.3f}"


STORED = arrow_fields(doc_id="long", n_bytes="long", declared="text", media="bytes")
READ = arrow_fields(doc_id="long", n_bytes="long", payload_bytes="long", payload_sha256="text", tail_crc32="long", media_bytes="long", media_sha256="text", feature="text")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a sound file in a binary column; its declared type is that of the source, ``text/plain``.

    Whole texts are stored. A null text counts as empty; a null id stays null; repeated rows repeat; other columns aren't read, whatever their names; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [to_wav(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(["text/plain"] * len(texts), pa.string()), pa.array(media, pa.binary())], schema=STORED)

    return map_batches(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), STORED, run)


def read_stored(df: DataFrame) -> DataFrame:
    """From the stored bytes of :func:`store_texts`: sniff, correct the type, read the samples back and take their features.

    Null ids and repeated rows stay as they are, an empty table gives an empty result; bytes that aren't the sound file that was written, null among them, raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = []
            for doc, n, declared, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                actual, carved = media_inside(data, words)
                if actual != "audio/wav":
                    raise ValueError(f"the stored medium of document {doc} is {actual}, not the sound file that was written")
                payload = from_wav(data)
                inner = ",".join(f"{a}:{k}:{t}" for a, k, t in carved)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), f"type={actual};declared={declared};{features(payload)};carved={inner}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    return map_batches(df.select("doc_id", "n_bytes", "declared", "media"), READ, run)


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stored(materialize(store_texts(load_table(spark, sf_dir, "documents")), "media-stored"))
