"""Media columns: signature sniffing with Aho-Corasick and format validators.

One automaton over all magic bytes and end marks finds every place where a known
format may begin or end. A validator for that format then follows the structure from
there (chunk, page and header lengths, directories, checksums where the format has
them) and gives the exact length, or rejects the place. A value whose start validates
gets that type, whatever was declared; validated places further inside are carved as
embedded media, but not the parts that a format has by itself: only samples and
documents (OPEN) are searched within, other formats own their bytes. Ends are looked
up in the marks of the one pass, so that many false beginnings don't each search on to
the end of the value.

Lengths: a WAVE, BMP, PGM, PNG, GIF or gzip says its own; a JPEG ends at the end mark
that its segments lead to; a PDF at the last end mark before the next PDF's header whose
startxref, if there is one, leads to a table of this file; a zip at the end record whose
directory leads back to its first byte, comment included; an Ogg is a run of pages; a
FLAC is its metadata blocks and frames, each frame held against its CRC.

Payloads are stored as 8-bit mono PCM in a WAVE file, or as 8-bit grey samples in a
BMP or PGM image; which of the three depends on the payload alone.

Defined cases: a null value sniffs as null type, length 0 and nothing embedded; an
empty text has the payload of 64 zero bytes; equal values give equal results; other
columns are ignored, kept ones named like a result give way to it; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm._run import kept, small_batches, table

BLOCK = 64
ROW = 64

#: Magic bytes by format.
MAGIC = {
    "wav": b"RIFF",
    "bmp": b"BM",
    "pgm": b"P5\n",
    "png": b"\x89PNG\r\n\x1a\n",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
    "pdf": b"%PDF-",
    "zip": b"PK\x03\x04",
    "gzip": b"\x1f\x8b\x08",
    "flac": b"fLaC",
    "ogg": b"OggS",
}
#: The marks by which formats end.
ENDS = {"pdf": b"%%EOF", "zip": b"PK\x05\x06"}
#: Formats within which media of other formats are looked for.
OPEN = {"wav", "bmp", "pgm", "pdf"}


def wav(payload: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def bmp(payload: bytes) -> bytes:
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 14 + 40 + len(grey)
    return struct.pack("<2sIHHI", b"BM", at + len(payload), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, ROW, len(payload) // ROW, 1, 8, 0, len(payload), 2835, 2835, 256, 256) + grey + payload


def pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


STORES = (wav, bmp, pgm)


#: Bytes between two sums that long checksums are put together from.
STEP = 1 << 12


@lru_cache
def _crc_powers() -> list[list[int]]:
    """For each k, what 2^k zero bytes make of each bit of a CRC-32."""

    def through(rows: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= rows[i]
        return out

    one = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        one = [through(one, x) for x in one]
    powers = [one]
    for _ in range(40):
        powers.append([through(powers[-1], x) for x in powers[-1]])
    return powers


def _crc_moved(crc: int, n: int) -> int:
    """What n zero bytes make of a checksum, without what they add of their own."""
    for k, rows in enumerate(_crc_powers()):
        if n >> k & 1:
            out = 0
            for i in range(32):
                if crc >> i & 1:
                    out ^= rows[i]
            crc = out
    return crc


class Value:
    """The bytes of one value, where formats may begin, and what validators share."""

    def __init__(self, b: bytes):
        self.b = b
        self.begins: list[tuple[int, str]] = []
        self.ends: dict[str, list[int]] = {k: [] for k in ENDS}
        for last, (kind, long, end) in _automaton().iter(b.decode("latin-1")):
            if end:
                self.ends[kind].append(last + 1 - long)
            else:
                self.begins.append((last + 1 - long, kind))
        self.pdfs = [at for at, kind in self.begins if kind == "pdf"]
        self._zeros: list[int] | None = None
        self._marks: list[int] | None = None
        self._after: dict[int, int] = {}
        self._zips: dict[int, int] | None = None
        self._riff: dict[int, tuple[int, int]] = {}
        self._png: dict[int, int] = {}
        self._gif: dict[int, int] = {}
        self._gif_data: dict[int, int] = {}
        self._sums: list[int] | None = None

    def crc(self, start: int, end: int) -> int:
        """zlib's CRC-32 of the bytes from start to end: of long ranges by the sums at every STEP bytes, so that ranges that overlap are read once."""
        if end - start <= 2 * STEP:
            return zlib.crc32(self.b[start:end])
        if self._sums is None:
            self._sums = [0]
            for i in range(0, len(self.b), STEP):
                self._sums.append(zlib.crc32(self.b[i : i + STEP], self._sums[-1]))
        upto = lambda x: zlib.crc32(self.b[x // STEP * STEP : x], self._sums[x // STEP])
        return upto(end) ^ _crc_moved(upto(start), end - start)

    def walked(self, place: int, step, known: dict[int, object]):
        """Where the walk from place ends. step(place) gives (next place, None) or (None, result); walks that meet are walked once."""
        passed = []
        while place not in known:
            passed.append(place)
            following, result = step(place)
            if following is None:
                break
            place = following
        else:
            result = known[place]
        known.update(dict.fromkeys(passed, result))
        return result

    def riff_chunks(self, place: int) -> tuple[int, int]:
        """The first "fmt " and the first "data" chunk of the chunks from place on, or -1."""
        passed, b = [], self.b
        while place not in self._riff and place + 8 <= len(b):
            passed.append(place)
            size = int.from_bytes(b[place + 4 : place + 8], "little")
            place += 8 + size + size % 2
        fmt, data = self._riff.get(place, (-1, -1))
        for at in reversed(passed):
            name = b[at : at + 4]
            fmt, data = at if name == b"fmt " else fmt, at if name == b"data" else data
            self._riff[at] = fmt, data
        return self._riff.get(passed[0], (fmt, data)) if passed else (fmt, data)

    def png_end(self, place: int) -> int:
        """Behind the IEND chunk that the chunks from place lead to, each with its checksum, or -1."""

        def step(at):
            if at + 12 > len(self.b):
                return None, -1
            end = at + 8 + int.from_bytes(self.b[at : at + 4], "big")
            if end + 4 > len(self.b) or self.crc(at + 4, end) != int.from_bytes(self.b[end : end + 4], "big"):
                return None, -1
            return (None, end + 4) if self.b[at + 4 : at + 8] == b"IEND" else (end + 4, None)

        return self.walked(place, step, self._png)

    def gif_end(self, place: int) -> int:
        """Behind the trailer that the blocks from place lead to, or -1."""
        b = self.b

        def block(at):
            """Past a run of sub-blocks."""
            if at >= len(b) or not b[at]:
                return None, at + 1
            return at + 1 + b[at], None

        def step(at):
            if at >= len(b):
                return None, -1
            if b[at] == 0x3B:
                return None, at + 1
            if b[at] == 0x21:
                data = at + 2
            elif b[at] == 0x2C and at + 10 <= len(b):
                data = at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
            else:
                return None, -1
            return self.walked(data, block, self._gif_data), None

        return self.walked(place, step, self._gif)

    def zero(self, place: int) -> int:
        """The next zero byte, or -1."""
        if self._zeros is None:
            self._zeros = [m.start() for m in re.finditer(b"\0", self.b)]
        k = bisect_left(self._zeros, place)
        return self._zeros[k] if k < len(self._zeros) else -1

    def jpeg_end(self, place: int) -> int:
        """Behind the end mark that the scan at place leads to, or -1. Scans that meet lead to the same end."""
        if self._marks is None:  # markers within or after entropy-coded data
            self._marks = [m.start() for m in re.finditer(rb"\xff[\x01-\xcf\xd8-\xfe]", self.b)]
        passed, end = [], -1
        while True:
            k = bisect_left(self._marks, place)
            if k == len(self._marks):
                break
            at = self._marks[k]
            if at in self._after:
                end = self._after[at]
                break
            passed.append(at)
            if self.b[at + 1] == 0xD9:
                end = at + 2
                break
            if self.b[at + 1] == 0xD8 or at + 4 > len(self.b):
                break
            place = at + 2 + max(2, int.from_bytes(self.b[at + 2 : at + 4], "big"))
        self._after |= dict.fromkeys(passed, end)
        return end

    def zip_end(self, at: int) -> int:
        """Behind the end record whose directory begins the archive at `at`, or -1."""
        if self._zips is None:
            self._zips = {}
            for end in self.ends["zip"]:
                if end + 22 <= len(self.b):
                    n, size, start, note = struct.unpack_from("<HIIH", self.b, end + 10)
                    directory = end - size
                    if directory - start >= 0 and end + 22 + note <= len(self.b) and self._listed(directory, end, n, directory - start):
                        self._zips.setdefault(directory - start, end + 22 + note)
        return self._zips.get(at, -1)

    def _listed(self, place: int, end: int, n: int, base: int) -> bool:
        """Whether n directory entries fill the bytes from place to end, each leading to a local header."""
        while place + 46 <= end and self.b[place : place + 4] == b"PK\x01\x02":
            sizes, local = struct.unpack_from("<HHH", self.b, place + 28), int.from_bytes(self.b[place + 42 : place + 46], "little")
            if self.b[base + local : base + local + 4] != MAGIC["zip"]:
                return False
            place, n = place + 46 + sum(sizes), n - 1
        return place == end and n == 0


def _wav(v: Value, at: int):
    b = v.b
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    fmt, data = v.riff_chunks(at + 12)
    if fmt < 0 or data < 0 or max(fmt, data) + 8 > end:
        return None
    size = int.from_bytes(b[data + 4 : data + 8], "little")
    return (end - at, data + 8, size) if data + 8 + size <= end else None


def _bmp(v: Value, at: int):
    b = v.b
    if at + 54 > len(b):
        return None
    size, _, _, start, head, wide, high, planes, bits, packed = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    row = (wide * bits + 31) // 32 * 4
    if head != 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or packed or wide <= 0 or start + row * abs(high) != size or at + size > len(b):
        return None
    return size, at + start, row * abs(high)


def _pgm(v: Value, at: int):
    lines = v.b[at : at + 64].split(b"\n", 3)
    if len(lines) < 4 or lines[2] != b"255" or not all(x.isdigit() for x in lines[1].split(b" ")) or lines[1].count(b" ") != 1:
        return None
    wide, high = map(int, lines[1].split(b" "))
    start = at + sum(len(x) + 1 for x in lines[:3])
    if not wide * high or start + wide * high > len(v.b):
        return None
    return start + wide * high - at, start, wide * high


def _whole(at: int, end: int):
    return None if end < 0 else (end - at, at, end - at)


def _png(v: Value, at: int):
    return _whole(at, v.png_end(at + 8)) if v.b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else None


def _gif(v: Value, at: int):
    b = v.b
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return None
    return _whole(at, v.gif_end(at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)))


def _jpeg(v: Value, at: int):
    b, place = v.b, at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        size = int.from_bytes(b[place + 2 : place + 4], "big")
        if size < 2:
            return None
        place += 2 + size
        if b[place - size - 1] == 0xDA:
            return _whole(at, v.jpeg_end(place))
    return None


def _gzip(v: Value, at: int):
    flags, place = v.b[at + 3] if at + 10 <= len(v.b) else 0xFF, at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        place += 2 + int.from_bytes(v.b[place : place + 2], "little")
    for bit in (8, 16):  # file name and comment
        if flags & bit:
            place = v.zero(place) + 1
            if not place:
                return None
    d = zlib.decompressobj(31)
    left, size = memoryview(v.b)[at:], 0
    try:
        while not d.eof and len(left):
            d.decompress(left[: 1 << 16])
            size += min(len(left), 1 << 16)
            left = left[1 << 16 :]
    except zlib.error:
        return None
    return _whole(at, at + size - len(d.unused_data)) if d.eof else None


def _pdf(v: Value, at: int):
    if not re.match(rb"\d\.\d", v.b[at + 5 : at + 8]):
        return None
    k = bisect_left(v.pdfs, at + 1)
    marks = v.ends["pdf"]
    low, high = bisect_left(marks, at), bisect_left(marks, v.pdfs[k]) if k < len(v.pdfs) else len(marks)
    for end in reversed(marks[low:high]):
        said = re.search(rb"startxref\s+(\d{1,15})\s*$", v.b[max(at, end - 48) : end])
        if said is None or said[1] == b"0" or re.match(rb"xref|\d+\s+\d+\s+obj", v.b[at + int(said[1]) : at + int(said[1]) + 32]):
            return _whole(at, end + len(ENDS["pdf"]))
    return None


def _zip(v: Value, at: int):
    return _whole(at, v.zip_end(at))


def _crc(data: bytes, poly: int, bits: int) -> int:
    """A checksum without reflection that begins with 0."""
    table_, top, mask = _crc_table(poly, bits), bits - 8, (1 << bits) - 1
    c = 0
    for x in data:
        c = (c << 8 & mask) ^ table_[c >> top ^ x]
    return c


@lru_cache
def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
        out.append(c)
    return out


def _number(b: bytes, at: int) -> tuple[int, int] | None:
    """A number in FLAC's variable-length code, and the bytes that it takes."""
    n = 0
    while n < 8 and at < len(b) and b[at] >> 7 - n & 1:
        n += 1
    if at + max(1, n) > len(b) or n in (1, 8):
        return None
    value = b[at] & 0xFF >> n + 1
    for x in b[at + 1 : at + max(1, n)]:
        if x >> 6 != 2:
            return None
        value = value << 6 | x & 0x3F
    return value, max(1, n)


def _frame(b: bytes, at: int, block: int) -> tuple[int, int] | None:
    """(first sample, samples) of the FLAC frame whose header is at `at`."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    coded, rate = b[at + 2] >> 4, b[at + 2] & 15
    number = _number(b, at + 4)
    if number is None or coded == 0 or rate == 15:
        return None
    place = at + 4 + number[1]
    if coded in (6, 7):
        size = int.from_bytes(b[place : place + coded - 5], "big") + 1
        place += coded - 5
    else:
        size = 192 if coded == 1 else 576 << coded - 2 if coded < 6 else 256 << coded - 8
    place += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if place >= len(b) or _crc(b[at:place], 0x07, 8) != b[place]:
        return None
    return (number[0] if b[at + 1] & 1 else number[0] * block), size


def _flac(v: Value, at: int):
    b, place, last, first = v.b, at + 4, False, True
    while not last:
        if place + 4 > len(b):
            return None
        last, kind, size = b[place] >> 7, b[place] & 0x7F, int.from_bytes(b[place + 1 : place + 4], "big")
        if (kind == 0) != first or (first and size != 34) or kind == 127 or place + 4 + size > len(b):
            return None
        place, first = place + 4 + size, False
    block, total = int.from_bytes(b[at + 8 : at + 10], "big"), int.from_bytes(b[at + 21 : at + 26], "big") & 0xFFFFFFFFF
    done, polynomial = 0, (0x8005, 16)
    table_ = _crc_table(*polynomial)
    while not total or done < total:  # an unknown total ends with the frames
        head = _frame(b, place, block)
        if head is None or head[0] != done:
            return _whole(at, place) if not total else None
        c, end = 0, -1
        for i in range(place, len(b)):
            c = (c << 8 & 0xFFFF) ^ table_[c >> 8 ^ b[i]]
            # a frame's CRC brings the sum to 0; what follows must be the next frame, or the end of the samples
            if c == 0 and i + 1 - place >= 8:
                more = _frame(b, i + 1, block)
                if (more is not None and more[0] == done + head[1]) or (total and done + head[1] >= total) or (not total and i + 1 == len(b)):
                    end = i + 1
                    break
        if end < 0:
            return None
        place, done = end, done + head[1]
    return _whole(at, place)


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_sum(page: bytes) -> int:
    """Ogg's checksum is zlib's on reversed bits, begun with 0 and not inverted."""
    c = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def _ogg(v: Value, at: int):
    """A run of pages; a page's checksum must fit, or be left 0."""
    b, place = v.b, at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b) and b[place + 4] == 0:
        n = b[place + 26]
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        said = b[place + 22 : place + 26]
        if place + 27 + n > len(b) or end > len(b) or (any(said) and _ogg_sum(b[place : place + 22] + bytes(4) + b[place + 26 : end]) != int.from_bytes(said, "little")):
            break
        place = end
    return _whole(at, place) if place > at else None


VALID = {"wav": _wav, "bmp": _bmp, "pgm": _pgm, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for marks, end in ((MAGIC, False), (ENDS, True)):
        for kind, mark in marks.items():
            a.add_word(mark.decode("latin-1"), (kind, len(mark), end))
    a.make_automaton()
    return a


def sniffed(b: bytes) -> tuple[str | None, int, int, int, list[tuple[str, int, int]]]:
    """(type, length, start and length of the samples, embedded media as (type, start, length)) of one value."""
    kind, size, start, n, inside = None, 0, 0, 0, []
    v, reach, own = Value(b), 0, 0
    for at, name in v.begins:
        if at < reach or (name == kind and at < own):
            continue  # within media that own their bytes or are carved already
        got = VALID[name](v, at)
        if got is None:
            continue
        if at == 0:
            kind, (size, start, n) = name, got
            own, reach = size, 0 if name in OPEN else size
        else:
            inside.append((name, at, got[0]))
            reach = at + got[0]
    return kind, size, start, n, inside


def sniff(df: DataFrame, column: str, declared: str, *keep: str) -> DataFrame:
    """The kept columns and media_type (sniffed, else the declared one), corrected, media_bytes, sample_start, sample_bytes, embedded."""
    small_batches(df.sparkSession)
    keep = kept(keep, "media_type", "corrected", "media_bytes", "sample_start", "sample_bytes", "embedded")
    kind = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    own = "media_type string, corrected boolean, media_bytes long, sample_start long, sample_bytes long, embedded array<struct<media_type:string,start:long,length:long>>"
    schema = StructType([df.schema[c] for c in keep] + [f for f in StructType.fromDDL(own)])

    def run(batches):
        for b in batches:
            got = [(None, 0, 0, 0, []) if v is None else sniffed(v) for v in b.column(column).to_pylist()]
            said = b.column(declared).to_pylist()
            cols = [
                pa.array([g[0] or d for g, d in zip(got, said, strict=True)], pa.string()),
                pa.array([g[0] is not None and g[0] != d for g, d in zip(got, said, strict=True)]),
                *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)),
                pa.array([[{"media_type": t, "start": s, "length": n} for t, s, n in g[4]] for g in got], kind),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], schema.names)

    return df.select(*dict.fromkeys([*keep, column, declared])).mapInArrow(run, schema)


def store(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of docs (with text), n_bytes, declared and media: the padded bytes as 8-bit samples of a file."""
    small_batches(docs.sparkSession)
    keep = kept(keep, "n_bytes", "declared", "media")
    schema = StructType([docs.schema[c] for c in keep] + [f for f in StructType.fromDDL("n_bytes long, declared string, media binary")])

    def run(batches):
        for b in batches:
            n, declared, media = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                payload = raw + bytes(-len(raw) % BLOCK if raw else BLOCK)
                mark = zlib.crc32(payload)
                n.append(len(raw))
                declared.append(STORES[mark // 3 % 3].__name__)  # as feeds do, it is often wrong
                media.append(STORES[mark % 3](payload))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = sniff(store(docs, "doc_id"), "media", "declared", "doc_id", "n_bytes", "media")
    samples = F.expr("substring(media, cast(sample_start + 1 as int), cast(sample_bytes as int))")
    tail = F.expr(f"substring(media, cast(sample_start + sample_bytes - {BLOCK - 1} as int), {BLOCK})")
    kinds = F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e["media_type"], e["start"], e["length"])), ",")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.col("sample_bytes").alias("payload_bytes"),
        F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        "media_bytes",
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws("|", "media_type", F.when(F.col("corrected"), "corrected").otherwise("as declared"), F.concat(F.lit("embedded="), kinds)).alias("feature"),
    )
