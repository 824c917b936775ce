"""Media columns: lossless storage of bytes as 8-bit sound, signature sniffing and carving.

An Aho-Corasick automaton over all magic bytes finds candidates in one pass; a validator of
the format then reads structure and lengths, so a magic number in running text counts for
nothing. What is confirmed at the start is the true type of a medium, whatever was
declared; what is confirmed further in is embedded and can be carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvane.frames import narrow
from sylvane.llm.batches import bound_batches, texts_of

UNIT, FILLER, RATE = 576, b"\xff", 8000


class Found(NamedTuple):
    """A confirmed medium: type, begin and end in the bytes that were sniffed."""

    kind: str
    begin: int
    end: int


class Reading:
    """What the validators of one byte string share, so that many candidates cost no more than one pass each.

    Places of marks are listed once. Walks along blocks that point to the next one are
    remembered: where two candidates come to the same block, the second stops there.
    """

    def __init__(self, data: bytes):
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self._ends: dict[str, dict[int, tuple[int | None, bool]]] = {}

    def marks(self, mark: bytes) -> list[int]:
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._marks[mark]

    def next_mark(self, mark: bytes, at: int) -> int | None:
        """The first place of the mark from ``at`` on."""
        places = self.marks(mark)
        i = bisect_left(places, at)
        return places[i] if i < len(places) else None

    def last_mark(self, mark: bytes, at: int, end: int) -> int | None:
        """The last place of the mark between ``at`` and ``end``."""
        places = self.marks(mark)
        i = bisect_left(places, end) - 1
        return places[i] if i >= 0 and places[i] >= at else None

    def walk(self, name: str, at: int, step: Callable[[int], tuple[int | None, bool, bool]]) -> tuple[int | None, bool]:
        """Follows ``step(place) -> (next place or end or None, whether it is the end, a sign)``: the end, and whether any step gave the sign."""
        known, path = self._ends.setdefault(name, {}), []
        found: tuple[int | None, bool] | None = None
        while found is None:
            if at in known:
                found = known[at]
                break
            after, last, sign = step(at)
            path.append((at, sign))
            if after is None or last or after <= at:
                found = (after if last else None, False)
            else:
                at = after
        for place, sign in reversed(path):
            found = (found[0], found[1] or sign)
            known[place] = found
        return found


def _riff(read: Reading, at: int) -> tuple[str, int] | None:
    """RIFF: a known form whose chunks fill the declared length."""
    data = read.data
    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    kind = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}.get(form)
    end, cursor, chunks = at + 8 + size, at + 12, 0
    if kind is None or end > len(data):
        return None
    while cursor + 8 <= end:
        cursor += 8 + (n := struct.unpack_from("<I", data, cursor + 4)[0]) + (n & 1)
        chunks += 1
    return (kind, end) if chunks and cursor in (end, end + 1) else None


def _png(read: Reading, at: int) -> tuple[str, int] | None:
    """PNG: IHDR first, every chunk's CRC right, up to IEND."""
    data = read.data
    cursor, first = at + 8, True
    while cursor + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, cursor)
        if cursor + 12 + n > len(data) or first and (name != b"IHDR" or n != 13):
            return None
        if zlib.crc32(data[cursor + 4 : cursor + 8 + n]) != struct.unpack_from(">I", data, cursor + 8 + n)[0]:
            return None
        cursor, first = cursor + 12 + n, False
        if name == b"IEND":
            return "png", cursor
    return None


def _gif(read: Reading, at: int) -> tuple[str, int] | None:
    """GIF: blocks of images and extensions up to the trailer."""
    data, n = read.data, len(read.data)
    if at + 13 > n:
        return None

    def part(i: int) -> tuple[int | None, bool, bool]:
        return (None, False, False) if i >= n else (i + data[i] + 1, False, False) if data[i] else (i + 1, True, False)

    def block(i: int) -> tuple[int | None, bool, bool]:
        tag = data[i] if i < n else None
        if tag == 0x3B:
            return i + 1, True, False
        if tag == 0x21:
            return read.walk("gif parts", i + 2, part)[0], False, False
        if tag == 0x2C and i + 10 <= n:
            colours = 3 << ((data[i + 9] & 7) + 1) if data[i + 9] & 128 else 0
            return read.walk("gif parts", i + 10 + colours + 1, part)[0], False, True
        return None, False, False

    end, image = read.walk("gif", at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 128 else 0), block)
    return ("gif", end) if end is not None and image else None


_AFTER_SCAN = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def _jpeg(read: Reading, at: int) -> tuple[str, int] | None:
    """JPEG: marker segments of declared lengths, a frame and a scan, up to the end marker."""
    data = read.data

    def segment(i: int) -> tuple[int | None, bool, bool]:
        if i + 4 > len(data) or data[i] != 0xFF:
            return None, False, False
        marker = data[i + 1]
        if marker == 0xD9 or 0xD0 <= marker <= 0xD7 or marker in (0, 1, 0xFF):
            return None, False, False
        after = i + 2 + struct.unpack_from(">H", data, i + 2)[0]
        frame = 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if marker != 0xDA:
            return after, False, frame
        found = _AFTER_SCAN.search(data, after)
        if not found:
            return None, False, False
        return (found.start() + 2, True, False) if data[found.start() + 1] == 0xD9 else (found.start(), False, False)

    end, frame = read.walk("jpeg", at + 2, segment)
    return ("jpeg", end) if end is not None and frame else None


def _bmp(read: Reading, at: int) -> tuple[str, int] | None:
    """BMP: declared size, a known header, pixels inside."""
    data = read.data
    if at + 26 > len(data):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", data, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start < size
    return ("bmp", at + size) if ok and at + size <= len(data) else None


def _pdf(read: Reading, at: int) -> tuple[str, int] | None:
    """PDF: a version, then a cross-reference start and the last end mark before another PDF begins."""
    data = read.data
    if not (data[at + 5 : at + 6].isdigit() and data[at + 6 : at + 7] == b"." and data[at + 7 : at + 8].isdigit()):
        return None
    other = read.next_mark(b"%PDF-", at + 5)
    end = read.last_mark(b"%%EOF", at, len(data) if other is None else other)
    return ("pdf", end + 5) if end is not None and read.last_mark(b"startxref", at, end) is not None else None


def _zip(read: Reading, at: int) -> tuple[str, int] | None:
    """ZIP: the end record's directory lies where it says, counted from this entry."""
    data, end = read.data, read.next_mark(b"PK\5\6", at)
    if end is None or end + 22 > len(data):
        return None
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    ok = at + start + size == end and data[at + start : at + start + 4] == b"PK\1\2" and end + 22 + note <= len(data)
    return ("zip", end + 22 + note) if ok else None


def _gzip(read: Reading, at: int) -> tuple[str, int] | None:
    """GZIP: a member that inflates with the right checksum; what it inflates to is not kept."""
    data = read.data
    reader, cursor = zlib.decompressobj(31), at
    try:
        while cursor < len(data) and not reader.eof:
            left = data[cursor : cursor + 4096]
            cursor += len(left)
            while left and not reader.eof:
                reader.decompress(left, 1 << 20)
                left = reader.unconsumed_tail
    except zlib.error:
        return None
    return ("gzip", cursor - len(reader.unused_data)) if reader.eof else None


def _crc8(data: bytes) -> int:
    """The checksum of a FLAC frame's header: polynomial x^8 + x^2 + x + 1."""
    value = 0
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = (value << 1) ^ 0x107 if value & 128 else value << 1
    return value


def _flac(read: Reading, at: int) -> tuple[str, int] | None:
    """FLAC: stream information, blocks of declared lengths, then a frame whose header checks; as it has no length, it lasts to the end."""
    data = read.data
    if at + 42 > len(data) or data[at + 4] & 127 or data[at + 5 : at + 8] != b"\0\0\x22":
        return None
    least, most = struct.unpack_from(">HH", data, at + 8)
    rate = int.from_bytes(data[at + 18 : at + 21], "big") >> 4
    if not 16 <= least <= most or not rate:
        return None

    def block(i: int) -> tuple[int | None, bool, bool]:
        if i + 4 > len(data) or data[i] & 127 == 127:
            return None, False, False
        return i + 4 + int.from_bytes(data[i + 1 : i + 4], "big"), bool(data[i] & 128), False

    i = read.walk("flac", at + 4, block)[0]
    if i is None or i + 6 > len(data) or data[i] != 0xFF or data[i + 1] & 0xFE != 0xF8:
        return None
    lead = data[i + 4]
    number = 1 if lead < 128 else 8 - (lead ^ 255).bit_length()
    size = i + 4 + number + {6: 1, 7: 2}.get(data[i + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[i + 2] & 15, 0)
    return ("flac", len(data)) if size < len(data) and _crc8(data[i:size]) == data[size] else None


def _ogg(read: Reading, at: int) -> tuple[str, int] | None:
    """OGG: a first page, then pages of declared lengths up to the one that ends the stream."""
    data = read.data

    def page(i: int) -> tuple[int | None, bool, bool]:
        if i + 27 > len(data) or data[i : i + 5] != b"OggS\0" or i + 27 + data[i + 26] > len(data):
            return None, False, False
        after = i + 27 + data[i + 26] + sum(data[i + 27 : i + 27 + data[i + 26]])
        return (after if after <= len(data) else None), after <= len(data) and bool(data[i + 5] & 4), False

    end = read.walk("ogg", at, page)[0] if at + 6 <= len(data) and data[at + 5] & 2 else None
    return ("ogg", end) if end is not None else None


# The boxes that a file has beside its type.
_BOXES = re.compile(rb"moov|mdat|moof|meta|free|skip|uuid|sidx|styp|mfra|pdin|wide")


def _mp4(read: Reading, at: int) -> tuple[str, int] | None:
    """MP4 and its kin: a file type box, then boxes of declared lengths, one of them with media or its index."""
    data = read.data
    begin = at - 4

    def box(i: int) -> tuple[int | None, bool, bool]:
        if i != begin and not _BOXES.match(data, i + 4):
            return i, True, False
        after = i + max(8, int.from_bytes(data[i : i + 4], "big"))
        return (after if after <= len(data) else None), False, data[i + 4 : i + 8] in (b"moov", b"mdat", b"moof", b"meta")

    if begin < 0 or not 16 <= int.from_bytes(data[begin:at], "big") <= 4096:
        return None
    end, media = read.walk("mp4", begin, box)
    return ("mp4", end) if media and end is not None else None


#: The magic bytes of each format, with its validator.
SIGNATURES: dict[bytes, Callable[[Reading, int], tuple[str, int] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"PK\3\4": _zip,
    b"\x1f\x8b\x08": _gzip,
    b"fLaC": _flac,
    b"OggS": _ogg,
    b"ftyp": _mp4,
}
#: Formats whose magic bytes don't come first: how far they are from the beginning.
LEAD = {b"ftyp": 4}


def automaton() -> ahocorasick.Automaton:
    """All signatures as Latin-1 strings, which map bytes to characters one to one."""
    built = ahocorasick.Automaton()
    for magic, validate in SIGNATURES.items():
        built.add_word(magic.decode("latin-1"), (len(magic), LEAD.get(magic, 0), validate))
    built.make_automaton()
    return built


def sniff(data: bytes, matcher: ahocorasick.Automaton) -> list[Found]:
    """Confirmed media from left to right, none inside another except inside the one at 0."""
    found: list[Found] = []
    free, read = 0, Reading(data)
    for last, (n, lead, validate) in matcher.iter(data.decode("latin-1")):
        at = last - n + 1
        begin = at - lead
        if begin < free or found and begin == found[0].begin:
            continue
        hit = validate(read, at)
        if hit:
            found.append(Found(hit[0], begin, hit[1]))
            free = hit[1] if begin else 0
    return found


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file: one channel of unsigned 8-bit samples, a sample for each byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def load(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    cursor = 12
    while cursor + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, cursor)
        if name == b"data":
            return media[cursor + 8 : cursor + 8 + n]
        cursor += 8 + n + (n & 1)
    raise ValueError("no samples")


def padded(data: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of the unit."""
    return data + FILLER * (-len(data) % UNIT if data else UNIT)


def describe(media: bytes, declared: str, matcher: ahocorasick.Automaton) -> tuple[str, list[Found]]:
    """The feature string of a stored medium, and what is embedded in it.

    Type by content (and whether the declared one was wrong), samples, mean, deviation and
    share of sign changes around the mean, then embedded media as type@begin-end.
    """
    found = sniff(media, matcher)
    true = found[0].kind if found and found[0].begin == 0 else "unknown"
    inside = [x for x in found if x.begin]
    feature = f"type={true};corrected={int(true != declared)}"
    if true == "wav":
        samples = np.frombuffer(load(media), np.uint8)
        total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
        n = len(samples)
        above = samples * np.int64(n) > total
        crossings = int(np.count_nonzero(above[1:] != above[:-1]))
        feature += f";samples={n};mean={total / n:.4f};deviation={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};crossings={crossings / n:.6f}"
    return feature + ";embedded=" + ",".join(f"{x.kind}@{x.begin}-{x.end}" for x in inside), inside


COLUMNS = {
    "n_bytes": ("bigint", pa.int64()),
    "payload_bytes": ("bigint", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("bigint", pa.int64()),
    "media_bytes": ("bigint", pa.int64()),
    "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()),
    "media": ("binary", pa.binary()),
    "carved": ("array<struct<type:string,data:binary>>", pa.list_(pa.struct([("type", pa.string()), ("data", pa.binary())]))),
}
DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_columns(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS), id_col: str = "doc_id", text_col: str = "text", declared: str = "text") -> DataFrame:
    """``doc_id`` and the asked columns (see ``COLUMNS``), one row for each row of the input.

    The text's UTF-8, filled up with byte 255 to a positive multiple of 576, is stored as a
    WAV file (``media``); digests and features are of what is read back from it. ``carved``
    has the embedded media. Null counts as empty: 576 filler bytes. Equal texts give equal
    values; texts of any length are stored whole; of candidates that overlap the leftmost is
    carved; repeated rows give repeated results; further columns are not read; an empty table
    gives none.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(docs.sparkSession)

    def one(data: bytes, matcher: ahocorasick.Automaton) -> dict:
        media = store(padded(data))
        payload = load(media)
        feature, inside = describe(media, declared, matcher)
        return {
            "n_bytes": len(data),
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-32:]),
            "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": feature,
            "media": media,
            "carved": [{"type": x.kind, "data": media[x.begin : x.end]} for x in inside],
        }

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [one(data, matcher) for data in texts_of(part.column(1))]
                made = [pa.array([x[c] for x in found], COLUMNS[c][1]) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))
