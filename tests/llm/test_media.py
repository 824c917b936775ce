import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from sylvane.llm import media


def png():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 20)
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x05abc" + b"\xff\xda\x00\x04ab" + b"data\xff\x00more\xff\xd9"
FRAME = b"\xff\xf8\x69\x18\x00\x0f"
FLAC = b"fLaC\0\0\0\x22" + struct.pack(">HH", 4096, 4096) + bytes(6) + (44100 << 4).to_bytes(3, "big") + bytes(21) + b"\x84\0\0\2ab" + FRAME + bytes([media._crc8(FRAME)]) + b"sound"
PAGE = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body
OGG = PAGE(2, b"head") + PAGE(0, b"more") + PAGE(4, b"tail")
BOX = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
MP4 = BOX(b"ftyp", b"isom\0\0\0\0mp42") + BOX(b"moov", b"index") + BOX(b"mdat", b"media")
FORMATS = {"png": png(), "zip": archive(), "gif": GIF, "bmp": BMP, "pdf": PDF, "jpeg": JPEG, "gzip": gzip.compress(b"x" * 99), "wav": media.store(b"abcd"), "ogg": OGG, "mp4": MP4}


def test_each_format_is_confirmed_with_its_length():
    matcher = media.automaton()
    for kind, data in FORMATS.items():
        if kind not in ("wav",):
            found = media.sniff(b"lead " + data + b" tail", matcher)
            assert found == [media.Found(kind, 5, 5 + len(data))], kind
        assert media.sniff(data, matcher)[0] == media.Found(kind, 0, len(data))


def test_broken_ones_are_not():
    matcher = media.automaton()
    for kind, data in FORMATS.items():
        if kind != "gzip":
            assert not media.sniff(b"lead " + data[: len(data) - 3], matcher), kind
    assert not media.sniff(b"BM RIFF %PDF- GIF89a PK\3\4 \x1f\x8b\x08 fLaC \xff\xd8\xff", matcher)


def test_flac_lasts_to_the_end():
    matcher = media.automaton()
    assert media.sniff(b"lead " + FLAC, matcher) == [media.Found("flac", 5, 5 + len(FLAC))]
    assert media._crc8(b"123456789") == 0xF4
    broken = bytearray(FLAC)
    broken[FLAC.index(FRAME) + 6] ^= 1
    assert not media.sniff(b"lead " + bytes(broken), matcher) and not media.sniff(b"fLaC\0\0\0\x22" + bytes(90), matcher)


def test_neighbours_of_one_format_stay_apart():
    for kind, data in FORMATS.items():
        found = media.sniff(b"lead " + data + b" " + data, media.automaton())
        assert found == [media.Found(kind, 5, 5 + len(data)), media.Found(kind, 6 + len(data), 6 + 2 * len(data))], kind


def test_time_is_linear_in_the_candidates():
    matcher = media.automaton()
    units = (b"%PDF-1.4 ", b"PK\3\4", b"GIF89a1234567!!", b"GIF89a1234567,123456789", b"RIFFzzzzWAVE", b"BM1234", b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab", b"\x89PNG\r\n\x1a\n", b"fLaC", b"OggS\0\2", b"\0\0\0\x10ftyp", b"startxref %%EOF %PDF-1.")
    for unit in units:
        began = time.perf_counter()
        media.sniff(b"x" + unit * (2_000_000 // len(unit)), matcher)
        assert time.perf_counter() - began < 30, unit


def plain_feature(payload):
    """The feature string of stored bytes without embedded media, by counting one by one."""
    n = len(payload)
    mean = sum(payload) / n
    deviation = (sum(b * b for b in payload) / n - mean * mean) ** 0.5
    crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:]))
    return f"type=wav;corrected=1;samples={n};mean={mean:.4f};deviation={deviation:.4f};crossings={crossings / n:.6f};embedded="


def test_carving_and_the_true_type():
    data = b"abc" + png() + b"-" + archive()
    feature, inside = media.describe(media.store(media.padded(data)), "text", media.automaton())
    assert feature.startswith("type=wav;corrected=1;") and [x.kind for x in inside] == ["png", "zip"]
    assert media.describe(media.store(b"ab"), "wav", media.automaton())[0].startswith("type=wav;corrected=0")


def test_round_trip(spark, odd_docs, odd_rows, no_docs):
    rows = media.media_columns(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    given = {d: (t or "").encode() for d, t, *_ in odd_rows}
    for r in rows:
        data = given[r["doc_id"]]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["feature"] == plain_feature(payload)
        assert media.load(bytes(r["media"])) == payload and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert media.media_columns(no_docs).count() == 0
