import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvane.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@given(text=st.text(max_size=120) | st.text("ab ▁\n\té日", max_size=60))
@settings(max_examples=500, deadline=None)
def test_as_the_library(model, library, text):
    found = model.encode(text)
    assert found.ids == library.encode(text)
    assert model.decode(found.ids) == library.decode(found.ids)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(found.begins, found.ends)) == raw


@given(ids=st.lists(st.integers(0, 31_999) | st.integers(3, 258), max_size=12))
@settings(max_examples=500, deadline=None)
def test_decoding_any_ids(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_long_cuts(model, library):
    for text in ("x" * 5000, "日本" * 2000, " " * 3000 + "a", "abab" * 1000):
        assert model.encode_ids(text) == library.encode(text)


def test_spans_are_those_of_the_library(model, library):
    text = "Hello  wörld, the naïve café ▁x"
    found = model.encode(text)
    expected = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
    whole = [i for i in range(len(found.ids)) if model.kinds[found.ids[i]] != pieces.BYTE]
    assert [(found.begins[i], found.ends[i]) for i in whole] == [expected[i] for i in whole]


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map for keys of any bytes: a small double array, built by first fit."""
    blob, at = b"", {}
    for value in rules.values():
        at[value] = len(blob)
        blob += value + b"\0"
    units: dict[int, int] = {}
    bases: set[int] = set()

    def place(index: int, keys: list[tuple[bytes, int]]) -> None:
        branches = sorted({k[0] if k else 0 for k, _ in keys})
        offset = 1
        while (index ^ offset) in bases or any((index ^ offset ^ b) in units for b in branches):
            offset += 1
        bases.add(index ^ offset)
        ends = [v for k, v in keys if not k]
        units[index] = (units.get(index, 0)) | (offset << 10) | (256 if ends else 0)
        for b in branches:
            units[index ^ offset ^ b] = (ends[0] | 1 << 31) if b == 0 and ends else b
        for b in branches:
            rest = [(k[1:], v) for k, v in keys if k and k[0] == b]
            if rest:
                place(index ^ offset ^ b, rest)

    place(0, [(k, at[v]) for k, v in rules.items()])
    table = [units.get(i, 0) for i in range(max(units) + 1)]
    return struct.pack("<I", 4 * len(table)) + struct.pack(f"<{len(table)}I", *table) + blob


def test_longest_prefix_normalisation_keeps_the_alignment(model):
    rules = {"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"", b"abc": b"X", "é".encode(): b"e"}
    own = pieces.PieceModel(PATH)
    own.map = pieces.CharacterMap(compiled(rules))
    text, origin = own.normalise("abcabaﬁé z")
    assert text == "▁XAfie▁z"
    data = "abcabaﬁé z".encode()
    assert origin.tolist() == [0, 0, 0, 0, 5, 6, 6, 9, 11, 11, 11, 12, len(data)]
    found = own.encode("abcabaﬁé z")
    assert found.ends[-1] == len(data) and all(a <= b for a, b in zip(found.begins, found.ends))
    own.strip = True
    assert own.normalise("   a   b  ")[0] == "▁A▁b"


def ends_of(library, text):
    """Byte ends of all pieces: the library's own, but for byte pieces, of which each stands for one byte of its character."""
    found = library.encode(text, return_type="proto").pieces
    ends: list[int] = []
    raw, at, i = text.encode(), 0, 0
    while i < len(found):
        run = i
        while run < len(found) and found[run].piece.startswith("<0x") and library.is_byte(found[run].id):
            run += 1
        if run > i:
            ends += range(at + 1, at + run - i + 1)
            at += run - i
            i = run
            continue
        after = sum(len(p.surface.encode()) for p in found[i : i + 1])
        at += after
        ends.append(at)
        i += 1
    if ends:
        ends[-1] = len(raw)
    return ends


def test_a_model_with_a_character_map(tmp_path):
    """End to end: the library reads the same file, with a map of more than one byte a key and other settings of spaces."""
    rules = {"ﬁ".encode(): b"fi", "Ä".encode(): b"Ae", b"\t": b" ", b"ab": b"x", b"abc": b"", "é".encode(): b"e", "　".encode(): b" ", b"Q": "日本".encode()}
    blob = compiled(rules)
    size = struct.unpack_from("<I", blob)[0]
    padded = -size % 1024
    blob = struct.pack("<I", size + padded) + blob[4 : 4 + size] + bytes(padded) + blob[4 + size :]

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        n, out = len(value), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return bytes([number << 3 | 2]) + out + bytes([n]) + value

    with open(PATH, "rb") as file:
        given = file.read()
    for prefix, strip in ((1, 0), (0, 0), (1, 1)):
        path = tmp_path / f"mapped{prefix}{strip}.model"
        path.write_bytes(given + field(3, field(2, blob) + field(3, prefix) + field(4, strip)))
        own, other = pieces.PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
        assert own.map is not None
        for text in ("ﬁne Äpfel\tabcab é", "abc", "  ab　 Q Q  ", "plain words", "Qabcé" * 50, "", "ﬁ", "日Q\n\tab"):
            found = own.encode(text)
            assert found.ids == other.encode(text), (text, prefix, strip)
            assert own.decode(found.ids) == other.decode(found.ids)
            raw = text.encode()
            assert not found.ids or b"".join(raw[a:b] for a, b in zip(found.begins, found.ends)) == raw
            whole = [(p.begin, p.end) for p in other.encode(text, return_type="proto").pieces]
            for k, (a, b) in enumerate(whole):
                if own.kinds[found.ids[k]] != pieces.BYTE and 0 < k < len(whole) - 1:
                    assert found.ends[k] == b, (text, k)


def test_many_stray_bytes_and_very_long_texts(model, library):
    ids = [model.bytes[0xE6]] * 5000 + [model.bytes[b] for b in "本".encode()] + [model.bytes[0x80]] * 5000
    assert model.decode(ids) == library.decode(ids)
    for text in ("日本" * 200_000, "x" * 1_000_000, "\n" * 1_000_000, " " * 1_000_000, "ab c\n" * 200_000):
        found = model.encode(text)
        assert found.ids == library.encode(text) and found.ends[-1] == len(text.encode())
    assert max(map(len, model.memo), default=0) <= pieces.MEMO_LENGTH


def test_documents(spark, library, odd_docs, odd_rows, no_docs):
    columns = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for d, t, *_ in odd_rows:
        ids = library.encode(t or "")
        ends = ends_of(library, t or "")
        assert len(ends) == len(ids)
        expected.append((-1 if d is None else d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), hashlib.sha256(struct.pack(f"<{len(ends)}q", *ends)).hexdigest()))
    found = pieces.encode_documents(odd_docs, PATH, columns).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == sorted(expected)
    assert pieces.encode_documents(no_docs, PATH).count() == 0
    spans = pieces.encode_documents(odd_docs, PATH).where("doc_id = 4").first()
    assert (spans["begins"], spans["ends"], spans["decoded"]) == ([0, 3], [3, 9], "two words")
