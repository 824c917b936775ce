"""SentencePiece BPE models: encoding with byte offsets into the original text, and decoding.

The model file is read here, without the library. Normalisation follows the compiled
character map: at each position the longest key of its double-array trie is replaced, and
every normalised byte records the original byte it came from; pieces, which are spans of
normalised bytes, are projected back through that record. Segmentation merges the best
scored pair until none is left. No piece joins a letter to a following space mark, so texts
are cut before each run of marks and each cut is segmented once and remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvane.frames import narrow
from sylvane.llm.batches import bound_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segmented cuts that a task remembers, in two generations, and the characters of the longest; longer ones are segmented anew.
MEMO, MEMO_LENGTH = 800_000, 64
#: The rank of a pair that makes no piece.
NO_PIECE = 1 << 60


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


class CharacterMap:
    """A compiled character map: double-array trie, then the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for n in range(at, len(text)):
            node ^= text[n]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[n]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


def _cut_pattern(pieces: dict[str, int]) -> str:
    """A pattern of cuts that no piece reaches across, as far as these pieces allow.

    Before each run of marks, if marks only lead in pieces, and around line feeds, if no longer piece has one.
    """
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return "(?s).+"
    feed = "" if any("\n" in p for p in pieces if len(p) > 1) else "\n"
    return "|".join([*([feed] if feed else []), f"{MARK}*[^{MARK}{feed}]+", f"{MARK}+"])


class Encoded:
    """Ids of a text with the original byte span of each."""

    __slots__ = ("begins", "ends", "ids")

    def __init__(self, ids: list[int], begins: np.ndarray, ends: np.ndarray):
        self.ids, self.begins, self.ends = ids, begins, ends


class PieceModel:
    """Encoder and decoder of a BPE model file."""

    def __init__(self, path: str):
        self.prefix = self.strip = self.escape = True
        self.map: CharacterMap | None = None
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        kind_of_model, spec = 1, {}
        with open(path, "rb") as file:
            data = file.read()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(fields(value)).get(3, 1)
            elif number == 3:  # a message that comes in parts is merged
                spec |= dict(fields(value))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.strip, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind_of_model != 2 or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models without user-defined or unused pieces")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        order = {v: i for i, v in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        self.rank = {p: order[-self.scores[i]] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_values = {i: b for b, i in self.bytes.items()}
        self.lengths = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)], np.int64)
        #: Bytes of the original text in each piece, where every mark in it stands for a space.
        self.source_lengths = self.lengths - 2 * np.array([0 if k == BYTE else p.count(MARK) for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.shown = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else None if k == BYTE else p.replace(MARK, " ") for p, k in zip(self.pieces, self.kinds)]
        self.cut = re.compile(_cut_pattern(self.ids))
        self.memo: dict[str, tuple[int, ...]] = _Memo(self.segment)

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and its end, the original byte offset.

        No array is made where the two differ by the prefix and by space marks only; then
        :meth:`spans` finds the offsets from the text itself.
        """
        if not text:
            return "", None
        if self.map is None and not self.strip and self.escape:
            return (MARK if self.prefix else "") + text.replace(" ", MARK), None
        data, at = text.encode(), 0
        out: list[bytes] = []
        origin: list[int] = []
        space = MARK.encode() if self.escape else b" "

        def step(i: int) -> tuple[int, bytes]:
            hit = self.map.longest(data, i) if self.map else None
            if hit:
                return hit
            lead = data[i]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, data[i : i + n]

        if self.strip:
            while at < len(data):
                n, piece = step(at)
                if piece != b" ":
                    break
                at += n
            if at == len(data):
                return "", None
        if self.prefix:
            out.append(space)
            origin += [at] * len(space)
        after_space = self.strip
        while at < len(data):
            n, piece = step(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space)
                out.append(shown)
                origin += [at] * len(shown)
                after_space = self.strip and piece.endswith(b" ")
            at += n
        end = len(data)
        if self.strip:
            joined = b"".join(out)
            while joined.endswith(space):
                joined = joined[: -len(space)]
                end = origin[len(joined)]
                del origin[len(joined) :]
            return joined.decode(), np.array([*origin, end], np.int64)
        return b"".join(out).decode(), np.array([*origin, end], np.int64)

    def segment(self, cut: str) -> tuple[int, ...]:
        """Ids of a normalised cut: the best-scored adjacent pair, leftmost first, is merged until none is a piece."""
        symbols, rank = list(cut), self.rank.get
        if len(symbols) <= 64:
            pairs = [rank(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
            while pairs and (best := min(pairs)) != NO_PIECE:
                i = pairs.index(best)
                joined = symbols[i] + symbols.pop(i + 1)
                symbols[i] = joined
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank(joined + symbols[i + 1], NO_PIECE)
                if i:
                    pairs[i - 1] = rank(symbols[i - 1] + joined, NO_PIECE)
        else:
            symbols = self._segment_long(symbols)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def _segment_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for long cuts."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := rank.get(symbols[i] + symbols[after[i]])) is not None:
                    heappush(heap, (r, i, symbols[i], symbols[after[i]]))
            if before[i] >= 0 and (r := rank.get(symbols[before[i]] + symbols[i])) is not None:
                heappush(heap, (r, before[i], symbols[before[i]], symbols[i]))
        return [s for s in symbols if s]

    def encode_ids(self, text: str) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO // 2:
            memo.turn()
        return list(chain.from_iterable(map(memo.__getitem__, self.cut.findall(self.normalise(text)[0]))))

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, in bytes of the original text, of every piece.

        Neighbours share their border, so the spans of a text cover all of it. A piece whose
        bytes all come from the prefix has an empty span.
        """
        if self.map is None and not self.strip and self.escape and self.unknown not in ids and MARK not in text:
            # the plain case: only spaces became marks, so the pieces' own lengths say it all
            ends = np.maximum(np.cumsum(self.source_lengths[np.array(ids, np.int64)]) - int(self.prefix), 0)
            return np.concatenate([[0], ends[:-1]]) if ids else ends, ends
        ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
        _, origin = self.normalise(text)
        if origin is None and ids:
            data = np.frombuffer(text.encode(), np.uint8)
            marks = data == 32
            # a space is one byte before and three after; what stands between is moved by twice the spaces so far
            at = np.arange(len(data)) + 2 * (np.cumsum(marks) - marks) + (3 if self.prefix else 0)
            ends = np.searchsorted(at, ends)
            ends[-1] = len(data)
        elif ids:
            ends = origin[np.minimum(ends, len(origin) - 1)]
            ends[-1] = len(text.encode())
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)

    def encode(self, text: str) -> Encoded:
        ids = self.encode_ids(text)
        return Encoded(ids, *self.spans(text, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the prefix goes, runs of byte pieces are read as UTF-8."""
        parts = list(map(self.shown.__getitem__, ids))
        if None in parts:
            out: list[str] = []
            run = bytearray()
            for i, part in zip(ids, parts):
                if part is None:
                    run.append(self.byte_values[i])
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(part)
            if run:
                out.append(_utf8(bytes(run)))
            parts = out
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
        whole = "".join(parts)
        if (self.prefix or self.strip) and first is not None and self.kinds[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(MARK):
            whole = whole.lstrip(" ") if self.strip else whole[1:]
        return whole


codecs.register_error("sylvane.each", lambda wrong: ("�", wrong.start + 1))


def _utf8(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that is part of no character."""
    return data.decode(errors="sylvane.each")


class _Memo(dict):
    """Values by key, computed once; the generation before the current one is still looked up."""

    def __init__(self, function):
        super().__init__()
        self.function, self.before = function, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= MEMO_LENGTH:
            self[key] = value
        return value

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


#: What :func:`encode_documents` can return beside doc_id.
COLUMNS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "begins": "array<bigint>",
    "ends": "array<bigint>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "spans_sha256": "string",
}
TYPES = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "string": pa.string()}


def encode_documents(
    docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and the asked columns (see ``COLUMNS``), one row for each row of the input.

    begins and ends are byte offsets into the text's UTF-8. ids_sha256 is of the decimal ids
    joined by commas, decoded_sha256 of the decoded text, spans_sha256 of the ends as signed
    64-bit little-endian numbers (a piece begins where the one before it ends), all lowercase
    hex. Null counts as empty: no ids. Texts of any length are encoded whole; a very long one
    without spaces or line feeds is one cut, segmented with a heap. Of pairs with equal scores
    the leftmost is merged first. Repeated rows give repeated results; further columns are
    not read; an empty table gives none.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(docs.sparkSession)

    def one(model: PieceModel, text: str) -> tuple:
        ids = model.encode_ids(text)
        begins, ends = model.spans(text, ids)
        if len(ends) and (ends[-1] != len(text.encode()) or (np.diff(ends) < 0).any()):
            raise AssertionError("the pieces' spans don't cover the text")
        made = {"n_tokens": len(ids), "ids": ids, "begins": begins, "ends": ends}
        if "spans_sha256" in columns:
            made["spans_sha256"] = hashlib.sha256(np.asarray(ends, "<i8").tobytes()).hexdigest()
        if "ids_sha256" in columns:
            made["ids_sha256"] = hashlib.sha256(",".join(map(model.names.__getitem__, ids)).encode()).hexdigest()
        if "decoded" in columns or "decoded_sha256" in columns:
            made["decoded"] = model.decode(ids)
            made["decoded_sha256"] = hashlib.sha256(made["decoded"].encode()).hexdigest()
        return tuple(made[c] for c in columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = list(zip(*[one(model, t or "") for t in part.column(1).to_pylist()]))
                made = [pa.array(values, TYPES[COLUMNS[c]]) for c, values in zip(columns, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))
