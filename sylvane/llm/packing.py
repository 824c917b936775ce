"""Pattern packing by non-negative least squares.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece
lengths reaches the driver: at most ``capacity`` numbers, whatever the corpus. There,
few-document patterns (lengths that fill a sequence exactly) are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded, and what is
left goes into sequences by best fit on the histogram, run by run. The plan is a table of
slots: for each length, which ranks go to which sequences and offsets. Pieces find their
slot by their rank among pieces of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvane.frames import narrow
from sylvane.llm.batches import bound_batches
from sylvane.llm.tokens import load_encoder
from sylvane.session import ensure_checkpoint_dir

CAPACITY = 1024
#: Patterns that are enumerated at most: all pairs, then triples by their smallest length.
MOST_PATTERNS = 200_000
#: Weight of the lengths below capacity / SHORT in the fit; they are easy to place afterwards.
SHORT, SHORT_WEIGHT = 16, 0.25
#: Ways to round the fitted counts: what is added before cutting off, and the least count that is used.
ROUNDINGS = ((0.5, 1), (0.0, 1), (-1.0, 1), (0.0, 2), (0.0, 4), (0.0, 8), (0.0, 16), (0.0, 64))
#: Texts that are tokenized at once.
TEXTS = 64


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: a document's ids and its end id, cut from the back.

    ids is binary, little-endian unsigned 32-bit. Null or empty text: the end id alone.
    Documents of more than ``capacity`` ids give a first piece with what is over, then full
    pieces. Repeated rows give repeated pieces; an empty table gives none.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                row, piece, start, length, ids = [], [], [], [], []
                for i, found in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    found.append(end_id)
                    data, n = np.array(found, "<u4"), len(found)
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), ids.append(data[a:b].tobytes())
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def patterns(lengths: np.ndarray, capacity: int, slack: bool = False, most: int = MOST_PATTERNS) -> np.ndarray:
    """Pairs and triples of the given lengths that fill ``capacity``: rows of three, 0 for no document.

    With ``slack`` the last length is the largest there is that still fits, whether or not it
    fills the sequence.
    """
    largest = np.zeros(capacity + 1, np.int64)
    largest[lengths] = lengths
    if slack:
        largest = np.maximum.accumulate(largest)
    found, total = [np.zeros((0, 3), np.int64)], 0
    for a in [0, *lengths[lengths * 2 <= capacity].tolist()]:
        b = lengths[(lengths >= max(1, a)) & (lengths < capacity - a)]
        c = largest[capacity - a - b]
        fits = c >= b
        found.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], 1))
        total += int(fits.sum())
        if total >= most:
            break
    return np.concatenate(found)


def nnls(columns: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin over x >= 0 of |W (A x - target)|, by active sets (Lawson and Hanson).

    ``columns`` has the rows of A that each column adds one to (0: none). Columns that share
    no row enter together; what the least-squares solution makes negative leaves again. It
    ends when no column is short of half a document (or of 1e-5 of the largest target), after
    which rounding could not tell, or after ``rounds`` rounds with the solution so far.
    """
    m = len(target)
    w2 = np.where(np.arange(m) == 0, 0.0, weight**2)
    enough = max(0.5, 1e-5 * float(target.max(initial=0)))
    chosen, x = np.zeros(0, np.int64), np.zeros(0)
    a, gram = np.zeros((m, 0)), np.zeros((0, 0))
    left, inside = target.astype(float), np.zeros(len(columns), bool)
    for _ in range(rounds):
        gradient = (w2 * left)[columns].sum(1)
        gradient[inside] = 0
        best = np.argsort(-gradient)[:2048]
        used, enter = np.zeros(m, bool), []
        for c, g, rows in zip(best.tolist(), gradient[best].tolist(), columns[best].tolist()):
            if g <= enough or len(enter) >= 64:
                break
            if not any(used[r] for r in rows if r):
                used[[r for r in rows if r]] = True
                enter.append(c)
        if not enter:
            break
        new = np.zeros((m, len(enter)))
        for k in range(columns.shape[1]):
            np.add.at(new, (columns[enter, k], np.arange(len(enter))), 1.0)
        new[0] = 0
        across = a.T @ (new * w2[:, None])
        gram = np.block([[gram, across], [across.T, new.T @ (new * w2[:, None]) + 1e-9 * np.eye(len(enter))]])
        a, chosen, x = np.hstack([a, new]), np.concatenate([chosen, enter]), np.concatenate([x, np.zeros(len(enter))])
        while len(chosen):
            z = np.linalg.solve(gram, a.T @ (w2 * target))
            bad = z <= 0
            if not bad.any():
                x = z
                break
            step = float(np.min(x[bad] / (x[bad] - z[bad] + 1e-300)))
            x = x + step * (z - x)
            stay = ~(bad & (x <= 1e-9 + 1e-9 * enough)) & ~(bad & (z < -enough))
            if stay.all():
                stay = ~bad
            a, gram, chosen, x = a[:, stay], gram[np.ix_(stay, stay)], chosen[stay], np.maximum(x[stay], 0)
        inside[:] = False
        inside[chosen] = True
        left = target - a @ x
    out = np.zeros(len(columns))
    out[chosen] = x
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on a histogram: (repeats, {length: times}) of the sequences.

    A run of equal lengths is placed at once, just where one by one would put it: into the
    fullest sequences that still take it, each as often as it fits, then into new ones.
    """
    spaces: list[int] = []
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(n: int, made: dict[int, int], space: int) -> None:
        if n:
            if space not in groups:
                insort(spaces, space)
                groups[space] = []
            groups[space].append((n, made))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                n, made = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            else:
                space, made, n = capacity, {}, left
            fit = space // length
            whole = min(n, left // fit)
            put(whole, made | {length: fit}, space - fit * length)
            left -= whole * fit
            n -= whole
            if left and left < fit and n:
                put(1, made | {length: left}, space - left * length)
                n, left = n - 1, 0
            if made:
                put(n, made, space)
    return [group for space in spaces for group in groups[space]]


def _rounded(x: np.ndarray, columns: np.ndarray, counts: np.ndarray, up: float, least: int) -> list[tuple[int, dict[int, int]]]:
    """Repeat counts in whole numbers, as far as documents are there, then best fit of the rest."""
    made: list[tuple[int, dict[int, int]]] = []
    counts = counts.copy()
    for c in np.argsort(-x, kind="stable"):
        if x[c] + up < least:
            break
        times: dict[int, int] = {}
        for length in columns[c][columns[c] > 0].tolist():
            times[length] = times.get(length, 0) + 1
        n = min(int(x[c] + up), *(int(counts[k]) // v for k, v in times.items()))
        if n:
            made.append((n, times))
            for k, v in times.items():
                counts[k] -= n * v
    return made + best_fit(counts, len(counts) - 1)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: times}) of all sequences for the given number of pieces of each length.

    The fitted counts are rounded in a few ways; the one with the fewest sequences is taken.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    weight = np.where(np.arange(capacity) * SHORT < capacity, SHORT_WEIGHT, 1.0)
    ways, tried = [], None
    for slack in (False, True):
        columns = patterns(np.flatnonzero(counts[:capacity]), capacity, slack)
        if tried is None or not np.array_equal(columns, tried):
            x = nnls(columns, counts[:capacity], weight)
            ways += [_rounded(x, columns, counts, up, least) for up, least in ROUNDINGS]
        tried = columns
    return min(ways, key=lambda made: sum(n for n, _ in made))


def slots(made: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, sequences from, times in a sequence, offset), sorted."""
    rows, next_rank, sequence = [], {}, 0
    for n, times in made:
        offset = 0
        for length, k in sorted(times.items(), reverse=True):
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, k, offset))
            next_rank[length] = rank + n * k
            offset += k * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; columns doc_id, piece and length are used, the others kept.

    ``pieces`` is read several times: give a checkpoint or a table. A length that many
    pieces share is ranked in salted parts: counts of the parts are added up, then each
    part counts on from there, so no task holds more than its part.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(plan(histogram, capacity))
    parts = max(64, sum(histogram.values()) // 4096)
    keyed = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    firsts = firsts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("__own", F.row_number().over(own)).join(firsts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__own") - 1)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = shared.value
        keys = (rows[:, 0] << 40) | rows[:, 1]
        slot = rows[np.searchsorted(keys, (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64), "right") - 1]
        own, times = rank.to_numpy(np.int64) - slot[:, 1], slot[:, 3]
        return pd.DataFrame({"sequence_id": slot[:, 2] + own // times, "offset": slot[:, 4] + own % times * length.to_numpy(np.int64)})

    placed = ranked.withColumn("__at", place("length", "__rank"))
    return placed.select(*[F.col(c) for c in pieces.columns], "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """All documents in sequences: the pieces of :func:`token_pieces` with their places.

    With ``digest`` the ids leave as their CRC-32 (``ids_crc32``) before anything is shuffled.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    if digest:
        pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces.checkpoint(), capacity)
