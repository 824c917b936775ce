"""Context-tree weighting over bytes, learned from a corpus and then fixed.

A byte is eight binary decisions, each at one of the 255 nodes that the bits before it name. Each
decision has a context tree over the ``DEPTH`` bytes before it. Every node estimates its decision
with Krichevsky and Trofimov's rule from its counts; bottom up, a node's weighted probability
is the mean of its own estimate's and of the product of its children's, and the ratio of the
two says how much a context trusts itself against the deeper ones. All depths are mixed so, down
to the deepest context in which the decision was met.

Only decisions that were met are stored, and all of them are: no context is dropped or merged, so
the trees grow with the corpus. Subtrees from depth 3 down are made in the cluster, each whole in
one bucket of contexts; the driver has the nodes of depths 0 to 2, at most 255 for each pair of bytes.

A bucket is one row of packed arrays. Its counts, and later the contexts whose probabilities
documents ask for, pass through a task as a stream; what a task holds is the bucket's distinct
contexts, which more buckets make fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of context; with the byte itself they fit in 64 bits up to a depth of 7.
DEPTH = 5
#: The byte that ends a text and precedes it; it is no part of UTF-8.
END = 255
#: Binary decisions of a byte.
LEVELS = 8


def grams(data: bytes) -> np.ndarray:
    """A code for each byte of the text and its end: the byte below those before it, the nearest lowest."""
    values = np.frombuffer(bytes([END] * DEPTH) + data + bytes([END]), np.uint8)
    n = len(values) - DEPTH
    code = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        code = (code << np.uint64(8)) | values[i : i + n]
    return code


def counted(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs (or the sum of its ``times``)."""
    if times is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    if times is None:
        return codes[first], np.diff(np.concatenate([first, [len(codes)]]))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series above 8 and the recurrence below."""
    x = x.astype(float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift += np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = x + low
    inverse = 1 / x
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


#: ln Gamma(n + 1/2) and ln Gamma(n + 1) of small whole numbers.
_SMALL = 1 << 16
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))]) + 0.5 * np.log(np.pi)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _gamma_of(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    n = n.astype(np.int64)
    out = table[np.minimum(n, _SMALL - 1)]
    large = np.flatnonzero(n >= _SMALL)
    if len(large):
        out[large] = log_gamma(n[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _gamma_of(zeros, _HALVES, 0.5) + _gamma_of(ones, _HALVES, 0.5) - _gamma_of(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


def step_of(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of a doubling."""
    return np.floor(np.log2(n) * 8).astype(np.int64)


def least_of(histogram: list[tuple[int, int]], most: int) -> int:
    """The least count such that at most ``most`` have it or more, from (step, how many) of a scale as in :func:`step_of`."""
    total, least = 0, None
    for step, n in sorted(histogram, reverse=True):
        if total + n > most:
            break
        total, least = total + n, step
    return int(np.ceil(2 ** (least / 8) - 1e-9)) if least is not None else (1 << 62)


def frequent(counts: DataFrame, n: str, most: int) -> int:
    """The least value of ``n`` such that at most ``most`` rows have it or more, to an eighth of a doubling."""
    step = F.floor(F.log2(F.col(n)) * 8).cast("int")
    return least_of([(r["step"], r["rows"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()], most)


def tree_order(codes: np.ndarray) -> np.ndarray:
    """Codes with the nearest byte of the context first and the byte itself last: a subtree is a range of them."""
    out = codes & np.uint64(255)
    for i in range(1, DEPTH + 1):
        out |= ((codes >> np.uint64(8 * i)) & np.uint64(255)) << np.uint64(8 * (DEPTH + 1 - i))
    return out.astype(np.int64)


def buckets_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each code, by the three nearest bytes of its context."""
    near = (codes >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _nodes(codes: np.ndarray, times: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, zeros, ones) of the decisions met at this level; a key is the context and the bits before the decision."""
    keys = codes >> (LEVELS - level)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0), np.zeros(0)
    ones = np.add.reduceat(times * ((codes >> (LEVELS - 1 - level)) & 1), first)
    return keys[first], (np.add.reduceat(times, first) - ones).astype(float), ones.astype(float)


def _parent(keys: np.ndarray, level: int) -> np.ndarray:
    """The keys without the farthest byte of the context."""
    return ((keys >> (8 + level)) << level) | (keys & ((1 << level) - 1))


def _named(keys: np.ndarray, level: int) -> np.ndarray:
    """Keys that tell levels apart: the context above the number of the node, from 1 to 255."""
    return ((keys >> level) << 8) | (1 << level) | (keys & ((1 << level) - 1))


def _trust(own: np.ndarray, product: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(product - own, -700, 700)))


class Tier(NamedTuple):
    """Decisions of one level in contexts of one length."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    product: np.ndarray | None  # of the children, as a logarithm; none at the deepest
    above: np.ndarray | None  # the place of the parent among the keys of the tier before

    def weighted(self) -> np.ndarray:
        return self.own if self.product is None else np.logaddexp(self.own, self.product) - np.log(2)


def _lower(codes: np.ndarray, times: np.ndarray) -> Iterator[list[Tier]]:
    """The tiers of depths 3 to ``DEPTH`` of a bucket, for each level, from its sorted codes in tree order and their counts."""
    codes, times = codes[times > 0], times[times > 0]
    by_depth = [(codes, times)]
    for _ in range(DEPTH - 3):
        by_depth.append(counted(((by_depth[-1][0] >> 16) << 8) | (by_depth[-1][0] & 255), by_depth[-1][1]))
    for level in range(LEVELS):
        tiers: list[Tier] = []
        for codes, times in by_depth:
            keys, zeros, ones = _nodes(codes, times, level)
            product = None
            if tiers:
                above = np.searchsorted(keys, _parent(tiers[-1].keys, level))
                product = np.bincount(above, tiers[-1].weighted(), len(keys))
                tiers[-1] = tiers[-1]._replace(above=above)
            tiers.append(Tier(keys, zeros, ones, log_kt(zeros, ones), product, None))
        yield tiers[::-1]


def contributions(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones, product) that a bucket adds to decisions in contexts of two bytes."""
    made = []
    for level, (first, *_) in enumerate(_lower(codes, times)):
        keys, at = np.unique(_parent(first.keys, level), return_inverse=True)
        sums = [np.bincount(at, v, len(keys)) for v in (first.zeros, first.ones, first.weighted())]
        made.append((_named(keys, level), *sums))
    return tuple(np.concatenate([m[i] for m in made]) for i in range(4))


class Upper(NamedTuple):
    """Decisions in contexts of up to two bytes."""

    keys: list[np.ndarray]  # by depth, each sorted
    final: list[np.ndarray]  # probability of 1 where no deeper context has met the decision
    mixed: np.ndarray  # what depths 0 to 2 give to the mixture of a deeper context
    rest: np.ndarray  # and the weight that they leave to it


def upper(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> Upper:
    """The upper tree from the sums of all buckets' contributions; ``keys`` are distinct."""
    order = np.argsort(keys)
    keys, zeros, ones, product = keys[order], zeros[order], ones[order], product[order]
    tiers = []
    for depth in (2, 1, 0):
        own = log_kt(zeros, ones)
        trust, estimate, weighted = _trust(own, product), (ones + 0.5) / (zeros + ones + 1), np.logaddexp(own, product) - np.log(2)
        near, at = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
        tiers.append((keys, trust, estimate, at))
        if depth:
            keys, zeros, ones, product = near, *(np.bincount(at, v, len(near)) for v in (zeros, ones, weighted))
    names, final = [], []
    mixed, rest = np.zeros(len(keys)), np.ones(len(keys))
    for depth, (keys, trust, estimate, at) in enumerate(tiers[::-1]):
        if depth:
            mixed, rest = mixed[at], rest[at]
        names.append(keys)
        final.append(mixed + rest * estimate)
        mixed, rest = mixed + rest * trust * estimate, rest * (1 - trust)
    return Upper(names, final, mixed, rest)


def log_probabilities(codes: np.ndarray, times: np.ndarray, above: Upper) -> np.ndarray:
    """log10 of each byte's probability after its context: sorted codes in tree order; a count may be 0."""
    out = np.zeros(len(codes))
    for level, tiers in enumerate(_lower(codes, times)):
        at = np.searchsorted(above.keys[2], _named(_parent(tiers[0].keys, level), level))
        mixed, rest = above.mixed[at], above.rest[at]
        finals = []  # the probability of 1 where no deeper context has met the decision
        for depth, t in enumerate(tiers):
            if depth:
                mixed, rest = mixed[t.above], rest[t.above]
            estimate = (t.ones + 0.5) / (t.zeros + t.ones + 1)
            finals.append(mixed + rest * estimate)
            if t.product is not None:
                trust = _trust(t.own, t.product)
                mixed, rest = mixed + rest * trust * estimate, rest * (1 - trust)
        one = np.full(len(codes), 0.5)
        left = np.arange(len(codes))
        wanted = codes >> (LEVELS - level)
        for depth in range(DEPTH, -1, -1):
            keys, values = (tiers[depth - 3].keys, finals[depth - 3]) if depth > 2 else (above.keys[depth], above.final[depth])
            if len(keys) and len(left):
                sought = wanted if depth > 2 else _named(wanted, level)
                place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                hit = keys[place] == sought
                one[left[hit]] = values[place[hit]]
                left, wanted = left[~hit], wanted[~hit]
            wanted = _parent(wanted, level)
        one = np.clip(one, 1e-15, 1 - 1e-15)
        out += np.log10(np.where((codes >> (LEVELS - 1 - level)) & 1, one, 1 - one))
    return out


def packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of rows in order of buckets: its distinct codes in order and the sums of their counts."""
    now: int | None = None
    codes, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        return counted(*(np.concatenate(x) for x in zip((codes, times), *waiting)))

    for batch in batches:
        for bucket, c, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if now is not None and bucket != now:
                codes, times = added()
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *packed(codes, times)], ["bucket", "codes", "times"])
                codes, times, waiting = codes[:0], times[:0], []
            now = bucket
            waiting.append((np.frombuffer(c.as_py(), np.uint64), np.frombuffer(t.as_py(), np.int64)))
            if sum(len(x) for x, _ in waiting) > max(1 << 20, len(codes)):
                codes, times = added()
                waiting = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *packed(*added())], ["bucket", "codes", "times"])


def in_buckets(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of a bucket together, in one partition."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", *order)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bucket, codes, counts, places in tree order, codes in tree order) of each bucket."""
    for batch in batches:
        for bucket, codes, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            codes, times = np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(times.as_py(), np.int64)
            ordered = tree_order(codes)
            order = np.argsort(ordered)
            yield bucket, codes, times, order, ordered[order]


def learn(partial: DataFrame) -> DataFrame:
    """``(bucket, codes, times, logs)`` of ``(bucket, codes, times)``: all codes, with log10 of their bytes' probabilities.

    Codes are as :func:`grams` makes them, in order; all three are packed arrays. Codes with
    count 0 are priced, but not learned from.
    """
    spark = partial.sparkSession
    trees = in_buckets(partial).mapInArrow(merged, "bucket int, codes binary, times binary").checkpoint()

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, times, order, ordered in _buckets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contributions(ordered, times[order])], ["key", "zeros", "ones", "product"])

    sums = trees.mapInArrow(rise, "key bigint, zeros double, ones double, product double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "product")])
    found = sums.toArrow()  # 255 rows for each pair of bytes at most
    above = upper(*[found.column(c).to_numpy() for c in ("key", "zeros", "ones", "product")])
    shared = spark.sparkContext.broadcast(tuple(above))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = Upper(*shared.value)
        for bucket, codes, times, order, ordered in _buckets(batches):
            logs = np.zeros(len(codes))
            logs[order] = log_probabilities(ordered, times[order], above)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *packed(codes, times, logs)], ["bucket", "codes", "times", "logs"])

    return trees.mapInArrow(fall, "bucket int, codes binary, times binary, logs binary")


def head_of(trees: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, counts, logs) of the most frequent codes, ``most`` at most, and the count that the rest is below."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times in batch.column(0):
                times = np.frombuffer(times.as_py(), np.int64)
                step, n = np.unique(step_of(times[times > 0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    histogram = trees.select("times").mapInArrow(scale, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n"))
    least = least_of([tuple(r) for r in histogram.collect()], most)  # 8 steps for each doubling

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, times, logs in zip(*batch.columns):
                codes, times, logs = np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(times.as_py(), np.int64), np.frombuffer(logs.as_py(), np.float64)
                kept = times >= least
                yield pa.RecordBatch.from_arrays(packed(codes[kept], times[kept], logs[kept]), ["codes", "times", "logs"])

    found = trees.select("codes", "times", "logs").mapInArrow(chosen, "codes binary, times binary, logs binary").toArrow()  # ``most`` codes at most
    whole = [np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("codes", np.uint64), ("times", np.int64), ("logs", np.float64))]
    order = np.argsort(whole[0])
    return (*(x[order] for x in whole), least)


class Head:
    """The logs of the broadcast codes: a table in which the more frequent code has the slot, then a search."""

    BITS = 20

    def __init__(self, codes: np.ndarray, times: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs
        by_times = np.argsort(times, kind="stable")
        slots = np.zeros(1 << self.BITS, np.int64)
        slots[self._slot(codes[by_times])] = by_times
        if len(codes):
            self.slot_codes, self.slot_logs = codes[slots], logs[slots]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).view(np.int64)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each code, 0 where it is not here; and the places of those that are not."""
        if not len(self.codes):
            return np.zeros(len(codes)), np.arange(len(codes))
        slot = self._slot(codes)
        logs = self.slot_logs[slot]
        other = np.flatnonzero(self.slot_codes[slot] != codes)
        asked, back = np.unique(codes[other], return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        here = self.codes[at] == asked
        logs[other] = np.where(here, self.logs[at], 0.0)[back]
        return logs, other[~here[back]]
