"""Quality scores from pairwise preferences (Bradley and Terry).

A document's worth is a weighted sum of its features; that one of a pair is preferred has the
logistic probability of the difference of their worths. The weights minimise the logistic
loss over pairs of a good and a bad document. The threshold is a quantile of worth: the share
of bad documents among those learned from. Worth is mapped to (0, 1) so that this quantile
falls on the contract's decision score.

All labelled rows that are not held out are learned from, wherever they lie: rows get ranks by
id, chunks of pairs are made by rank, and each Newton step adds up their sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow
from sylvane.llm.batches import bound_batches, map_batches
from sylvane.session import ensure_checkpoint_dir

#: Parts of the range of hashes that are counted to find the least ones.
HASH_BINS = 4096
#: Preferred documents that each other one is compared with, or more, so that each preferred one is in a pair.
PARTNERS = 20
#: Pairs whose differences meet in one chunk.
CHUNK = 1 << 13
RIDGE = 1e-3
#: The score at the quantile of worth that separates.
DECISION = 0.3

FEATURES = (
    "log_words",
    "symbols",
    "symbol_words",
    "bangs",
    "upper",
    "digits",
    "pipes",
    "punctuation",
    "distinct",
    "repeats",
    "word_length",
    "long_words",
    "short_words",
    "line_length",
    "ended_lines",
    "repeated_lines",
    "top_word",
    "non_ascii",
)
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~_=+@]")
_SYMBOL_WORD = re.compile(r"[#*$%&|<>]{2,}(?:\s|$)|(?:^|\s)[|#*]+(?=\s)")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")
_PUNCTUATION = re.compile(r"[.,;:?]")


def features(text: str) -> list[float]:
    """The features of a text, as shares or bounded logarithms; an empty text gives zeros."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda k, of: min(1.0, k / max(1, of))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    upper = len(_UPPER.findall(text))
    return [
        np.log1p(n) / 10,
        share(len(_SYMBOL.findall(text)), chars) ** 0.5,
        share(len(_SYMBOL_WORD.findall(text)), n) ** 0.5,
        share(text.count("!!"), n) ** 0.5,
        share(upper, len(_LETTER.findall(text))) ** 0.5,
        share(len(_DIGIT.findall(text)), chars) ** 0.5,
        share(text.count("|"), n) ** 0.5,
        share(len(_PUNCTUATION.findall(text)), n),
        len(counts) / n,
        share(sum(a == b for a, b in zip(words, words[1:])), n) ** 0.5,
        min(20.0, sum(lengths) / n) / 20,
        share(sum(k > 20 for k in lengths), n),
        share(sum(k <= 2 for k in lengths), n),
        np.log1p(chars / max(1, len(lines))) / 10,
        share(sum(x.rstrip().endswith((".", "!", "?", "…", '"', "”")) for x in lines), len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n,
        share(len(text) - len(text.encode("ascii", "ignore")), chars),
    ]


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [features(t or "") for t in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)``, one row for each row of the input; null text counts as empty."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return map_batches(rows, _features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def features_column(text: Column) -> Column:
    """The feature array of a text column, for use inside a row; null text counts as empty."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else "") for t in texts])

    return made(text)


class Model(NamedTuple):
    """Worth is the weighted sum of (x - centre) / scale; threshold and slope map it to a score."""

    weights: list[float]
    centre: list[float]
    scale: list[float]
    threshold: float
    slope: float

    def worth(self, x: Column) -> Column:
        """The worth of a feature array."""
        per_feature = [w / s for w, s in zip(self.weights, self.scale)]
        offset = sum(w * c for w, c in zip(per_feature, self.centre))
        return sum((F.lit(w) * F.get(x, F.lit(i)) for i, w in enumerate(per_feature)), F.lit(-offset))

    def score(self, x: Column) -> Column:
        """The score of a feature array: DECISION at the threshold, growing with worth."""
        log_odds = F.lit(self.slope) * (self.worth(x) - F.lit(self.threshold)) + F.lit(float(np.log(DECISION / (1 - DECISION))))
        return 1 / (1 + F.exp(-F.greatest(F.least(log_odds, F.lit(30.0)), F.lit(-30.0))))


def pair_sums(difference: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient of minus the log likelihood of these pairs, then its Hessian by rows, then how many they are."""
    p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
    hessian = (difference * (p * (1 - p))[:, None]).T @ difference
    return np.concatenate([-(difference * p[:, None]).sum(0), hessian.ravel(), [len(difference)]])


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float) -> np.ndarray:
    """Newton steps on the mean logistic loss with a ridge; ``sums`` gives :func:`pair_sums` over all pairs."""
    w = np.zeros(width)
    for _ in range(50):
        found = sums(w)
        gradient, hessian = found[:width] / found[-1] + ridge * w, found[width:-1].reshape(width, width) / found[-1] + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, partners: int = PARTNERS, ridge: float = RIDGE) -> Model:
    """Bradley-Terry weights from all bad rows, each against ``partners`` good ones in turn, and from all good rows.

    Without both kinds of rows there is no pair: all weights are zero and every score is DECISION or
    above, as nothing speaks against a document.
    """
    width = x.shape[1]
    centre, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Model([0.0] * width, centre.tolist(), scale.tolist(), -1.0, 1.0)
    partners = max(partners, -(-len(better) // len(worse)))
    at = (np.arange(len(worse))[:, None] * partners + np.arange(partners)[None, :]) % len(better)
    difference = (z[better[at]] - z[worse][:, None, :]).reshape(-1, width)
    w = newton(lambda w: pair_sums(difference, w), width, ridge)
    worth = z @ w
    ordered, bad = np.sort(worth), len(worse)
    # the quantile of the share of bad rows, in the widest gap within two per cent of the rows around it
    low, high = max(1, bad - len(x) // 50), min(len(x) - 1, bad + len(x) // 50)
    at = low + int(np.argmax(ordered[low : high + 1] - ordered[low - 1 : high])) if high >= low else bad
    threshold = float((ordered[at - 1] + ordered[at]) / 2)
    return Model(w.tolist(), centre.tolist(), scale.tolist(), threshold, 1.0)


def by_rank(ordered: DataFrame, weight: Column) -> tuple[DataFrame, list]:
    """Rows in a global order, kept with the number ``part`` of their partition, and of each part ``(part, rows, n)``, n: the sum of ``weight``."""
    kept = ordered.withColumn("part", F.spark_partition_id()).checkpoint()
    return kept, sorted(tuple(r) for r in kept.groupBy("part").agg(F.count("*"), F.sum(weight)).collect())  # a row for each partition


def ranked(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """``(rank, good, x)`` of ``(doc_id, x, good)``, and how many are good and bad; ranks are by id, from 0 among the good and among the bad."""
    kept, parts = by_rank(rows.select("doc_id", "x", "good").orderBy("doc_id"), F.col("good").cast("long"))
    offsets, better, worse = {}, 0, 0
    for part, n, good in parts:
        offsets[part] = better, worse
        better, worse = better + good, worse + n - good

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if not batch.num_rows:
                continue
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            seen = seen or list(offsets[batch.column("part")[0].as_py()])
            rank = np.where(good, seen[0] + np.cumsum(good), seen[1] + np.cumsum(~good)) - 1
            seen = [seen[0] + int(good.sum()), seen[1] + int((~good).sum())]
            yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), batch.column("good"), batch.column("x")], ["rank", "good", "x"])

    return kept.mapInArrow(each, "rank long, good boolean, x array<double>"), better, worse


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature, by decimal sums, which the order of rows doesn't change."""
    total = lambda values: np.array(rows.agg(F.count("*"), *[F.sum(v.cast("decimal(28,18)")) for v in values]).first(), float)
    value = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
    n, *found = total(value)
    centre = np.array(found) / n
    scale = np.sqrt(total([(v - F.lit(float(c))) * (v - F.lit(float(c))) for v, c in zip(value, centre)])[1:] / n)
    return centre, np.where(scale > 1e-9, scale, 1.0)


def pair_chunks(rows: DataFrame, better: int, worse: int, partners: int, centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``(chunk, difference)``: the feature differences of all pairs of :func:`fit`, ``CHUNK`` to a row, of :func:`ranked` rows.

    Pair q is that of bad row q // partners and good row q % better. A row goes to the chunks
    that have a pair of it; where all good rows fit a chunk, to all.
    """
    pairs, width, size = worse * partners, len(FEATURES), CHUNK
    of_bad = f"sequence(rank * {partners} div {size}, (rank * {partners} + {partners - 1}) div {size})"
    of_good = f"transform(sequence(0L, ({pairs - 1} - rank) div {better}), m -> (rank + m * {better}) div {size})"
    if better < size:
        of_good = f"sequence(0L, {(pairs - 1) // size}L)"
    dealt = rows.select(F.explode(F.when(F.col("good"), F.expr(of_good)).otherwise(F.expr(of_bad))).alias("chunk"), "rank", "good", "x")

    def differences(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        z = (table["x"].combine_chunks().flatten().to_numpy().reshape(-1, width) - centre) / scale
        good, rank = table["good"].to_numpy().astype(bool), table["rank"].to_numpy()
        q = np.arange(chunk * size, min((chunk + 1) * size, pairs))
        side = []
        for kind, wanted in ((good, q % better), (~good, q // partners)):
            own = np.flatnonzero(kind)[np.argsort(rank[kind])]
            side.append(z[own[np.searchsorted(rank[own], wanted)]])
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "difference": pa.array([(side[0] - side[1]).tobytes()], pa.binary())})

    return dealt.groupBy("chunk").applyInArrow(differences, "chunk long, difference binary").sortWithinPartitions("chunk")


def widest_gap(worths: DataFrame, low: int, high: int) -> float:
    """The middle of the widest gap of column ``worth`` in ascending order that has ``low`` to ``high`` rows below it, the first of equals."""
    kept, parts = by_rank(worths.groupBy("worth").agg(F.count("*").alias("n")).orderBy("worth"), F.col("n"))
    ends = {r["part"]: r["last"] for r in kept.groupBy("part").agg(F.max("worth").alias("last")).collect()}
    begins, below, last = {}, 0, None
    for part, _, n in parts:
        begins[part] = below, last
        below, last = below + n, ends[part]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            below, last = seen or begins[batch.column("part")[0].as_py()]
            for worth, n in zip(batch.column("worth").to_pylist(), batch.column("n").to_pylist()):
                if last is not None and low <= below <= high and (best is None or worth - last > best[0]):
                    best = worth - last, below, (worth + last) / 2
                if below < low < below + n and best is None:  # equal rows on both sides: no gap, which any gap beats
                    best = 0.0, low, worth
                below, last = below + n, worth
            seen = below, last
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("gap", "at", "middle"), best))])

    found = kept.mapInArrow(each, "gap double, at long, middle double").collect()  # a row for each partition at most
    return max(found, key=lambda r: (r["gap"], -r["at"]))["middle"]


def fit_rows(rows: DataFrame, partners: int = PARTNERS, ridge: float = RIDGE) -> Model:
    """:func:`fit` of all rows ``(doc_id, x, good)``, of distinct ids and in their order; only sums come to the driver."""
    bound_batches(rows.sparkSession)
    width = len(FEATURES)
    rows, better, worse = ranked(rows)
    n = better + worse
    centre, scale = moments(rows) if n else (np.zeros(width), np.ones(width))
    if not better or not worse:
        return Model([0.0] * width, centre.tolist(), scale.tolist(), -1.0, 1.0)
    partners = max(partners, -(-better // worse))
    pairs = pair_chunks(rows, better, worse, partners, centre, scale).checkpoint()

    def sums(w: np.ndarray) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, first = 0, None
            for batch in batches:
                for chunk, difference in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    first = chunk if first is None else first
                    found = found + pair_sums(np.frombuffer(difference).reshape(-1, width), w)
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([found.tolist()])], ["first", "sums"])

        return np.sum([r["sums"] for r in sorted(pairs.mapInArrow(each, "first long, sums array<double>").collect())], axis=0)

    model = Model(newton(sums, width, ridge).tolist(), centre.tolist(), scale.tolist(), 0.0, 1.0)
    low, high = max(1, worse - n // 50), min(n - 1, worse + n // 50)
    return model._replace(threshold=widest_gap(rows.select(model.worth(F.col("x")).alias("worth")), low, high))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int | None = None) -> DataFrame:
    """``(doc_id, label)`` to learn from: all that are not held out, or where it is given ``most`` at most; of repeated ids the best label."""
    marked = narrow(labels, doc_id=id_col, label=label_col).where("label is not null and doc_id is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return marked if most is None else least_hashes(marked, most)


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the ``most`` least hashes of their distinct ids, or all where there are fewer.

    A hash threshold from a histogram leaves about ``most`` rows before anything is ordered;
    only what is left meets in one task.
    """
    share = F.floor((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * HASH_BINS).cast("int")
    histogram = sorted((r["bin"], r["count"]) for r in rows.groupBy(share.alias("bin")).count().collect())  # HASH_BINS rows at most
    total, last = 0, HASH_BINS
    for bin_, n in histogram:
        total += n
        if total >= most:
            last = bin_
            break
    return rows.where(share <= last).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(found: DataFrame, chosen: DataFrame) -> Model:
    """A model from ``(doc_id, x)`` and all labels of :func:`training_labels`.

    Where an id has several texts, the least feature array of them is learned from.
    """
    least = found.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("x").alias("x"))
    return fit_rows(least.join(chosen, "doc_id").select("doc_id", "x", (F.col("label") > 0).alias("good")))


def learn_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from documents and labels; features are made of all documents that are not held out.

    They are made before labels are joined, so that no text is shuffled. Null and empty texts
    have zero features; of an id that is repeated, in either table, one row is learned from
    (see :func:`learn` and :func:`training_labels`). Without documents or labels of both kinds
    every score is above the decision. Further columns are not read.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).where(~held_out(F.col("doc_id")))
    return learn(document_features(rows), training_labels(labels, id_col, label_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of the input.

    Null and empty texts are scored by their zero features, long ones as a whole. Repeated
    rows give repeated results; equal features give equal scores; an empty table gives none;
    a null id is not held out. Without labels of both kinds every document is predicted good.
    Further columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = document_features(docs, id_col, text_col).checkpoint()
    model = learn(found, training_labels(labels, id_col, label_col))
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
