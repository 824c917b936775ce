"""Scores of texts under two models of the training documents: word unigrams, and context trees.

Two passes count the words and the byte contexts of the training documents, partial sums first. The
most frequent words, and the most frequent byte contexts with their bytes' probabilities, are
broadcast (a bounded number of each), so that the last pass scores in place. Only what a document
has of the rest is shuffled: its rarer words meet their counts in a join, and its rarer contexts,
packed for a block of documents at a time, meet their bucket of the trees.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow
from sylvane.llm import ctw
from sylvane.llm.batches import bound_batches, texts_of
from sylvane.session import ensure_checkpoint_dir

FOLDS, SMOOTHING = 10, 0.1
#: Words whose counts are broadcast at most; byte contexts (with their byte) whose probabilities are.
HEAD, GRAM_HEAD = 1 << 18, 1 << 20
#: Distinct words that a task gathers before it hands on their partial counts; distinct byte contexts.
GATHERED, GATHERED_GRAMS = 400_000, 2_000_000
END_KEY, WORD = b"e", b"w"
#: Bytes of text, and rows, that are counted or scored at once.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 512


def is_held_out(doc_id) -> bool:
    """Whether crc32 of the id as text is a multiple of ``FOLDS``; a null id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the training texts: words and ends, summed within the task."""
    words: Counter = Counter()
    ends = 0

    def made() -> Iterator[pa.RecordBatch]:
        keys, n = [WORD + w for w in words], list(words.values())
        if ends:
            keys.append(END_KEY)
            n.append(ends)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.binary()), pa.array(n[at : at + 100_000], pa.int64())], ["key", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, data in zip(ids, texts_of(batch.column(1))):
            if not is_held_out(i):
                ends += 1
                words.update(data.lower().split())
        if len(words) > GATHERED:
            yield from made()
            words, ends = Counter(), 0
    yield from made()


def key_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, n)`` of all training documents; a key is a word or the end."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(_count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes], slice]]:
    """(ids, lower-cased texts, rows) of parts of a batch."""
    ids, texts, size, first = [], [], 0, 0
    for k, (i, data) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)))):
        ids.append(i), texts.append(data.lower())
        size += len(data)
        if size > BLOCK_BYTES or len(ids) >= BLOCK_ROWS or k == batch.num_rows - 1:
            yield ids, texts, slice(first, k + 1)
            ids, texts, size, first = [], [], 0, k + 1


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> list[pa.Array]:
    """The bucket numbers, and the arrays packed for each bucket."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    cuts = [slice(a, b) for a, b in zip(first.tolist(), [*first.tolist()[1:], len(bucket)])]
    return [pa.array(found.astype(np.int32)), *(pa.array([x[order][c].tobytes() for c in cuts], pa.binary()) for x in arrays)]


def n_buckets(spark) -> int:
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bucket, codes, times)``: partial counts of all documents' byte contexts; held-out documents count 0."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(docs.sparkSession)
    buckets = n_buckets(docs.sparkSession)

    def made(codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(by_bucket(ctw.buckets_of(codes, buckets), codes, times), ["bucket", "codes", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for ids, texts, _ in _blocks(batch):
                parts = [(codes, times)]
                for held, weight in ((False, 1), (True, 0)):
                    found = [ctw.grams(t) for i, t in zip(ids, texts) if is_held_out(i) == held]
                    if found:
                        distinct, n = ctw.counted(np.concatenate(found))
                        parts.append((distinct, n * weight))
                codes, times = ctw.counted(*(np.concatenate(x) for x in zip(*parts)))
                if len(codes) > GATHERED_GRAMS:
                    yield made(codes, times)
                    codes, times = codes[:0], times[:0]
        if len(codes):
            yield made(codes, times)

    return rows.mapInArrow(count, "bucket int, codes binary, times binary")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of logs by document of each block, from rows in order of buckets: a bucket's codes with their logs, then those asked for."""
    known, logs = np.zeros(0, np.uint64), np.zeros(0)
    for batch in batches:
        out: list[tuple] = []
        for block, codes, other in zip(*(batch.column(c) for c in ("block", "codes", "other"))):
            codes = np.frombuffer(codes.as_py(), np.uint64)
            if not block.is_valid:
                known, logs = codes, np.frombuffer(other.as_py(), np.float64)
                continue
            sums = np.bincount(np.frombuffer(other.as_py(), np.uint32), logs[np.searchsorted(known, codes)])
            at = np.flatnonzero(sums)
            out.append((block.as_py(), at.astype(np.uint32).tobytes(), sums[at].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["block", "at", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, at, score)`` of rows in order of blocks."""
    now, total = None, np.zeros(0)

    def made() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["block", "at", "score"])

    for batch in batches:
        for block, at, sums in zip(*(batch.column(c) for c in ("block", "at", "sums"))):
            block, at, sums = block.as_py(), np.frombuffer(at.as_py(), np.uint32), np.frombuffer(sums.as_py(), np.float64)
            if block != now:
                if now is not None:
                    yield made()
                now, total = block, np.zeros(0)
            if at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total))])
            total[at] += sums
    if now is not None:
        yield made()


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, one row for each row of the input.

    score is log10 of the context trees' probability of the lower-cased text and its end;
    bits_per_byte is the code length that it stands for, for each byte and the end. Null and
    empty texts consist of the end alone; texts of any length are scored whole. Repeated rows
    give repeated results and count as often in training; a null id is trained on. Further
    columns are not read. An empty table gives none, and a table without training rows is
    scored by uniform models.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    counts = key_counts(docs, id_col, text_col).checkpoint()
    kind = F.substring("key", 1, 1)
    trees = ctw.learn(gram_counts(docs, id_col, text_col)).checkpoint()
    buckets = n_buckets(spark)
    n_train, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(kind == F.lit(WORD)).select(F.substring("key", 2, 1 << 30).alias("word"), "n")
    least = ctw.frequent(words, "n", HEAD)
    head = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= least).toLocalIterator()}  # HEAD rows at most
    n_ends = next((r["n"] for r in counts.where(kind == F.lit(END_KEY)).collect()), 0)
    under = n_train + SMOOTHING * (n_types + 1)
    shared = spark.sparkContext.broadcast((head, *ctw.head_of(trees, GRAM_HEAD)[:3]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, of their rare words, and of the rare codes of a block of documents in a bucket."""
        known, *parts = shared.value
        of = ctw.Head(*parts)
        logs = {w: float(np.log10((n + SMOOTHING) / under)) for w, n in known.items()}
        end = float(np.log10((n_ends + SMOOTHING) / under))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, texts, rows in _blocks(batch):
                at, word, number = [], [], []
                n_tokens, n_known, base = [], [], []
                for i, data in enumerate(texts):
                    n, hits, sum_ = 1, int(n_ends > 0), end
                    for w, k in Counter(data.split()).items():
                        n += k
                        log = logs.get(w)
                        if log is not None:
                            hits += k
                            sum_ += k * log
                        else:
                            at.append(i), word.append(w), number.append(k)
                    n_tokens.append(n), n_known.append(hits), base.append(sum_)
                grams = [ctw.grams(data) for data in texts]
                sizes = np.array(list(map(len, grams)))
                codes, owner = np.concatenate(grams), np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
                found, rare = of(codes)
                whole = np.bincount(owner, found, len(texts))
                n = len(texts)
                ids = batch.column(0).slice(rows.start, n)
                made = {"doc_id": ids, "at": pa.array(np.arange(n, dtype=np.int32)), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base), "score": pa.array(whole), "n_bytes": pa.array(sizes)}
                yield shaped(block, n, made)
                if word:
                    yield shaped(block, len(word), {"at": pa.array(at, pa.int32()), "word": pa.array(word, pa.binary()), "n_tokens": pa.array(number, pa.int64())})
                if len(rare):
                    bucket, *packed = by_bucket(ctw.buckets_of(codes[rare], buckets), codes[rare], owner[rare])
                    yield shaped(block, len(bucket), {"bucket": bucket, "codes": packed[0], "other": packed[1]})
                block += 1

    rows = narrow(docs, doc_id=id_col, text=text_col)
    bound_batches(spark)
    type_ = rows.schema["doc_id"].dataType.simpleString()
    arrow = {"doc_id": None, "at": pa.int32(), "word": pa.binary(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "bucket": pa.int32(), "codes": pa.binary(), "other": pa.binary()}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow["doc_id"] = to_arrow_type(rows.schema["doc_id"].dataType)

    def shaped(block: int, n: int, columns: dict) -> pa.RecordBatch:
        arrays = [columns[c] if c in columns else pa.nulls(n, t) for c, t in arrow.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), *arrays], ["block", *arrow])

    schema = f"block bigint, doc_id {type_}, at int, word binary, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, bucket int, codes binary, other binary"
    scored = rows.mapInArrow(score, schema).checkpoint()
    asked = scored.where("bucket is not null").select("bucket", "block", "codes", "other")
    both = trees.select("bucket", F.lit(None).cast("long").alias("block"), "codes", F.col("logs").alias("other")).unionByName(asked)
    sums = ctw.in_buckets(both, "block").mapInArrow(_met, "block bigint, at binary, sums binary")
    sums = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block bigint, at int, score double")
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / F.lit(under))
    tail = words.where(F.col("n") < least)
    rare = scored.where("word is not null").select("block", "at", "word", F.col("n_tokens").alias("times")).join(tail, "word", "left")
    rare = rare.groupBy("block", "at").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * log).alias("base"))
    own = scored.where("n_bytes is not null").drop("word", "bucket", "codes", "other")
    parts = own.unionByName(rare, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    whole = parts.groupBy("block", "at").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return whole.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
