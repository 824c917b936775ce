"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

Two fingerprints are linked when at most ``distance`` of their 64 bits differ. Equal
fingerprints are one class from the start, so a group of copies of any size is one row
in everything that follows. Classes meet in the buckets of block tables (a pair within
``distance`` agrees in at least ``blocks - distance`` of the blocks); inside a bucket the
precomputed Hamming distances to the reference fingerprints decide: by the triangle
inequality two fingerprints whose distances to any pivot differ by more than ``distance``
can't be linked. What passes is verified bit by bit, and each pair leaves in one table only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow, numbered
from sylvane.llm.batches import map_batches, texts_of
from sylvane.llm.components import components
from sylvane.session import ensure_checkpoint_dir

SEED = 42
PIVOTS = 16
#: Shingle hashes that are counted at once, so that a text of any length needs bounded memory.
CHUNK = 1 << 16
#: Up to so many distinct fingerprints, two of five blocks (26 bits) make a bucket; beyond, three of six (32 bits).
WIDE = 1 << 27


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, each shingle weighted by its count.

    A-Z are lower-cased; words are runs of anything but space and tab to carriage return.
    Fewer words than a shingle make one shingle; no words make fingerprint zero. A bit is
    set if it is set in more than half of the shingle hashes (a tie leaves it clear).
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(x) for x in zip(*(tokens[i:] for i in range(words)))]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        hashes = np.fromiter((digest(x, SEED) for x in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(shingles)).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = np.fromiter((fingerprint(x) for x in texts_of(batch.column(1))), np.uint64, batch.num_rows)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row for each row of the input; null text counts as empty."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return map_batches(rows, _fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """The pivots: hashes of 0, 1, ..., as signed 64-bit numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED)).astype(np.int64)) for i in range(n)]


def pivot_table(fp: Column, pivots: list[int]) -> list[Column]:
    """Hamming distances to the pivots, eight to a long."""
    packed = []
    for at in range(0, len(pivots), 8):
        column = F.lit(0).cast("long")
        for i, p in enumerate(pivots[at : at + 8]):
            column = column.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        packed.append(column.alias(f"t{at // 8}"))
    return packed


def _within(a: str, b: str, tables: int, pivots: int, distance: int) -> Column:
    """Whether no pivot tells the two apart: the largest coordinate difference is small enough."""
    ok = F.lit(True)
    for i in range(pivots):
        of = lambda side: F.shiftrightunsigned(F.col(f"{side}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))  # noqa: B023, E731
        ok = ok & (F.abs(of(a) - of(b)) <= distance)
    return ok


def _masks(blocks: int, keep: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(fps: DataFrame, distance: int = 3, pivots: int = PIVOTS, blocks: int = 5) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the distinct values of column ``fp`` within ``distance`` bits, each once.

    Pigeonhole: of ``blocks`` blocks at least ``blocks - distance`` agree, so the pair meets
    in the table of those blocks. The first table of a pair keeps it, the others drop it.
    """
    masks = _masks(blocks, blocks - distance)
    tables = (pivots + 7) // 8
    rows = fps.select("fp", *pivot_table(F.col("fp"), reference_fingerprints(pivots)))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    rows = rows.select("*", F.explode(keys).alias("key")).select("fp", *[f"t{i}" for i in range(tables)], "key.i", "key.k")
    a, b = rows.alias("a"), rows.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    met = (F.col("a.i") == F.col("b.i")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp"))
    kept = met & _within("a", "b", tables, pivots, distance) & (F.bit_count(x) <= distance) & (first == F.col("a.i"))
    return a.join(b, kept).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _classified(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """``(doc_id, fp, root, component_id)``; root is a fingerprint that names the component."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    fps = fingerprints(docs, id_col, text_col).checkpoint()
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    blocks = distance + (2 if classes.count() <= WIDE else 3)
    roots = components(near_pairs(classes.select("fp"), distance, blocks=blocks)).withColumnsRenamed({"node": "fp"})
    linked = classes.join(roots, "fp").checkpoint()
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    linked = linked.join(lowest, "root").select("fp", "root", "lowest")
    named = classes.join(linked, "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "least").alias("component_id")).checkpoint()
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of the input.

    component_id is the least id reachable over links. Null or empty texts and texts without
    words have fingerprint zero and are linked like any other. Repeated rows and repeated ids
    give repeated rows of the result. Rows with a null id take part; their component is null
    only where no document reachable has an id. A bit that half of a text's shingles have is
    clear. A very long text is hashed in parts of ``CHUNK`` shingles. Further columns are not
    read. An empty table gives an empty result.
    """
    return _classified(docs, id_col, text_col, distance).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the least id.

    Texts without words (null, empty, blank) are one component like any other. An id that
    occurs with texts of several components stays once in each that it leads. Among rows of
    equal id and fingerprint, and where no row of a component has an id, a hash of the whole
    row decides, so the choice doesn't depend on the order of rows. An empty table gives none.
    """
    found = _classified(docs, id_col, text_col, 3).checkpoint()
    names, plain = docs.columns, numbered(docs)
    key, text = (f"__c{names.index(c)}" for c in (id_col, text_col))
    uneven = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not uneven:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        return plain.join(gone, F.col(key) == F.col("__gone"), "left_anti").toDF(*names)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "fp")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("__id"), F.col("f.fp").alias("__fp"))
    hashed = [c for c, field in zip(plain.columns, docs.schema) if "map<" not in field.dataType.simpleString()]
    rows = plain.withColumn("__h", F.xxhash64(*hashed))
    marked = fingerprints(rows.select(F.struct(key, "__h").alias("doc_id"), F.col(text).alias("text")))
    marked = marked.select(F.col(f"doc_id.{key}").alias("__id"), F.col("doc_id.__h").alias("__h"), F.col("fp").alias("__fp"))
    led = marked.join(first, marked["__id"].eqNullSafe(first["__id"]) & (marked["__fp"] == first["__fp"]), "left_semi")
    least = led.groupBy("__id", "__fp").agg(F.min("__h").alias("__least")).select(F.col("__id").alias("__kept"), "__least")
    kept = rows.join(least, F.col(key).eqNullSafe(F.col("__kept")) & (F.col("__h") == F.col("__least")), "left_semi")
    return kept.dropDuplicates([key, "__h"]).drop("__h").toDF(*names)
