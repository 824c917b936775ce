"""Exact all-against-all work on vectors, in blocks.

Rows are dealt to blocks of bounded size, each packed into two binary values. Both sides are
shuffled once; each task reads one part of either side and lets their blocks meet, so no
block is copied for every other one. NumPy works on the two matrices, and only what the work
returns (top-k lists, sums by cluster) leaves a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.session import lower_batches

BLOCK = 4096
#: Blocks of the right side that one task reads.
HELD = 32

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(df: DataFrame, id_col: str, vector_col: str, extra_col: str | None = None, size: int = BLOCK) -> tuple[DataFrame, int]:
    """``(block, ids, vectors, extra)`` with one row for each block, and the number of blocks."""
    n = max(1, -(-df.count() // size))
    block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    extra = F.col(extra_col).cast("long") if extra_col else F.lit(0).cast("long")
    rows = df.select(block.alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), extra.alias("x"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        matrix = np.array(pdf["v"].tolist(), dtype=np.float64)
        made = {"block": pdf["block"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()], "extra": [pdf["x"].to_numpy(np.int64).tobytes()]}
        return pd.DataFrame({k: list(v) for k, v in made.items()})

    return rows.groupBy("block").applyInPandas(pack, "block int, ids binary, vectors binary, extra binary"), n


def unpack(batch: pa.RecordBatch, row: int, side: str) -> Block:
    value = lambda name, kind: np.frombuffer(batch.column(f"{side}_{name}")[row].as_buffer(), kind)
    ids = value("ids", np.int64)
    return ids, value("vectors", np.float64).reshape(len(ids), -1), value("extra", np.int64)


def parts(n: int, size: int = BLOCK) -> int:
    """Into how many parts the right side's blocks are dealt."""
    return -(-n // (HELD if size <= BLOCK else max(1, HELD * 2 * BLOCK // size)))


def block_size(rows: int) -> int:
    """Larger blocks for many rows: what a task is sent falls with their size, but a task holds pairs of them several times."""
    return BLOCK if rows <= 128 * BLOCK else 4 * BLOCK


def block_rows(left: tuple[DataFrame, int], right: tuple[DataFrame, int], function: Callable[[int, Block, Iterator[Block]], Iterator[pd.DataFrame]], schema: str, once: bool = False, size: int = BLOCK) -> DataFrame:
    """``function(number, left block, right blocks)`` for each left block and each part of the right side.

    A block is (ids, vectors, extra). With ``once`` a block meets itself and those of greater number only.
    ``size`` is that of the right blocks.
    """
    (a, m), (b, n) = left, right
    lower_batches(a.sparkSession)
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).repartition(m)
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).repartition(parts(n, size))
    met = a.hint("shuffle_replicate_nl").join(b, F.col("a_block") <= F.col("b_block") if once else F.lit(True))
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(","))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((batch.column("a_block")[row].as_py(), batch, row) for batch in batches for row in range(batch.num_rows))
        for number, group in itertools.groupby(pairs, lambda p: p[0]):  # the pairs of a left block come one after the other
            _, batch, row = first = next(group)
            others = (unpack(p[1], p[2], "b") for p in itertools.chain([first], group))
            for made in function(number, unpack(batch, row, "a"), others):
                yield pa.RecordBatch.from_pandas(made, shape, preserve_index=False)

    return met.mapInArrow(each, schema)


def block_pairs(left: tuple[DataFrame, int], right: tuple[DataFrame, int], function: Callable[[Block, Block], pd.DataFrame], schema: str, once: bool = False) -> DataFrame:
    """``function(left block, right block)`` for all pairs of blocks, with ``once`` for each unordered pair."""
    return block_rows(left, right, lambda _, a, others: (function(a, b) for b in others), schema, once)
