"""Arrow batches of bounded size for the operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch and of a batch of the Parquet reader, and bytes of the former where
#: this Spark knows that setting: whole texts can be long, a worker holds one batch in and one
#: out, and the reader's batch is an array on the heap of every task.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def bound_batches(spark) -> None:
    """Lower the batch limits of the session; a lower limit that is already set stays."""
    limits = (("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES))
    for key, most in (*limits, ("parquet.columnarReaderBatchSize", BATCH_ROWS)):
        key = f"spark.sql.{key}"
        try:
            now = int(spark.conf.get(key).removesuffix("b"))  # Spark gives bytes as 67108864b
        except Exception:  # this Spark has no such setting, or it is given in other units
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each input batch."""
    bound_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(each, schema)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every text; a null counts as empty."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist():
        yield value or b""
