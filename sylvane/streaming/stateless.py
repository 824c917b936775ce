"""The stateless operators over a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvane.operators.chunking import chunk_documents


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    """New Parquet files of a directory as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, **options) -> DataFrame:
    """Chunks of a stream of documents; no state is kept."""
    return chunk_documents(docs, **options)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs an operator of tables on each micro-batch and writes it under the batch's number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
