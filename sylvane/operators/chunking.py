"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.functions import text as T


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 350, overlap: int = 50, max_characters: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """``(id, keep..., chunk_no, chunk)``; an empty or null text has one empty chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    keep = keep or []
    normal = docs.select(id_col, *keep, T.normalise(F.coalesce(text_col, F.lit(""))).alias("__t"))
    words = normal.select("*", T.filtered_words(F.col("__t")).alias("__w"))
    return words.select(id_col, *keep, F.posexplode(T.chunks(F.col("__t"), F.col("__w"), size, overlap, max_characters)).alias("chunk_no", "chunk"))
