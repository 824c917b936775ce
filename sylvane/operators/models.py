"""The three models that operators plug in, with deterministic stand-ins for use without a model.

The stand-ins reproduce shapes and flow, not the quality of neural models.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.functions import vectors as V


class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """ARRAY<DOUBLE> of a text column."""


class EntailmentScorer(Protocol):
    def logits(self, premise: Column, hypothesis: Column) -> Column:
        """STRUCT<e, c, n: DOUBLE>: entailment, contradiction and neutral logits."""


def once(scorer: EntailmentScorer, premise: Column) -> Column:
    """What a scorer reads of a premise whatever the hypothesis; computed below the join with the hypotheses."""
    return scorer.premise(premise) if hasattr(scorer, "premise") else premise


def asked(scorer: EntailmentScorer, hypothesis: Column) -> Column:
    """What a scorer reads of a hypothesis whatever the premise."""
    return scorer.hypothesis(hypothesis) if hasattr(scorer, "hypothesis") else hypothesis


def compared(scorer: EntailmentScorer, premise: Column, hypothesis: Column) -> Column:
    """The logits from what `once` and `asked` gave."""
    return scorer.compare(premise, hypothesis) if hasattr(scorer, "compare") else scorer.logits(premise, hypothesis)


class HypothesisGenerator(Protocol):
    def about(self, texts: list[str], avoid: list[str]) -> str:
        """A statement that is true of about half of the texts."""

    def contrast(self, a: list[str], b: list[str], avoid: list[str]) -> str:
        """A statement that is true of collection a and not of b."""


class UdfEmbedder:
    """Any function from a list of texts to vectors, called on Arrow batches."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]]):
        self.function = function

    def embed(self, text: Column) -> Column:
        function = self.function

        @F.pandas_udf("array<double>")
        def embedded(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in function([t or "" for t in texts])])

        return embedded(text)


class HashingEmbedder(UdfEmbedder):
    """Counts of hashed lower-case tokens, of unit length; zeros for a text without words."""

    def __init__(self, dimensions: int = 64):
        super().__init__(lambda texts: [self.vector(t) for t in texts])
        self.dimensions = dimensions

    def vector(self, text: str) -> np.ndarray:
        at = [zlib.crc32(w.encode()) % self.dimensions for w in text.lower().split()]
        counts = np.bincount(np.array(at, np.int64), minlength=self.dimensions).astype(float)
        return counts / max(1e-12, float(np.linalg.norm(counts)))


class LexicalEntailment:
    """With r the share of the hypothesis' words that the text has: e = 4r - 2, c = 2 - 4r, n = 0.

    Where a hypothesis quotes something, only the words quoted count.
    """

    def words(self, text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
        return F.filter(found, lambda w: ~w.isin(*T.STOP_WORDS))

    def premise(self, text: Column) -> Column:
        return self.words(text)

    def hypothesis(self, text: Column) -> Column:
        quoted = F.regexp_extract(text, '"([^"]+)"', 1)
        return self.words(F.when(quoted != "", quoted).otherwise(text))

    def logits(self, premise: Column, hypothesis: Column) -> Column:
        return self.compare(self.premise(premise), self.hypothesis(hypothesis))

    def compare(self, words: Column, asked: Column) -> Column:
        r = F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words)) / F.when(F.size(asked) > 0, F.size(asked)))
        return F.struct((4 * r - 2).alias("e"), (2 - 4 * r).alias("c"), F.lit(0.0).alias("n"))


class TokenHypothesis:
    """'The text mentions "w"', with a word of the texts: in about half of them, or most typical of one side."""

    def _frequencies(self, texts: list[str]) -> dict[str, int]:
        import re

        counts: dict[str, int] = {}
        for text in texts:
            for w in {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in T.STOP_WORDS}:
                counts[w] = counts.get(w, 0) + 1
        return counts

    def _first(self, ranked: list[str], avoid: list[str]) -> str:
        for word in ranked:
            made = f'The text mentions "{word}"'
            if made not in avoid:
                return made
        raise ValueError("no hypothesis left")

    def about(self, texts: list[str], avoid: list[str]) -> str:
        found = self._frequencies(texts)
        return self._first(sorted(found, key=lambda w: (abs(found[w] / len(texts) - 0.5), w)), avoid)

    def contrast(self, a: list[str], b: list[str], avoid: list[str]) -> str:
        of_a, of_b = self._frequencies(a), self._frequencies(b)
        gain = lambda w: of_a.get(w, 0) / max(1, len(a)) - of_b.get(w, 0) / max(1, len(b))
        return self._first(sorted({*of_a, *of_b}, key=lambda w: (-gain(w), w)), avoid)


class QuestionMark:
    """Stand-in for a classifier of questions: the last sign of the text is a question mark."""

    def is_question(self, text: Column) -> Column:
        return F.rtrim(text).endswith("?")


def embed_documents(docs: DataFrame, embedder: Embedder, id_col: str = "doc_id", text_col: str = "text", size: int = 100, overlap: int = 25) -> DataFrame:
    """``(doc_id, embedding)``: the mean of the embeddings of a document's chunks, of unit length."""
    from sylvane.operators.chunking import chunk_documents

    vectors = chunk_documents(docs, id_col, text_col, size, overlap).select(F.col(id_col).alias("doc_id"), embedder.embed(F.col("chunk")).alias("v")).where("v is not null")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # the chunks of a document come one after the other
            if len(pdf):
                first = np.flatnonzero((pdf["doc_id"] != pdf["doc_id"].shift()).to_numpy())
                sums = np.add.reduceat(np.array(pdf["v"].tolist(), float), first, axis=0)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first].to_numpy(), "s": list(sums), "n": np.diff([*first, len(pdf)])})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    sums = vectors.mapInPandas(summed, f"doc_id {kind}, s array<double>, n long").groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.sum("n").alias("n"))
    whole = F.when(F.size("s") == 1, F.col("s")[0]).otherwise(F.aggregate(F.slice("s", 2, F.size("s") - 1), F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))
    means = sums.select("doc_id", F.transform(whole, lambda x: x / F.col("n")).alias("m"))
    return means.select("doc_id", V.unit(F.col("m")).alias("embedding"))
