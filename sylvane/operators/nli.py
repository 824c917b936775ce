"""Entailment of documents: chunk scores pooled by their largest logit, label by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.functions.scores import bernoulli_js_similarity, entropy2, softmax
from sylvane.operators.chunking import chunk_documents
from sylvane.operators.models import EntailmentScorer, asked, compared, once


def pooled_logits(docs: DataFrame, hypotheses: DataFrame, scorer: EntailmentScorer, id_col: str = "doc_id", text_col: str = "text", size: int = 350, overlap: int = 50, max_characters: int = 2000) -> DataFrame:
    """``(doc_id, hypothesis, e, c, n)``: the largest logit of each label over a document's chunks.

    ``hypotheses`` has a column ``hypothesis``, and ``doc_id`` as well where each document has
    its own; without it every document meets every hypothesis, whose table is small.
    """
    chunks = chunk_documents(docs, id_col, text_col, size, overlap, max_characters).select(F.col(id_col).alias("doc_id"), once(scorer, F.col("chunk")).alias("p"))
    own = "doc_id" in hypotheses.columns
    table = hypotheses if own else hypotheses.select("hypothesis").distinct()
    table = table.withColumn("h", asked(scorer, F.col("hypothesis")))
    met = chunks.join(table, "doc_id") if own else chunks.crossJoin(F.broadcast(table))
    scored = met.select("doc_id", "hypothesis", compared(scorer, F.col("p"), F.col("h")).alias("l"))
    return scored.groupBy("doc_id", "hypothesis").agg(F.max("l.e").alias("e"), F.max("l.c").alias("c"), F.max("l.n").alias("n"))


def nli_results(logits: DataFrame) -> DataFrame:
    """The logits with all result fields: probabilities of two and three labels, entropies in bits, and the verdict."""
    e2, c2 = softmax(F.col("e"), F.col("c"))
    e3, c3, n3 = softmax(F.col("e"), F.col("c"), F.col("n"))
    rows = logits.select("doc_id", "hypothesis", e2.alias("p_entailment_binary"), c2.alias("p_contradiction_binary"), e3.alias("entailment_score"), c3.alias("contradiction_score"), n3.alias("neutral_score"))
    return rows.select(
        "*",
        entropy2(F.col("p_entailment_binary"), F.col("p_contradiction_binary")).alias("entropy_binary"),
        entropy2(F.col("entailment_score"), F.col("contradiction_score"), F.col("neutral_score")).alias("entropy_ternary"),
        (F.col("p_entailment_binary") > F.col("p_contradiction_binary")).alias("is_entailed"),
    )


def nli_logits(logits: DataFrame) -> DataFrame:
    """``(doc_id, hypothesis, is_entailed, e_logit, c_logit, p_entailment)``: the short form of the results."""
    return logits.select("doc_id", "hypothesis", (F.col("e") > F.col("c")).alias("is_entailed"), F.col("e").alias("e_logit"), F.col("c").alias("c_logit"), softmax(F.col("e"), F.col("c"))[0].alias("p_entailment"))


def zero_shot(logits: DataFrame, positive: str, negative: str) -> DataFrame:
    """``(doc_id, entailed)``: whether a hypothesis is likelier than its negation."""
    p = nli_logits(logits).groupBy("doc_id").agg(F.max(F.when(F.col("hypothesis") == positive, F.col("p_entailment"))).alias("p"), F.max(F.when(F.col("hypothesis") == negative, F.col("p_entailment"))).alias("q"))
    return p.select("doc_id", (F.col("p") > F.col("q")).alias("entailed"))


def logical_pairs(docs: DataFrame, scorer: EntailmentScorer, id_col: str = "doc_id", text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(by..., i, j, sim)``, i < j of one group: the geometric mean of the entailment scores both ways.

    It is 0 if a text has under 3 characters. As many rows as pairs, so for groups of bounded size.
    """
    by = by or []
    text = F.col(text_col)
    rows = docs.select(*by, F.col(id_col).alias("id"), (F.length(text) < 3).alias("short"), once(scorer, text).alias("p"), asked(scorer, text).alias("h"))
    a, b = rows.alias("a"), rows.alias("b")
    score = lambda x, y: softmax(*[compared(scorer, F.col(x), F.col(y))[k] for k in ("e", "c", "n")])[0]
    both = F.sqrt(score("a.p", "b.h") * score("b.p", "a.h"))
    met = [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in by], F.col("a.id") < F.col("b.id")]
    named = [F.col(f"a.{c}").alias(c) for c in by]
    return a.join(b, met).select(*named, F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.when(F.col("a.short") | F.col("b.short"), 0.0).otherwise(both).alias("sim"))


def functional_pairs(scores: DataFrame) -> DataFrame:
    """``(i, j, sim)`` of hypotheses i < j: mean over premises of 1 - Jensen-Shannon divergence of their entailment.

    ``scores`` has (hypothesis, premise, p).
    """
    a, b = scores.alias("a"), scores.alias("b")
    pair = a.join(b, (F.col("a.premise") == F.col("b.premise")) & (F.col("a.hypothesis") < F.col("b.hypothesis")))
    return pair.groupBy(F.col("a.hypothesis").alias("i"), F.col("b.hypothesis").alias("j")).agg(F.avg(bernoulli_js_similarity(F.col("a.p"), F.col("b.p"))).alias("sim"))
