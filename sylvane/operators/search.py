"""Keyword, regular expression and entailment searches over documents, and issues by page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.operators import nli
from sylvane.operators.models import EntailmentScorer, asked, compared, once


@dataclass(frozen=True)
class Recipe:
    """What to look for; absent lists are empty."""

    keywords: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    nli_hypotheses: tuple[str, ...] = ()
    llm_hypotheses: tuple[str, ...] = ()


ANSWER = ("id", "method", "input", "found", "output_type", "output")


def keywords(docs: DataFrame, words: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and keyword: whether the text has it, as a case-sensitive substring."""
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(F.array(*[F.lit(w) for w in words]).cast("array<string>")).alias("input"))
    found = F.coalesce(F.contains("t", "input"), F.lit(False))
    return pairs.select("id", F.lit("keyword").alias("method"), "input", found.alias("found"), F.lit("bool").alias("output_type"), found.cast("string").alias("output"))


def patterns(docs: DataFrame, expressions: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and pattern: its first match, which may be empty, or false. Patterns are Java's."""
    one = lambda p: F.struct(F.lit(p).alias("input"), F.coalesce(F.col("t").rlike(p), F.lit(False)).alias("found"), F.regexp_extract("t", p, 0).alias("match"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = rows.select("id", F.explode(F.array(*[one(p) for p in expressions])).alias("x")) if expressions else rows.select("id", F.lit(None).cast("struct<input:string,found:boolean,match:string>").alias("x")).limit(0)
    return rows.select("id", F.lit("regex").alias("method"), "x.input", "x.found", F.when(F.col("x.found"), "str").otherwise("bool").alias("output_type"), F.when(F.col("x.found"), F.col("x.match")).otherwise("false").alias("output"))


def hypotheses(docs: DataFrame, asked: tuple[str, ...], scorer: EntailmentScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and hypothesis: whether it is entailed."""
    table = docs.sparkSession.createDataFrame([(h,) for h in asked], "hypothesis string")
    found = nli.nli_logits(nli.pooled_logits(docs.select(id_col, text_col), table, scorer, id_col, text_col))
    return found.select(F.col("doc_id").alias("id"), F.lit("nli").alias("method"), F.col("hypothesis").alias("input"), F.col("is_entailed").alias("found"), F.lit("bool").alias("output_type"), F.col("is_entailed").cast("string").alias("output"))


def search(docs: DataFrame, recipe: Recipe, scorer: EntailmentScorer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All answers of a recipe in one long table."""
    made = keywords(docs, recipe.keywords, id_col, text_col).unionByName(patterns(docs, recipe.regex, id_col, text_col))
    if recipe.nli_hypotheses:
        if scorer is None:
            raise ValueError("hypotheses need a scorer")
        made = made.unionByName(hypotheses(docs, recipe.nli_hypotheses, scorer, id_col, text_col))
    return made


def report(answers: DataFrame) -> DataFrame:
    """``(id, answers)``: the answers of each document as one array, by method and input."""
    return answers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("method", "input", "output"))).alias("answers"))


def page_range(pages: DataFrame, page_col: str = "page", start: int = 0, end: int = -1) -> DataFrame:
    """The pages from ``start`` up to ``end``, which is left out; -1: to the last."""
    kept = pages.where(F.col(page_col) >= start)
    return kept if end == -1 else kept.where(F.col(page_col) < end)


def issues(pages: DataFrame, problems: dict[str, str], depths: dict[str, str], scorer: EntailmentScorer, page_col: str = "page", text_col: str = "text", start: int = 0, end: int = -1) -> tuple[DataFrame, DataFrame]:
    """(findings, deep findings): pages from ``start`` up to ``end`` (-1: to the last) that entail a problem, and among
    them those whose evidence entails a depth.

    findings: (page, problem_name, evidence); deep: the same with depth. The evidence is the
    sentence with the largest entailment logit, the first on a tie.
    """
    spark = pages.sparkSession
    numbered = page_range(pages.select(F.col(page_col).alias("page"), F.coalesce(text_col, F.lit("")).alias("text")), "page", start, end)
    sentences = numbered.select("page", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("no", "sentence")).withColumn("p", once(scorer, F.col("sentence")))
    table = spark.createDataFrame(sorted(problems.items()), "problem_name string, hypothesis string").select("problem_name", asked(scorer, F.col("hypothesis")).alias("h"))
    scored = sentences.crossJoin(F.broadcast(table)).select("page", "problem_name", "no", "sentence", compared(scorer, F.col("p"), F.col("h")).alias("l"))
    best = scored.groupBy("page", "problem_name").agg(F.max_by(F.struct("sentence", "l"), F.struct("l.e", (-F.col("no")).alias("o"))).alias("b"))
    findings = best.where("b.l.e > b.l.c").select("page", "problem_name", F.col("b.sentence").alias("evidence"))
    levels = spark.createDataFrame(sorted(depths.items()), "depth string, hypothesis string")
    deep = findings.crossJoin(F.broadcast(levels)).select("*", scorer.logits(F.concat_ws(" - ", "problem_name", "evidence"), F.col("hypothesis")).alias("l"))
    return findings, deep.where("l.e > l.c").select("page", "problem_name", "depth", "evidence")
