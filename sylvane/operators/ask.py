"""Calls of a language model that the user supplies, for each row, and their averages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.functions import text as T


def ask(rows: DataFrame, prompt_col: str, make_client: Callable[[], Callable[[str], dict]], answer: str, retries: int = 10) -> DataFrame:
    """The rows with the fields of ``answer`` (a DDL schema) and ``error``.

    ``make_client`` is called once for each task and returns a function from a prompt to a
    dictionary of the fields. A call that raises is tried again; after ``retries`` tries the
    fields are null and ``error`` says why. A lost task repeats its calls, so put a cache
    (``sinks.Cache``) in front of paid ones.
    """
    names = [f.split()[0] for f in answer.replace(":", " ").split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            made = []
            for prompt in batch[prompt_col]:
                found, error = {}, None
                for _ in range(max(1, retries)):
                    try:
                        found, error = client(prompt), None
                        break
                    except Exception as wrong:  # whatever the client raises counts as a failed try
                        error = str(wrong)
                made.append([found.get(n) for n in names] + [error])
            fields = pd.DataFrame(made, columns=[*names, "error"], index=batch.index)
            yield pd.concat([batch, fields], axis=1)

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(each, f"{given}, {answer}, error string")


def grounded(docs: DataFrame, instructions: str, make_client, text_col: str = "text") -> DataFrame:
    """The documents with a yes/no ``answer`` and its ``evidence``."""
    prompts = docs.withColumn("prompt", F.concat(F.lit(instructions + "\n\n"), F.coalesce(text_col, F.lit(""))))
    return ask(prompts, "prompt", make_client, "answer boolean, evidence string").drop("prompt")


def generate_from_paths(paths: DataFrame, make_client, path_col: str = "path") -> DataFrame:
    """Paths of decisions with a ``text`` that a model writes to fit them."""
    return ask(paths.withColumn("prompt", T.path_text(F.col(path_col))), "prompt", make_client, "text string").drop("prompt")


def generate_from_examples(examples: DataFrame, make_client, texts_col: str = "texts", most: int = 5, words: int = 350) -> DataFrame:
    """Groups of example texts with a ``text`` like them; at most five examples of 350 words are shown."""
    return ask(examples.withColumn("prompt", T.prompt(F.slice(texts_col, 1, most), most_words=words)), "prompt", make_client, "text string").drop("prompt")


def judge(questions: DataFrame, make_client, criteria: list[str], runs: int = 5, by: list[str] | None = None, question_col: str = "question") -> DataFrame:
    """``(by..., question, criteria...)``: each criterion as the mean of its yes/no judgements over several runs."""
    by = [*(by or []), question_col]
    repeated = questions.select(*by, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    judged = ask(repeated, question_col, make_client, ", ".join(f"{c} boolean" for c in criteria))
    return judged.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in criteria])
