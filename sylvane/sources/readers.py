"""Readers: directories of PDF and text files, tables, samples, recipes, settings, trees."""

from __future__ import annotations

import dataclasses
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvane.functions.text import repair_accents
from sylvane.operators.sampling import permuted, random_sample
from sylvane.operators.search import Recipe
from sylvane.operators.tree import from_json


def pdf_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length, content)`` of all PDF files below a directory, whatever the case of their suffix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(directory).select("path", "length", "content")


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``(path, page, text)``, pages from 0, with accents repaired; ``extract`` gives a file's page texts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, c in zip(batch["path"], batch["content"]) for i, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.select("path", "content").mapInPandas(each, "path string, page int, text string")
    return pages.select("path", "page", repair_accents(F.col("text")).alias("text"))


def whole_text(pages: DataFrame) -> DataFrame:
    """``(path, text)``: the pages of each file one after another, with nothing between."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def text_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, text)``, a whole file in each row; ``recursive``: those of all folders below as well."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_files(files: DataFrame, n: int | None) -> DataFrame:
    """The first n files by path; all without n."""
    return files if n is None else files.orderBy("path").limit(n)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or XLSX table with a header; any other suffix: ValueError."""
    lower = path.lower()
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if lower.endswith((".xlsx", ".xls")):
        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"unsupported file type: {path}")


#: Text and label columns of the known data sets.
DATASETS = {"wikipedia": ("text", "label"), "bills": ("summary", "topic"), "ag_news": ("text", "label"), "default": ("text", "label")}


def sample(spark: SparkSession, path: str, n: int | None = 500, seed: int = 42, dataset: str = "default", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text, label)`` of a JSONL or Parquet data set: n rows without replacement, or all in a keyed order."""
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    text, label = DATASETS.get(dataset, DATASETS["default"])
    key = F.col(id_col) if id_col in rows.columns else F.xxhash64(F.col(text))
    named = rows.select(key.alias("doc_id"), F.col(text).alias("text"), (F.col(label) if label in rows.columns else F.lit(None)).alias("label"))
    return permuted(named, seed) if n is None else random_sample(named, n, seed, "doc_id")


def toml(path: str) -> dict:
    with open(path, "rb") as file:
        return tomllib.load(file)


def recipe(path: str) -> Recipe:
    """A search recipe from TOML; unknown keys are ignored and absent lists are empty."""
    given = toml(path)
    return Recipe(**{f.name: tuple(given.get(f.name) or ()) for f in dataclasses.fields(Recipe)})


def without_output(files: DataFrame, outputs: DataFrame, suffix: str = ".csv", path_col: str = "path") -> DataFrame:
    """The files whose result, the same path with another suffix, is not among the outputs yet."""
    result = F.concat(F.regexp_replace(F.col(path_col), r"\.[^./]*$", ""), F.lit(suffix))
    done = outputs.select(F.col(path_col).alias("__done")).distinct()
    return files.join(done, result == F.col("__done"), "left_anti")


def configured(cls: type, data: dict | None = None, override: dict | None = None):
    """A settings object from the section named like its class, another section's values on top of a copy of it."""
    given = dict((data or {}).get(cls.__name__, {})) | dict(override or {})
    known = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: v for k, v in given.items() if k in known})


def tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a tree stored as JSON. Pickles are refused, as loading one runs its code."""
    if not path.endswith(".json"):
        raise ValueError(f"unsupported tree file: {path}")
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return from_json(spark, text)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, name, prompt)`` of a TOML file with problems and depths."""
    given = toml(path)
    rows = [(kind, name, entry["system_prompt"]) for kind in ("problems", "depth") for name, entry in sorted(given.get(kind, {}).items())]
    return spark.createDataFrame(rows, "kind string, name string, prompt string")


def judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation CSV files, with the file each row came from."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("file", F.col("_metadata.file_path"))
