"""Corpus preparation in stages; each reads what the one before it wrote.

Quality rules, quality classifier, SimHash near-dedup, pseudonyms, packing. All stages but the
last return the columns of ``documents``, whatever further columns that table has.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvane.frames import numbered
from sylvane.llm import packing, pii, quality_model, quality_rules, simhash
from sylvane.llm.batches import bound_batches
from sylvane.session import ensure_checkpoint_dir, remove_folder

#: The key of the pseudonyms; a production run takes its own.
PSEUDONYM_KEY = "sylvane"
CAPACITY, END_ID = 1024, 2
#: Bytes of a row group of the stages' files; a task holds one while it writes and one while it reads.
ROW_GROUP = 16 << 20


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go from the texts; documents that fail the base rules or lose too much text go."""
    bound_batches(spark)
    return quality_rules.clean_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go.

    It learns from the labelled rows of ``documents`` as they came, since the stage before
    has removed most of the bad ones. The score is a column of the row: nothing is joined,
    and repeated or missing ids do no harm.
    """
    bound_batches(spark)
    ensure_checkpoint_dir(spark)
    given, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.learn_documents(given, labels)
    names = docs.columns
    text = F.col(f"__c{names.index('text')}")
    scored = numbered(docs).withColumn("__score", model.score(quality_model.features_column(text)))
    return scored.where(F.col("__score") >= quality_model.DECISION).drop("__score").toDF(*names)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid numbers, dates and addresses become keyed pseudonyms."""
    bound_batches(spark)
    return pii.pseudonymise_documents(docs, PSEUDONYM_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, path, END_ID, CAPACITY, digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def write(df: DataFrame, path: str) -> None:
    """Parquet with row groups of about ``ROW_GROUP`` bytes."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's folder goes when the next one is written; that of the last is the result's.
    Null, empty and very long texts, repeated rows and ids, empty tables and further columns
    are treated as each stage says.
    """
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        write(stage(spark, docs, sf_dir), f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
        if i:
            remove_folder(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
