"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvane.llm import language_model, media, packing, pieces, pii, quality_model, quality_rules, secrets, simhash, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(documents(spark, sf_dir), path, end_id=2, capacity=1024, digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(documents(spark, sf_dir), path, ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


#: The key of the pseudonyms; a production run takes its own.
PSEUDONYM_KEY = "sylvane"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY)
    spans = F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(spans, ",").alias("spans"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), media.DIGESTS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(documents(spark, sf_dir))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), F.round("log_odds", 6).alias("log_odds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_pieces": op3_pieces,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_language_model": op9_language_model,
    "op10_urls": op10_urls,
}

#: The quality rules in DuckDB's SQL.
_SYMBOLS, _SPACE = r"[#*$%&|<>]", r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{0}}, '{_SPACE}'), lambda x: x <> '')"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_LINE_FAILS = f"""(
    {_COUNT.format('l', _SYMBOLS)} * 100 > {quality_rules.MOST_SYMBOLS} * length(l)
    OR ({_COUNT.format('l', '[|»›•·]')} >= 2 AND {_COUNT.format('l', '[|»›•·]')} * {quality_rules.WORDS_A_SEPARATOR} >= len(w))
    OR ({_COUNT.format('l', '!!')} >= 2 AND {_COUNT.format('l', '!!')} * 4 >= len(w))
    OR (len(w) >= 4 AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}'))
    OR (len(w) >= 10 AND len(list_distinct(w)) * {quality_rules.WORDS_A_DISTINCT} < len(w))
    OR (len(w) >= {quality_rules.UNPUNCTUATED} AND NOT regexp_matches(l, '[.,;:!?…。]'))
    OR regexp_matches(l, '(?i){"|".join(quality_rules.BOILERPLATE)}'))"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents), words AS MATERIALIZED (SELECT r, {_WORDS.format('text')} AS w FROM d),
      g AS MATERIALIZED (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM words WHERE len(w) > 2)),
      twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
      covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
      lines AS MATERIALIZED (SELECT r, l, {_WORDS.format('l')} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)),
      judged AS (SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (f) AS failed, coalesce(sum(n) FILTER (f), 0) AS lost FROM (SELECT r, l, {_LINE_FAILS} AS f, length(array_to_string(w, '')) AS n FROM lines WHERE len(w) > 0) GROUP BY r),
      m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_COUNT.format('text', _SYMBOLS)} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        coalesce(failed, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars FROM d JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN judged USING (r)),
      b AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MOST_REPEATED} AS base_failed FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {quality_rules.MOST_LOST} AS kept, n_failed_lines, lost_chars FROM b""",
}
