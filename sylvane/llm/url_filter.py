"""URL verdicts: rules first, then words segmented from host and path, judged by naive Bayes.

Both models are learned from the pages themselves, counted in the cluster over all rows. A name such
as "cheappillsonline" is split by the Viterbi path of a unigram model of the words in the pages'
text: every word counts, however rare, as the substrings of the distinct names meet the whole
count table in a join. Naive Bayes takes its two classes from the pages' content: a page whose
text fails the base quality measures speaks against the words of its URL, any other page for them.
What is known of a distinct name (its words and their log-odds) is made once and joined to the URLs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow
from sylvane.functions.binding import let
from sylvane.llm import quality_rules
from sylvane.llm.batches import bound_batches
from sylvane.session import ensure_checkpoint_dir

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Longest part of a name that is looked up as a word; a whole name is, whatever its length.
LONGEST = 24
#: Smoothing of naive Bayes; log-odds above which a URL is blocked.
SMOOTHING, LIMIT = 1.0, 0.0
#: What an unknown part costs beyond a word that occurs once, and for each of its characters.
UNKNOWN, UNKNOWN_CHARACTER = 2.0, 3.0
#: Rows of parts of names that are handed on at once.
PIECES = 100_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"[\p{L}\p{M}]+|\d+"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def millionths(x: float) -> int:
    return round(float(x) * 1e6)


class Segmenter:
    """Viterbi splits under a unigram model; an unknown chunk costs more the longer it is.

    Costs are whole millionths, so that ties are ties in whatever order they are added up.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.cost = {w: millionths(np.log(total) - np.log(c)) for w, c in counts.items()}
        self.unknown = millionths(np.log(total) + UNKNOWN)

    def __call__(self, name: str) -> list[str]:
        """The cheapest split; on a tie the one with the longer last word. An unknown chunk is one character or follows a word."""
        n, cost_of = len(name), self.cost.get
        best, back = [0] * (n + 1), [0] * (n + 1)
        open_cost, open_start = np.inf, 0  # of the best unknown chunk that can be drawn out to here
        for end in range(1, n + 1):
            begun = best[end - 1] + self.unknown
            if begun < open_cost:
                open_cost, open_start = begun, end - 1
            open_cost += millionths(UNKNOWN_CHARACTER)
            cost, start = open_cost, open_start
            for first in range(max(0, end - LONGEST), end):
                c = cost_of(name[first:end])
                if c is not None and (best[first] + c, first) < (cost, start):
                    cost, start = best[first] + c, first
            if end == n > LONGEST and (c := cost_of(name)) is not None and c <= cost:
                cost, start = c, 0
            best[end], back[end] = cost, start
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def names_of(host: Column, path: Column) -> Column:
    """The names of a URL: runs of letters, and runs of digits of which only the length is kept."""
    return F.regexp_extract_all(F.translate(F.concat_ws("/", host, F.lower(path)), "123456789", "0" * 9), F.lit(NAME), F.lit(0))


def plain_text(html: Column) -> Column:
    """The text between tags, without scripts and styles; one that isn't closed lasts to the end."""
    return F.regexp_replace(html, r"(?i)<(?:script|style)\b[^<>]*>(?s:.*?)(?:</(?:script|style)>|\z)|<[^<>]*>|&[a-z]+;", " ")


def fails_quality(text: Column) -> Column:
    """Whether a text has too few words, too many repeated ones, or too many symbols."""

    def of(words: Column) -> Column:
        n = F.size(words)
        repeated = quality_rules.repeated_words(words) * 100 > n * quality_rules.MOST_REPEATED
        symbols = F.regexp_count(text, F.lit(quality_rules.SYMBOL)) * 100 > F.char_length(text) * quality_rules.MOST_SYMBOLS
        return (n < quality_rules.LEAST_WORDS) | repeated | symbols

    return let(quality_rules.words_of(text), of)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of all words of column ``text``, in lower case, of two letters and more."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]{2,}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, words)`` of ``(key, name)``: the Viterbi split of each name under the counts ``(word, n)``.

    Only the parts of a name that are words travel back to it: at most its length times
    ``LONGEST``. A name without any is one unknown word.
    """
    total = words.agg(F.sum("n")).first()[0] or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece = [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.string())], ["key", "word"])

        for batch in batches:
            for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for width in range(2, min(LONGEST, len(name)) + 1):
                    found = {name[i : i + width] for i in range(len(name) - width + 1)}
                    key += [k] * len(found)
                    piece += found
                    if len(key) > PIECES:
                        yield made()
                        key, piece = [], []
                if len(name) > LONGEST:
                    key.append(k), piece.append(name)
        if key:
            yield made()

    letters = names.where(~F.startswith("name", F.lit("0")))
    known = letters.select("key", "name").mapInArrow(parts, "key bigint, word string").join(words, "word")
    known = known.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([Segmenter({r["word"]: r["n"] for r in k} if k is not None else {}, total)(n) for n, k in zip(name, known)])

    return names.join(known, "key", "left").select("key", split("name", "known").alias("words"))


def word_odds(counted: DataFrame) -> DataFrame:
    """``(word, odds)`` of ``(word, blocked, allowed)``: the log-ratio of the smoothed shares of both classes."""
    b, a, v = counted.agg(F.sum("blocked"), F.sum("allowed"), F.count("*")).first()
    share = lambda c, n: F.log((F.col(c) + SMOOTHING) / F.lit(float((n or 0) + SMOOTHING * (v + 1))))
    return counted.select("word", (share("blocked", b) - share("allowed", a)).alias("odds"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, words, log_odds)``, one row for each row of the input.

    rule is null where none fits; words and log_odds are given for all. Rows with a null page
    are judged, but not learned from; without ``html_col``, or where no page is given, nothing
    speaks against a URL. A null URL, or one without "://", has an empty host and path and no
    words. A tie, log-odds of ``LIMIT``, is allowed. URLs and pages of any length are taken
    whole. Repeated rows count as often and give repeated results; further columns are not
    read; an empty table gives none.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col) if html_col else narrow(pages, page_id=id_col, url=url_col).withColumn("html", F.lit(None).cast("string"))
    rows = rows.withColumn("text", plain_text(F.col("html")))
    names = lambda c: names_of(c["host"], c["path"])
    at = F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", at.alias("at"), F.when(F.col("text").isNotNull(), fails_quality(F.col("text"))).alias("fails"))
    parts = parts.select("row", "page_id", "at.host", "at.path", names(F.col("at")).alias("names"), "fails").checkpoint()
    counts = word_counts(rows).checkpoint()
    blocked, allowed = (F.count(F.when(F.col("fails") == side, 1)).alias(c) for side, c in ((True, "blocked"), (False, "allowed")))
    found = parts.select(F.explode("names").alias("name"), "fails").groupBy("name").agg(blocked, allowed)
    found = found.select(F.monotonically_increasing_id().alias("key"), "name", "blocked", "allowed").checkpoint()
    split = found.join(segmented(found.select("key", "name"), counts), "key").select("key", "name", "words", "blocked", "allowed").checkpoint()
    by_word = split.select(F.explode("words").alias("word"), "blocked", "allowed").groupBy("word").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    odds = word_odds(by_word.checkpoint())
    scored = split.select("key", F.explode("words").alias("word")).join(odds, "word").groupBy("key").agg(F.sum("odds").alias("odds"))
    known = split.select("key", "name", "words").join(scored, "key").select("name", "words", "odds")
    n_blocked, n_allowed = parts.agg(blocked, allowed).first()
    prior = float(np.log((n_blocked + SMOOTHING) / (n_allowed + SMOOTHING)))
    met = parts.select("row", F.posexplode("names").alias("at", "name")).join(known, "name")
    sums = met.groupBy("row").agg(F.sum("odds").alias("odds"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = parts.drop("names", "fails").join(sums, "row", "left")
    judged = judged.withColumn("log_odds", F.coalesce("odds", F.lit(0.0)) + F.lit(prior if n_blocked + n_allowed else 0.0))
    verdict = F.coalesce(verdict, F.when(F.col("log_odds") > LIMIT, F.lit("block")).otherwise(F.lit("allow")))
    words = F.coalesce(F.flatten(F.transform("w", lambda x: x["words"])), F.array().cast("array<string>"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), words.alias("words"), "log_odds")
