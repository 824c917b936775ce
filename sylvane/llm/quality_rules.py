"""Line-first cleaning in SQL functions: lines that fail a rule go, documents that lose too much go.

Everything is computed inside the row: no shuffle, no Python. A repeated three-word window
is found by sorting the window hashes of its own text, so a long text costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow, numbered
from sylvane.functions.binding import let

# Fixed values of the base measures.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50

# Fixed values of the line rules.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "enable javascript",
    "lorem ipsum",
    "share this",
    "skip to content",
    "back to top",
)
#: Symbols in a hundred characters; words for each separator; words for each distinct word; words without punctuation.
MOST_SYMBOLS, WORDS_A_SEPARATOR, WORDS_A_DISTINCT, UNPUNCTUATED = 10, 4, 6, 60
#: A document is rejected when more of its word characters than this share, in per cent, go with failing lines.
MOST_LOST = 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more, the first one included."""

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        same = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))

    def of(hashes: Column) -> Column:
        numbered_ = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeated = let(let(F.sort_array(numbered_), positions), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeated)

    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, of))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule: symbols, navigation, shouting, repetition, no punctuation, boilerplate."""

    def rules(w: Column) -> Column:
        n = F.size(w)
        symbols = F.regexp_count(line, F.lit(SYMBOL)) * 100 > MOST_SYMBOLS * F.char_length(line)
        separators = F.regexp_count(line, F.lit(r"[|»›•·]"))
        navigation = (separators >= 2) & (separators * WORDS_A_SEPARATOR >= n)
        bangs = F.regexp_count(line, F.lit("!!"))
        shouting = ((bangs >= 2) & (bangs * 4 >= n)) | ((n >= 4) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}"))
        repetition = (n >= 10) & (F.size(F.array_distinct(w)) * WORDS_A_DISTINCT < n)
        unpunctuated = (n >= UNPUNCTUATED) & ~line.rlike("[.,;:!?…。]")
        boilerplate = line.rlike("(?i)" + "|".join(BOILERPLATE))
        return symbols | navigation | shouting | repetition | unpunctuated | boilerplate

    return let(words_of(line), rules)


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the base measures, the verdict and the cleaned text, in columns ``__q.*`` of a struct.

    ``text`` must be unambiguous. Null text: no words, so the base rule fails.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    first = rows.select("*", words_of(value).alias("__words"), F.split(value, "\n").alias("__lines"))
    with_word = F.filter("__lines", lambda x: x.rlike(WORD))
    judged = F.transform("__lines", lambda x: F.struct(x.alias("line"), (x.rlike(WORD) & line_fails(x)).alias("fails")))
    second = first.select("*", with_word.alias("__own"), judged.alias("__judged"))
    lost = F.aggregate(
        F.filter("__judged", lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + F.char_length(F.regexp_replace(x["line"], SPACE, ""))
    )
    measures = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(value, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__own") - F.size(F.array_distinct("__own"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size(F.filter("__judged", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
        lost.alias("lost_chars"),
        F.array_join(F.transform(F.filter("__judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    # A generator keeps later filters above the measures; pushed below, they would compute them anew inside their lambdas.
    third = second.select(*[F.col(f"`{c}`") for c in rows.columns], F.explode(F.array(measures)).alias("__q"))
    third = third.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__q.{c}").alias(f"__{c}") for c in MEASURED])
    failed = (F.col("__n_words") < LEAST_WORDS) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * MOST_REPEATED)
    return third.withColumn("__base_failed", failed).withColumn(
        "__kept", ~F.col("__base_failed") & (F.col("__lost_chars") * 100 <= F.col("__word_chars") * MOST_LOST)
    )


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "cleaned")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars", "cleaned")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines,
    lost_chars, cleaned)``, one row for each row of the input.

    ``kept`` is false where the base rules fail (under 50 words, or over half of the words
    in repeated windows) or where failing lines hold over 30 % of the word characters;
    ``cleaned`` is the text without failing lines. Null and empty texts have no words and
    are not kept. Repeated rows give repeated results; an empty table gives none.
    """
    rows = measured(narrow(docs, doc_id=id_col, text=text_col))
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in MEASURES])


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with the cleaned text (and its length, where that column exists); all columns stay."""
    names = docs.columns
    at = f"__c{names.index(text_col)}"
    rows = measured(numbered(docs), at).where("__kept")
    columns = []
    for i, name in enumerate(names):
        if i == names.index(text_col):
            columns.append(F.col("__cleaned"))
        elif length_col and name == length_col:
            columns.append(F.char_length("__cleaned").cast(docs.schema[i].dataType))
        else:
            columns.append(F.col(f"__c{i}"))
    return rows.select(*columns).toDF(*names)
