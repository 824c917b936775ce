"""Secret scans in SQL functions, with linking of multipart credentials.

Strong findings stand alone: assignments to a secret's name, access keys, long hex runs.
Weak candidates (identifiers, unnamed secret-like tokens, endpoints) are ordinary text most
of the time; they are reported only when a complementary part lies within their scope. Parts
and scopes meet in an interval join: the scope of a candidate reaches ``SCOPE`` code points to
either side and covers the cells of that width that it touches, a part lies in the cell of its
start, and equal cells of a document are joined. Of the parts of a cell only the first and the
last of each role are needed, so no document, however long or full, makes pairs of its parts. Weak candidates are looked
for in what the base spans leave of a text, so that none repeats a strong finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow
from sylvane.functions.binding import let
from sylvane.llm.spans import spans
from sylvane.session import ensure_checkpoint_dir

# The patterns, with the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_NAME = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
LEAST_ASSIGNED = 12
#: What base spans are blanked with before weak candidates are looked for; it parts words, but ends no candidate.
BLANK = "\0"
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9_\x00])(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|tenant_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}"""
SECRET = r"(?<![A-Za-z0-9+/_=\x00-])(?=[A-Za-z+/_-]*\d)(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=\x00-])"
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:https?|ftp|ssh|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[a-z0-9._@:-]{3,}(?:/[a-z0-9._/-]*)?|(?<![a-z0-9_])(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9-]"""
#: What may occur where a pattern can match at all; a cheap first look at the whole text.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{16}", "identifier": r"(?i)(?:user|login|account|client|tenant|key)", "secret": r"[A-Za-z0-9+/_-]{20}", "endpoint": r"://|(?i)(?:host|endpoint|server)"}

BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
WEAK = {"identifier": IDENTIFIER, "secret": SECRET, "endpoint": ENDPOINT}
KINDS = (*BASE, *WEAK)
SCOPE = 400
#: The role of each kind; a candidate is linked to a part of another role.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}


NONE = "array<struct<kind:int,start:int,end:int>>"


def _of_kind(text: Column, kind: str) -> Column:
    """(kind number, start, end) of a kind's spans."""
    found, i = spans(text, (BASE | WEAK)[kind]), KINDS.index(kind)
    if kind == "assign":
        found = F.filter(found, lambda x: F.char_length(F.regexp_replace(x["m"], ASSIGN_NAME, "")) >= LEAST_ASSIGNED)
    found = F.transform(found, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(NONE))


def blanked(text: Column) -> Column:
    """The text with its base spans overwritten, code point by code point."""

    def without(t: Column, pattern: str) -> Column:
        def of(matches: Column) -> Column:
            worth = lambda m: F.char_length(F.regexp_replace(m, ASSIGN_NAME, "")) >= LEAST_ASSIGNED if pattern == ASSIGN else F.lit(True)
            filled = F.transform(matches, lambda m: F.when(worth(m), F.repeat(F.lit(BLANK), F.char_length(m))).otherwise(m))
            gaps = F.split(t, pattern)
            return F.when(F.size(matches) == 0, t).otherwise(F.array_join(F.flatten(F.zip_with(gaps, filled, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), ""))

        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), of)

    for kind in BASE:
        now = text
        text = let(now, lambda t: F.when(t.rlike(HINTS[kind]), without(t, BASE[kind])).otherwise(t))  # noqa: B023
    return text


def _located(text: Column) -> Column:
    """All spans, base and weak, as an array of (kind number, start, end)."""
    base = F.concat(*[_of_kind(text, kind) for kind in BASE])
    weak = lambda t: F.concat(*[_of_kind(t, kind) for kind in WEAK])
    return let(base, lambda b: F.concat(b, let(F.when(F.size(b) > 0, blanked(text)).otherwise(text), weak)))


def _joined(found: Column) -> Column:
    """kind:start:end, by start and then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def linked(found: DataFrame) -> DataFrame:
    """``(key, spans)``: the weak spans of each key that have a complementary part in scope.

    ``found`` has a unique ``key`` and ``spans``, an array of (kind, start, end), in which no
    weak span overlaps a base one. A part counts if its start is at most ``SCOPE`` code points
    before the candidate's start or after its end, and its role is another one; a candidate
    must see a secret, or be one and see an identifier or endpoint.
    """
    n_base = len(BASE)
    is_secret = lambda x: x["kind"].isin([i for i, k in enumerate(KINDS) if ROLES[k] == "secret"])
    some = found.where(F.exists("spans", lambda x: x["kind"] >= n_base) & F.exists("spans", is_secret) & F.exists("spans", lambda x: ~is_secret(x)))
    parts = some.select("key", F.explode("spans").alias("p"))
    parts = parts.groupBy("key", F.floor(F.col("p.start") / SCOPE).alias("cell"), is_secret(F.col("p")).alias("secret"))
    parts = parts.agg(F.min("p.start").alias("first"), F.max("p.start").alias("last"))
    candidates = some.select("key", F.explode(F.filter("spans", lambda x: x["kind"] >= n_base)).alias("w"))
    reach = F.explode(F.sequence(F.floor(F.greatest(F.col("w.start") - SCOPE, F.lit(0)) / SCOPE), F.floor((F.col("w.end") + SCOPE) / SCOPE)))
    candidates = candidates.select("*", reach.alias("cell"))
    c, p = candidates.alias("c"), parts.alias("p")
    met = (F.col("c.key") == F.col("p.key")) & (F.col("c.cell") == F.col("p.cell")) & (is_secret(F.col("c.w")) != F.col("p.secret"))
    # a scope is wider than a cell, so at most one of its borders lies in one: first and last part tell whether any is inside
    met &= (F.col("p.last") >= F.col("c.w.start") - SCOPE) & (F.col("p.first") <= F.col("c.w.end") + SCOPE)
    kept = c.join(p, met, "left_semi").select("key", "w").distinct()
    return kept.groupBy("key").agg(F.collect_list("w").alias("linked"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)``, one row for each row of the input.

    base and spans are "kind:start:end" by start and then kind, joined by commas; start and
    end are code points. spans adds the linked weak candidates to the base ones; spans that
    begin at one place are ordered by kind. Null and empty texts have none. Long texts are
    searched whole, in time linear in their length and findings, and findings may be of any
    length. Rows that repeat an id are told apart by their spans only: those that share them
    get the same links. Further columns are not read. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    located = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", _located(F.col("text")).alias("spans"))
    located = located.select("doc_id", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.to_json("spans")), 256).alias("key"), "spans").checkpoint()
    n_base = len(BASE)
    base = F.filter("spans", lambda x: x["kind"] < n_base)
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    links = linked(located.dropDuplicates(["key"]))
    found = located.join(links, "key", "left")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        _joined(base).alias("base"),
        _joined(F.concat(base, F.coalesce("linked", F.array().cast(NONE)))).alias("spans"),
    )
