"""Personal data in SQL functions: format-preserving Feistel pseudonyms.

Candidates are found by one pattern; each is validated (Luhn, calendar, octets, ranges). The candidate
of a card is a whole run of digit groups; in it, every length from 19 down to 13 is tried at each group.
A valid number or date is mapped to a pair (a, b) of Z_A x Z_B, permuted by eight rounds of a
keyed Feistel network in mixed radix, and written back in the layout it had. The map is a
bijection of each format onto itself, so values that were equal stay equal and others stay
apart, in all documents, without any table. E-mail addresses have no finite format; they
get keyed digests of the address and of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.frames import narrow, numbered
from sylvane.functions.binding import let
from sylvane.llm.spans import placed, scan

# The patterns of candidates. The first pattern that matches at a place wins.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NOT_INSIDE = r"(?<![\p{L}\p{N}._%+-])"
NUMBER = r"(?<![\p{L}\d.])(?<!\d[-/])"
#: Where a run of digit groups gives way to another kind: a telephone number at its start, any after a space.
PHONE = r"\d{3}[.-]\d{3}[ .-]\d{4}(?![\d\p{L}])"
OTHER = rf"{OCTET}(?:\.{OCTET}){{3}}(?![\d\p{{L}}])|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(?![\d\p{{L}}])|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}(?![\d\p{{L}}])|\d{{3}}-\d{{2}}-\d{{4}}(?![\d\p{{L}}])(?!-\d)|{PHONE}(?!-\d)|[\p{{L}}\p{{N}}._%+-]++@"
PATTERNS = {
    "email": NOT_INSIDE + r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])",
    "ip": NUMBER + OCTET + r"(?:\." + OCTET + r"){3}(?![\d\p{L}])(?!\.\d)",
    "date": NUMBER + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d\p{L}])",
    "ssn": NUMBER + r"\d{3}-\d{2}-\d{4}(?![\d\p{L}])(?!-\d)",
    "card": NUMBER + rf"(?!{PHONE}(?!-\d))(?=\d(?:[ -]?\d){{12}})\d++(?!\p{{L}})(?:(?:-| (?!{OTHER}))\d++(?!\p{{L}}))*+",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\d\p{L}])|(?<![\p{L}\d])\+\d{1,3}[ .-]?\d{10}(?![\d\p{L}])",
}
KINDS = tuple(PATTERNS)
ROUNDS = 8
#: Dates from 1900-01-01 to 2099-12-31: 73,049 days, as 319 x 229.
FIRST_DAY, DAYS = "1900-01-01", (319, 229)


def _any() -> str:
    """One pattern for all kinds; back references count the groups of the whole."""
    return "|".join(p.replace(r"\1", r"\k<s>").replace(r"\2", r"\k<t>").replace("([-/.])", "(?<s>[-/.])", 1).replace("([-/.])", "(?<t>[-/.])", 1) for p in PATTERNS.values())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, counted from the last digit."""

    def add(total: Column, c: Column) -> Column:
        return total + c

    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, _number(c)).otherwise(_number(c) * 2 - F.when(_number(c) > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0).cast("long"), add)


def _is_card(digits: Column) -> Column:
    return (luhn_sum(digits) % 10 == 0) & digits.rlike("^[2-6]")


def _cards(gap: Column, run: Column) -> Column:
    """(gap, match) of the cards in a run of digit groups, leftmost and longest first; the last match is empty."""
    groups = F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))

    def card(window: Column) -> Column:
        tried = F.array(*[F.regexp_extract(window, rf"^[ -]?(\d(?:[ -]?\d){{{n - 1}}})(?!\d)", 1) for n in range(19, 12, -1)])
        return F.get(F.filter(tried, lambda t: (t != "") & _is_card(_digits(t))), F.lit(0))

    def step(skip: Column, found: Column) -> Column:
        """Takes the card that begins at a group, unless one before it reaches here: out is the card or null."""
        free = (skip == 0) & found.isNotNull()
        left = F.when(free, F.regexp_count(found, F.lit("[ -]"))).otherwise(F.greatest(skip - 1, F.lit(0)))
        return F.struct(left.cast("int").alias("state"), F.when(free, found).alias("out"))

    def of(g: Column) -> Column:
        # 19 groups hold the longest card, and one of over 19 digits is in none
        short = F.transform(g, lambda x: F.left(x, F.lit(21)))
        begun = let(short, lambda v: F.transform(v, lambda x, i: card(F.array_join(F.slice(v, i + 1, F.lit(19)), ""))))
        taken = scan(begun, F.lit(0), "string", step)
        return let(F.filter(F.transform(taken, lambda c, i: F.struct(i.alias("at"), c.alias("card"))), lambda x: x["card"].isNotNull()), lambda t: pairs(g, t))

    def pairs(g: Column, t: Column) -> Column:
        after = lambda x: x["at"] + F.regexp_count(x["card"], F.lit("[ -]")) + 1
        between = lambda start, end: F.array_join(F.slice(g, start + 1, end - start), "")
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(after(F.get(t, k - 1)))
        gaps = lambda x, k: F.concat(F.when(k == 0, gap).otherwise(F.lit("")), between(before(k), x["at"]), F.regexp_extract(F.get(g, x["at"]), "^[ -]?", 0))
        each = F.transform(t, lambda x, k: F.struct(gaps(x, k).alias("gap"), x["card"].alias("match")))
        rest = F.concat(F.when(F.size(t) == 0, gap).otherwise(F.lit("")), between(before(F.size(t)), F.size(g)))
        return F.concat(each, F.array(F.struct(rest.alias("gap"), F.lit("").alias("match"))))

    return let(groups, of)


def _relaid(match: Column, digits: Column) -> Column:
    """The match with its digits replaced, one by one, by the given ones."""
    chars = F.transform(
        F.split(match, ""),
        lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, F.char_length(_digits(F.substring(match, F.lit(1), i))) + 1, F.lit(1))).otherwise(c),
    )
    return F.array_join(chars, "")


def _date_parts(match: Column) -> Column:
    """The calendar date of a match; day before month unless only the other order is a date."""
    part = lambda i: F.element_at(F.split(match, "[-/.]"), i)
    as_date = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    found = F.when(match.rlike(r"^\d{4}"), as_date(part(1), part(2), part(3)))
    found = found.otherwise(F.coalesce(as_date(part(3), part(2), part(1)), as_date(part(3), part(1), part(2))))
    return F.when(found.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), found)


def _dated(match: Column, day: Column) -> Column:
    """Another day in the layout of the match; single digits only where the match had one."""
    part = lambda i: F.element_at(F.split(match, "[-/.]"), i)
    separator = F.regexp_extract(match, "([-/.])", 1)
    old = _date_parts(match)
    width = lambda i, n: F.when((F.char_length(part(i)) == 1) & (n < 10), n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
    year, month, number = F.year(day).cast("string"), F.month(day), F.day(day)
    day_first = _number(part(2)) == F.month(old)
    return F.when(match.rlike(r"^\d{4}"), F.concat(year, separator, width(2, month), separator, width(3, number))).otherwise(
        F.when(day_first, F.concat(width(1, number), separator, width(2, month), separator, year)).otherwise(
            F.concat(width(1, month), separator, width(2, number), separator, year)
        )
    )


def _long(x: int | Column) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _pair(kind: str, a: Column, b: Column, size_a: int | Column, size_b: int | Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), _long(a).alias("a"), _long(b).alias("b"), _long(size_a).alias("size_a"), _long(size_b).alias("size_b"))


def _coded(match: Column) -> Column:
    """(kind, a, b, size_a, size_b) of a valid match, else null."""
    full = lambda kind: match.rlike("^(?:" + PATTERNS[kind] + ")$")
    digits = _digits(match)
    n = F.char_length(digits)
    octet = lambda i: _number(F.element_at(F.split(match, r"\."), i))
    day = F.datediff(_date_parts(match), F.lit(FIRST_DAY).cast("date"))
    area, group, serial = (_number(F.element_at(F.split(match, "-"), i)) for i in (1, 2, 3))
    body = F.substring(digits, F.lit(2), n - 2)
    half = F.floor((n - 2) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10), k).cast("long")
    line = F.right(digits, F.lit(10))
    card = n.between(13, 19) & _is_card(digits)
    ssn = (area >= 1) & (area != 666) & (area < 900) & (group >= 1) & (serial >= 1)
    return (
        F.when(full("email"), _pair("email", 0, 0, 1, 1))
        .when(full("ip"), _pair("ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536))
        .when(full("date"), F.when(_date_parts(match).isNotNull(), _pair("date", F.floor(day / DAYS[1]), day % DAYS[1], *DAYS)))
        .when(full("ssn"), F.when(ssn, _pair("ssn", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)))
        .when(full("card"), F.when(card, _pair("card", _number(F.left(body, half)), _number(F.right(body, n - 2 - half)), power(half), power(n - 2 - half))))
        .when(full("phone") & (n >= 10), _pair("phone", _number(F.left(line, F.lit(5))), _number(F.right(line, F.lit(5))), 100_000, 100_000))
    )


def _round(key: Column, x: Column, r: Column, side: str, other: Column, size: Column) -> Column:
    mixed = F.sha2(F.concat_ws(":", key, x["kind"], x["size_a"].cast("string"), x["size_b"].cast("string"), F.lit(side), r.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.left(mixed, F.lit(15)), 16, 10).cast("long"), size)


def _permuted(key: Column, x: Column) -> Column:
    """(a, b) after the Feistel rounds: each adds a keyed function of one part to the other, modulo its size."""

    def step(s: Column, r: Column) -> Column:
        a = (s["a"] + _round(key, x, r, "a", s["b"], x["size_a"])) % x["size_a"]
        return let(a, lambda v: F.struct(v.alias("a"), ((s["b"] + _round(key, x, r, "b", v, x["size_b"])) % x["size_b"]).alias("b")))

    start = F.struct(x["a"].alias("a"), x["b"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _written(key: Column, match: Column, x: Column, p: Column) -> Column:
    """The permuted pair in the layout of the match."""
    a, b, kind = p["a"], p["b"], x["kind"]
    digits = _digits(match)
    n = F.char_length(digits)
    text = lambda v, size: F.lpad(v.cast("string"), F.char_length(size.cast("string")) - 1, F.lit("0"))
    digest = lambda what, v, k: F.left(F.sha2(F.concat_ws(":", key, F.lit(what), v), 256), F.lit(k))
    whole = F.lower(match)
    email = F.concat(F.lit("u"), digest("address", whole, 16), F.lit("@d"), digest("domain", F.substring_index(whole, "@", -1), 8), F.lit(".invalid"))
    ip = F.concat_ws(".", *[F.floor(v).cast("long").cast("string") for v in (a / 256, a % 256, b / 256, b % 256)])
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * DAYS[1] + b).cast("int"))
    area = a + 1 + (a + 1 >= 666).cast("long")
    ssn = F.concat_ws("-", *[F.lpad(F.floor(v).cast("long").cast("string"), k, "0") for v, k in ((area, 3), (b / 9999 + 1, 2), (b % 9999 + 1, 4))])
    body = F.concat(F.left(digits, F.lit(1)), text(a, x["size_a"]), text(b, x["size_b"]))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    line = F.concat(F.left(digits, n - 10), text(a, x["size_a"]), text(b, x["size_b"]))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "date", _dated(match, day))
        .when(kind == "ssn", ssn)
        .when(kind == "card", _relaid(match, F.concat(body, check)))
        .when(kind == "phone", _relaid(match, line))
    )


def pseudonymised(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The rows with ``__text`` and ``__pii``, an array of (kind, start, end, pseudonym); ``text`` must be unambiguous.

    The key is read by a scalar subquery, so no plan, log or user interface shows it.
    """
    own = [F.col(f"`{c}`") for c in rows.columns]
    secret = rows.sparkSession.sql("SELECT key FROM VALUES (:key) AS t(key)", args={"key": key}).scalar()  # a local relation, of which plans show the column
    pattern, value = _any(), F.col(text)
    may = value.rlike(r"[@\d]")
    none = F.array().cast("array<string>")
    cut = rows.select("*", F.when(may, F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).otherwise(none).alias("__match"))
    some = F.size("__match") > 0
    cut = cut.select("*", F.when(some, F.split(value, pattern)).otherwise(none).alias("__gap"))
    is_run = lambda m: m.rlike(r"^\d[\d -]+$") & m.rlike("^(?:" + PATTERNS["card"] + ")$")
    plain = lambda g, m: F.array(F.struct(g.alias("gap"), m.alias("match")))
    pairs = F.flatten(F.zip_with(F.slice("__gap", F.lit(1), F.size("__match")), "__match", lambda g, m: F.when(is_run(m), _cards(g, m)).otherwise(plain(g, m))))
    cut = cut.select("*", F.when(F.exists("__match", is_run), pairs).alias("__pairs"))
    gaps = F.concat(F.transform("__pairs", lambda x: x["gap"]), F.slice("__gap", F.size("__match") + 1, F.lit(1)))
    matches = F.transform("__pairs", lambda x: x["match"])
    split = F.col("__pairs").isNotNull()
    cut = cut.select(*own, F.when(split, matches).otherwise(F.col("__match")).alias("__match"), F.when(split, gaps).otherwise(F.col("__gap")).alias("__gap"), secret.alias("__key"))
    keyed = F.col("__key")

    def judge(m: Column) -> Column:
        return let(_coded(m), lambda x: F.struct(x["kind"].alias("kind"), F.when(x.isNull(), m).otherwise(let(_permuted(keyed, x), lambda p: _written(keyed, m, x, p))).alias("to")))

    judged = cut.select("*", F.transform("__match", judge).alias("__judged"))
    spans = F.when(some, F.transform(placed(F.col("__gap"), F.col("__match")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    text_ = F.when(some, F.array_join(F.flatten(F.zip_with("__gap", "__judged", lambda g, j: F.array(g, F.coalesce(j["to"], F.lit(""))))), "")).otherwise(value)
    merged = F.zip_with("__judged", "__spans", lambda j, s: F.struct(j["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), j["to"].alias("pseudonym")))
    named = judged.select("*", spans.alias("__spans")).select(*own, text_.alias("__text"), merged.alias("__all"))
    return named.select(*own, "__text", F.filter("__all", lambda x: x["kind"].isNotNull()).alias("__pii"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, pii)``, one row for each row of the input; ``pii`` lists (kind, start, end, pseudonym).

    start and end are code points of the original text. Null text stays null with null or
    no findings; empty text stays empty. Candidates that don't validate stay as they are.
    Long texts are searched whole, in time linear in their length and findings. Where two
    kinds could match at one place, the first listed in ``PATTERNS`` does. Repeated rows give
    repeated results; further columns are not read; an empty table gives none.
    """
    rows = pseudonymised(narrow(docs, doc_id=id_col, text=text_col), "text", key)
    return rows.select("doc_id", F.col("__text").alias("text"), F.col("__pii").alias("pii"))


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their text pseudonymised (and its length, where that column exists); all columns stay.

    Rows are treated as by :func:`pseudonymise`, one for each row of the input, whatever
    further columns there are.
    """
    names = docs.columns
    at = names.index(text_col)
    rows = pseudonymised(numbered(docs), f"__c{at}", key)
    columns = [F.col("__text") if i == at else F.char_length("__text").cast(docs.schema[i].dataType) if length_col and name == length_col else F.col(f"__c{i}") for i, name in enumerate(names)]
    return rows.select(*columns).toDF(*names)
