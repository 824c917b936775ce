"""Places of pattern matches, in SQL functions and in time linear in the number of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvane.functions.binding import let

#: Elements that are gathered at once: each step copies what its part has so far, and each part what came before.
PART = 128


def scan(values: Column, zero: Column, out_type: str, step: Callable[[Column, Column], Column]) -> Column:
    """The ``out`` of each ``step(state, value)``, a struct of state and out, from left to right.

    An aggregate that appends to one array copies the whole of it at each step. Here the array
    is dealt with in parts of ``PART`` values, and the parts are joined once.
    """

    def within(state: Column, part: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("outs"))
        add = lambda s, x: let(step(s["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(s["outs"], F.array(r["out"])).alias("outs")))
        return F.aggregate(part, start, add)

    def of(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / PART).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * PART + 1, F.lit(PART)))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
        add = lambda s, part: let(within(s["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(s["outs"], F.array(r["outs"])).alias("outs")))
        return F.flatten(F.aggregate(parts, start, add)["outs"])

    return let(values, of)


def running(lengths: Column) -> Column:
    """The sums of an array of integers up to each of them."""
    return scan(lengths, F.lit(0), "int", lambda s, n: let(s + n, lambda t: F.struct(t.alias("state"), t.alias("out"))))


def placed(gaps: Column, matches: Column) -> Column:
    """(start, end, m) of each match, in code points; ``gaps`` are the texts before each match and after the last."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.char_length(g) + F.char_length(m))
    return F.zip_with(running(lengths), matches, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("m")))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, m) of the pattern's matches, leftmost and non-overlapping, in code points."""
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda matches: F.when(F.size(matches) == 0, none).otherwise(placed(F.split(text, pattern), matches)))
