"""Positions of regular-expression matches, built from SQL functions only.

Java's split() and find() see the same leftmost non-overlapping matches, so the pieces between them
and the matches themselves give every position. Patterns use possessive repeats and look-behind, so
that they run in linear time and without recursion on any text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches (or one group of each); an empty array without any. Null for a null text."""
    none = F.array().cast("array<string>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def gaps(text: Column, pattern: str, matches: Column) -> Column:
    """What stands before each match, and after the last; only split where there are matches."""
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def starts(matches: Column, between: Column) -> Column:
    """Start of each match in code points."""
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        steps, zero,
        lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["g"])).alias("all")),
        lambda s: s["all"],
    )


def spans(kind: int, matches: Column, begins: Column, sound) -> Column:
    """array<struct<start, kind, stop>> of the matches that sound(match, index) accepts."""
    pairs = F.transform(matches, lambda m, i: F.struct(F.element_at(begins, i + 1).alias("start"), F.lit(kind).alias("kind"), (F.element_at(begins, i + 1) + F.length(m)).alias("stop"), sound(m, i).alias("ok")))
    return F.transform(F.filter(pairs, lambda p: p["ok"]), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")))


def written(sorted_spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(all_spans: Column, kind: int) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")


NO_SPANS = "array<struct<start:int,kind:int,stop:int>>"
