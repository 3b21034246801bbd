"""Opening hours: a week as seven lists of minute ranges, and whether it is open at a moment."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: days as written in opening hours
DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
WEEK = T.ArrayType(T.ArrayType(_SPAN))
_WEEK_ARROW = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _days(spec: str) -> set[int] | None:
    out: set[int] = set()
    for part in spec.split(","):
        ends = part.strip().split("-")
        if part.strip() in ("ph", "sh"):
            continue
        if len(ends) > 2 or any(e not in DAYS for e in ends):
            return None
        a, b = DAYS.index(ends[0]), DAYS.index(ends[-1])
        out |= {(a + k) % 7 for k in range((b - a) % 7 + 1)}
    return out


def parse(text: str | None) -> list[list[dict]] | None:
    """Week of a schedule such as ``Mo-Fr 09:00-12:00,14:00-19:00; Sa off``; None if it cannot be read, also where days come
    without times. A + after an end (or later) says nothing more.

    A later rule replaces the days it names; a range that ends before it starts runs past midnight."""
    value = (text or "").strip().lower()
    if not value:
        return None
    if value == "24/7":
        return [[{"start": 0, "stop": 1440}] for _ in DAYS]
    week: list[list[dict]] = [[] for _ in DAYS]
    for rule in filter(None, (r.strip() for r in value.split(";"))):
        m = re.fullmatch(r"((?:(?:mo|tu|we|th|fr|sa|su|ph|sh)[-, ]*)+)?\s*(off|closed|[0-9:,+\s-]+)?", rule)
        if not m or not (m[1] or m[2]):
            return None
        days = _days(m[1].strip().strip(",").replace(" ", "")) if m[1] else set(range(7))
        if days is None:
            return None
        spans = []
        if m[2] in ("off", "closed"):
            spans = []
        elif not m[2] or not m[2].strip():
            if days:
                return None
        else:
            for part in m[2].split(","):
                t = re.fullmatch(r"\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\+?\s*", part)
                if not t or int(t[1]) > 24 or int(t[3]) > 24 or int(t[2]) > 59 or int(t[4]) > 59:
                    return None
                a, b = int(t[1]) * 60 + int(t[2]), int(t[3]) * 60 + int(t[4])
                spans.append({"start": a, "stop": b if b > a else b + 1440})
        for k in days:
            week[k] = spans
    return week


@F.arrow_udf(WEEK)
def opening_week(text: pa.Array) -> pa.Array:
    return pa.array([parse(v) for v in text.to_pylist()], _WEEK_ARROW)


def is_open(week: Column, day: Column, minute: Column) -> Column:
    """Whether a week is open on a day (0 is Monday) at a minute; ranges past midnight count for the next day."""
    today, before = F.get(week, day), F.get(week, (day + 6) % 7)
    return F.exists(today, lambda s: (s["start"] <= minute) & (minute < s["stop"])) | F.exists(before, lambda s: minute < s["stop"] - 1440)


def next_opening(week: Column, day: Column, minute: Column) -> Column:
    """struct<days, minute>: how many days ahead and when a week opens next, after this minute; null if it never does."""

    def first(offset: Column) -> Column:
        starts = F.transform(F.get(week, ((day + offset) % 7).cast("int")), lambda s: s["start"])
        soon = F.array_min(F.filter(starts, lambda s: (offset > 0) | (s > minute)))
        return F.when(soon.isNotNull(), F.struct(offset.alias("days"), soon.alias("minute")))

    return F.array_min(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(6)), first)))
