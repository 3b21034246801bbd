"""Values of feeds that come as text, brought to their types; null where a value says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how feeds spell yes and no
YES, NO = ("yes", "true", "1", "oui"), ("no", "false", "0", "non")
SURVEY_YES, SURVEY_NO = ("1", "true", "yes", "oui", "vrai"), ("0", "false", "no", "non", "faux")


def text(c: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def flag(c: Column, yes: tuple[str, ...] = YES, no: tuple[str, ...] = NO) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*yes), True).when(word.isin(*no), False)


def width(c: Column) -> Column:
    """A positive number of metres, with or without the unit."""
    value = F.regexp_extract(c, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*m?\s*$", 1).try_cast("double")
    return F.when(value > 0, value)


def lanes(c: Column) -> Column:
    """A positive whole number at the start."""
    value = F.regexp_extract(F.trim(c), r"^([+-]?[0-9]+)", 1).try_cast("int")
    return F.when(value > 0, value)


def max_speed(c: Column) -> Column:
    """The whole number at the start; 50.5 is 50."""
    return F.regexp_extract(F.trim(c), r"^([0-9]+)", 1).try_cast("int")


def population(c: Column) -> Column:
    """All digits as one number."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def finite(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def importance(c: Column) -> Column:
    """A whole number from 1 to 6."""
    value = c.try_cast("double")
    return F.when((value == F.floor(value)) & value.between(1, 6), value.cast("int"))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Rounded with halves towards plus infinity."""
    by = 10.0**digits
    return F.floor(c * by + 0.5) / by


def kilometres(metres: Column) -> Column:
    """4.2 km below ten kilometres, 12 km beyond. The tenth is that of the double's exact value, as printf gives it: 5.55, which is a little less, is 5.5,
    and halves (9.25) go to the even tenth."""
    km = F.abs(metres / 1000)
    low = F.floor(km * 10)
    # twenty times the distance to the half between two tenths; both differences are exact
    past = (km * 16 - (low * 2 + 1)) + km * 4
    tenths = low + F.when((past > 0) | (past == 0) & (low % 2 == 1), 1).otherwise(0)
    whole = F.format_string("%d km", F.floor(metres / 1000 + 0.5).cast("long"))
    short = F.concat(F.when(metres < 0, "-").otherwise(""), F.format_string("%d.%d km", F.floor(tenths / 10).cast("long"), (tenths % 10).cast("long")))
    return F.when(metres / 1000 >= 10, whole).otherwise(short)
