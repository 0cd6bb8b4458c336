"""Absolute dates in five shapes, study days, and dates told in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes (by name, pattern of the text, format).
SHAPES = (
    ("long", r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"),
    ("dmy", r"^\d{2}-[A-Z][a-z]{2}-\d{4}$", "dd-MMM-yyyy"),
    ("us", r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    ("iso", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    ("mdy_long", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def shape_of(text: Column) -> Column:
    """The name of the text's shape, or null; the calendar is not looked at."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(SHAPES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def parse_date(text: Column) -> Column:
    """The date of a text in one of the shapes; null for other shapes and days the calendar lacks."""
    return F.coalesce(*(F.when(text.rlike(p), F.try_to_date(text, f)) for _, p, f in SHAPES))


def render_date(day: Column, shape: Column) -> Column:
    """The day written in a shape: parse_date's inverse."""
    out = F.lit(None).cast("string")
    for name, _, form in SHAPES:
        out = F.when(shape == name, F.date_format(day, form)).otherwise(out)
    return out


def study_day(delta: Column) -> Column:
    """Day 1 is the first dose; there is no day 0."""
    return F.when(delta >= 0, delta + 1).otherwise(delta)


def study_offset(day: Column) -> Column:
    """study_day's inverse; day 0 counts as the first dose."""
    return F.when(day > 0, day - 1).otherwise(day)


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def number_word(n: Column) -> Column:
    words = F.array(*map(F.lit, NUMBER_WORDS))
    return F.coalesce(F.try_element_at(words, F.when((n >= 1) & (n <= 12), n.cast("int"))), n.cast("string"))


def prose_interval(days: Column, anchor: Column) -> Column:
    """'three weeks after the March visit'; whole weeks from 14 days on, else days."""
    weeks = (F.abs(days) >= 14) & (F.abs(days) % 7 == 0)
    n = F.when(weeks, F.abs(days) / 7).otherwise(F.abs(days)).cast("int")
    unit = F.concat(F.when(weeks, "week").otherwise("day"), F.when(n == 1, "").otherwise("s"))
    side = F.when(days < 0, "before").otherwise("after")
    return F.concat_ws(" ", number_word(n), unit, side, F.lit("the"), F.date_format(anchor, "MMMM"), F.lit("visit"))


def cap_age(text: Column, cap: int = 90, label: str | None = None) -> Column:
    """The first number, if the cap or more, becomes the label, '<cap>+' by default; the rest of the text stays."""
    first = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(
        (first != "") & (first.try_cast("int") >= cap),
        F.regexp_replace(text, r"^(\D*)\d+(?s:(.*))$", "$1" + (label or f"{cap}+").replace("\\", "\\\\").replace("$", "\\$") + "$2"),
    ).otherwise(text)
