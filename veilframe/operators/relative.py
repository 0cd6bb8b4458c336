"""Dates told by their distance: what kind of phrase, which date it means, and the month word it needs after a shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.dates import NUMBER_WORDS, parse_date, render_date, shape_of, study_offset
from veilframe.operators.shared import kept

# Month and weekday names, and the phrases that a relative date may have.
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
STUDY_DAY = r"^Day (-?\d{1,9})$"
FOLLOWING = rf"^the following ({'|'.join(WEEKDAYS)})$"
DISTANCE = rf"^([A-Za-z]+|\d{{1,9}}) (day|days|week|weeks) (after|before) the (?:(?:({'|'.join(MONTHS)}) )?(?:visit|assessment)|first dose visit)$"


def classified(rows: DataFrame, text: str) -> DataFrame:
    """rows with written, shape, kind, days and month of a text column.

    kind is absolute, study_day, weekday, prose or null; written is the date of an absolute one. days is a study day's
    number or a distance, month the month's name where the phrase has one. Steps are columns of their own, so that no
    expression is repeated inside another.
    """
    t = F.col(text)
    low = F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    out = rows.withColumn("_low", low).withColumn("written", parse_date(t)).withColumn("shape", shape_of(t))
    out = out.withColumns({f"_{i}": F.regexp_extract("_low", DISTANCE, i) for i in range(1, 5)})
    words = F.array(*map(F.lit, NUMBER_WORDS))
    n = F.coalesce(F.col("_1").try_cast("int"), F.nullif(F.array_position(words, F.lower("_1")).cast("int"), F.lit(0)))
    out = out.withColumn("_n", n).withColumn("_day", F.regexp_extract(t, STUDY_DAY, 1))
    kind = (
        F.when(F.col("written").isNotNull(), "absolute").when(F.col("_day") != "", "study_day").when(t.rlike(FOLLOWING), "weekday")
        .when((F.col("_3") != "") & F.col("_n").isNotNull(), "prose")
    )
    out = out.withColumn("kind", kind)
    distance = F.col("_n") * F.when(F.col("_2").startswith("week"), 7).otherwise(1) * F.when(F.col("_3") == "before", -1).otherwise(1)
    days = F.when(F.col("kind") == "study_day", F.col("_day").try_cast("int")).when(F.col("kind") == "prose", distance)
    out = out.withColumn("days", days).withColumn("month", F.when(F.col("kind") == "prose", F.nullif(F.col("_4"), F.lit(""))))
    return out.drop("_low", "_1", "_2", "_3", "_4", "_n", "_day")


def entity_dates(forms: DataFrame) -> DataFrame:
    """(scope_id, who, day): each entity's most frequent date, the earlier one in ties. forms(scope_id, who, written, n)."""
    days = forms.select("scope_id", "who", F.col("written").alias("day"), "n").where("day is not null")
    counts = days.groupBy("scope_id", "who", "day").agg(F.sum("n").alias("n"))
    return counts.groupBy("scope_id", "who").agg(F.min_by("day", F.struct((-F.col("n")).alias("n"), "day")).alias("day"))


def study_dates(phrases: DataFrame, dates: DataFrame) -> DataFrame:
    """(scope_id, who, day) of entities that are told as 'Day N' only. phrases(scope_id, who, days).

    The first dose is the one date of the scope that agrees with all 'Day N' of entities whose date is known; where
    none is known, the scope's only date. Without such a date nothing is inferred.
    """
    known = phrases.join(dates, ["scope_id", "who"]).select("scope_id", F.date_sub("day", study_offset(F.col("days"))).alias("dose"))
    implied = known.groupBy("scope_id").agg(F.min("dose").alias("dose"), F.max("dose").alias("other"))
    agreed = implied.where("dose = other").join(dates.select("scope_id", F.col("day").alias("dose")).distinct(), ["scope_id", "dose"], "left_semi")
    alone = dates.groupBy("scope_id").agg(F.min("day").alias("dose"), F.max("day").alias("other")).where("dose = other")
    first = agreed.select("scope_id", "dose").unionByName(alone.join(implied, "scope_id", "left_anti").select("scope_id", "dose"))
    open_ones = phrases.join(dates, ["scope_id", "who"], "left_anti")
    return open_ones.join(first, "scope_id").groupBy("scope_id", "who").agg(F.min(F.date_add("dose", study_offset(F.col("days")))).alias("day"))


def rendered(forms: DataFrame, unresolved: str = "drop") -> DataFrame:
    """forms(scope_id, who, old, n, shift) of dates -> (scope_id, who, old, new, note).

    Written dates move and keep their shape. 'Day N' and 'the following Tuesday' stay, as a shift of whole weeks keeps
    them true. A distance from a month's visit gets the month that its anchor moves to: by the entity's date, else by
    what 'Day N' tells, else by the scope's dates of that month if they move to one month. Otherwise the month word
    is dropped, or kept if unresolved is `keep`, and the note is `dropped` or `stale`. What is none of these stays, with the note `unparsed`.
    """
    each = kept(classified(forms, "old"), "phrases")
    dates = kept(entity_dates(each), "entity-dates")
    told = study_dates(each.where("kind = 'study_day'").select("scope_id", "who", "days"), dates)
    target = dates.unionByName(told)
    months = dates.join(each.select("scope_id", "shift").distinct(), "scope_id")
    moved = F.date_format(F.date_add("day", F.col("shift")), "MMMM")
    months = months.groupBy("scope_id", F.date_format("day", "MMMM").alias("month")).agg(F.min(moved).alias("a"), F.max(moved).alias("b"))
    months = months.where("a = b").select("scope_id", "month", F.col("a").alias("by_month"))
    prose = each.where("month is not null").join(target, ["scope_id", "who"], "left").join(months, ["scope_id", "month"], "left")
    anchor = F.date_sub("day", F.col("days"))
    new_month = F.coalesce(F.date_format(F.date_add(anchor, F.col("shift")), "MMMM"), "by_month")
    swapped = F.regexp_replace("old", F.concat(F.lit(r"\b"), F.col("month"), F.lit(r"\b")), new_month)
    dropped = F.regexp_replace("old", F.concat(F.lit(r"\b"), F.col("month"), F.lit(" ")), F.lit(""))
    prose = prose.select(
        "scope_id", "who", "old", F.coalesce(swapped, dropped if unresolved == "drop" else F.col("old")).alias("new"),
        F.when(new_month.isNotNull(), "month").otherwise("dropped" if unresolved == "drop" else "stale").alias("note"),
    )
    plain = each.where("month is null").select(
        "scope_id", "who", "old",
        F.when(F.col("kind") == "absolute", render_date(F.date_add("written", F.col("shift")), F.col("shape")))
        .otherwise(F.col("old")).alias("new"),
        F.when(F.col("kind").isNull(), "unparsed").alias("note"),
    )
    return prose.unionByName(plain)
