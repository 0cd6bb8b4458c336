"""Replacement of identifying mentions, the same in a whole scope, refusals, and the checks of what must be kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import vocabulary as V
from veilframe.functions.dates import cap_age, parse_date, weekday_name
from veilframe.functions.keyed import scope_keys, shift_days
from veilframe.functions.text import is_entity_type, is_generic
from veilframe.operators import profiles, relative
from veilframe.operators.shared import kept


@dataclass(frozen=True)
class Policy:
    """How types are handled: dates move by min_weeks to max_weeks, backward, forward or either way; ages of age_cap and
    more become age_label, or are kept; a month that cannot be resolved is dropped or kept."""

    min_weeks: int = 4
    max_weeks: int = 52
    direction: str = "backward"
    age: str = "cap"
    age_cap: int = 90
    age_label: str = "90+"
    unresolved_month: str = "drop"
    policy_id: str = "default"
    version: int = 0

    def shift(self, key: Column) -> Column:
        """A scope's days, from its key."""
        digest = F.sha2(F.concat_ws("|", key, F.lit("date-shift")), 256)
        days = shift_days(digest, self.min_weeks, self.max_weeks, 1)
        back = {"backward": F.lit(True), "forward": F.lit(False)}.get(self.direction, F.substring(digest, 60, 1).isin(*"01234567"))
        return F.when(back, -days).otherwise(days)


@dataclass(frozen=True)
class Run:
    """docs(doc_id, scope_id, text, mentions) of the scopes that passed, report of those that were worked on, and
    refused(scope_id, doc_id, reason): one row for each reason, doc_id null where it lies in the scope as a whole."""

    docs: DataFrame
    report: DataFrame
    refused: DataFrame


_NAMED = ("PATIENT", "INVESTIGATOR", "SITE", "LOCATION", "ID", "CONTACT")


def with_forms(docs: DataFrame, mentions: DataFrame, secret: bytes) -> DataFrame:
    """Mentions with their scope, its key, their text (old) and who: the entity, or the text itself where that is null."""
    keyed = docs.select("doc_id", "scope_id", "text", scope_keys(secret)(F.col("scope_id")).alias("key"))
    each = mentions.select("doc_id", "start", "end", "type", "entity_id").join(keyed, "doc_id")
    each = each.withColumn("old", F.expr("substring(text, int(start) + 1, int(end - start))")).drop("text")
    return each.withColumn("who", F.coalesce(F.col("entity_id").cast("string"), F.concat(F.lit("~"), F.lower("old"))))


def form_table(each: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(scope_id, type, who, old, n, new, note): what every distinct text of an entity becomes in its scope.

    each: rows of with_forms. Notes: generic, capped, month, dropped, unparsed, unclassified or null.
    """
    forms = each.groupBy("scope_id", "key", "type", "who", "old").agg(F.count("*").alias("n"))
    forms = kept(forms.where("old is not null"), "forms")
    plain = ~is_generic(F.col("old")) | F.col("type").isin("DATE", "AGE")
    dates = relative.rendered(forms.where("type = 'DATE'").select("scope_id", "who", "old", "n", policy.shift(F.col("key")).alias("shift")), policy.unresolved_month)
    dates = dates.select("scope_id", F.lit("DATE").alias("type"), "who", "old", "new", "note")
    aged = cap_age(F.col("old"), policy.age_cap, policy.age_label) if policy.age == "cap" else F.col("old")
    ages = forms.where("type = 'AGE'").select("scope_id", "type", "who", "old", aged.alias("new"), F.when(aged != F.col("old"), "capped").alias("note"))
    generic = forms.where(~plain).select("scope_id", "type", "who", "old", F.col("old").alias("new"), F.lit("generic").alias("note"))
    named = profiles.surrogates(forms.where(plain & F.col("type").isin(*_NAMED)))
    every = dates.unionByName(ages).unionByName(generic).unionByName(named)
    out = forms.select("scope_id", "type", "who", "old", "n").join(every, ["scope_id", "type", "who", "old"], "left")
    # what no rule wrote anew must not pass
    return kept(out.withColumn("note", F.when(F.col("new").isNull(), "unparsed").otherwise(F.col("note"))), "form-table")


def deidentify(docs: DataFrame, mentions: DataFrame, secret: bytes, policy: Policy = Policy()) -> DataFrame:
    """(doc_id, scope_id, text, mentions): mentions replaced, everything between them unchanged.

    docs(doc_id, scope_id, text), mentions(doc_id, start, end, type, entity_id), spans apart and inside their text
    (run refuses others). A scope is consistent: a form of an entity has one surrogate, all forms of a person tell
    one name, a site follows its city, numbers of sites agree with those in ids, dates move by the scope's whole
    weeks. Surrogates derive from HMAC(secret, scope) and the entity, and are held apart by joins, so no scope meets
    in one task. Mentions without an entity are known by their text. A document without mentions, or with a null
    text, stays as it is.
    """
    each = kept(with_forms(docs, mentions, secret), "mentions")
    return replaced(docs, each, form_table(each, policy))


def replaced(docs: DataFrame, each: DataFrame, table: DataFrame) -> DataFrame:
    """Documents with the new texts of their mentions, whose places are counted in the new text."""
    done = each.join(table.select("scope_id", "type", "who", "old", "new"), ["scope_id", "type", "who", "old"]).select(
        "doc_id", F.struct("start", "end", F.coalesce("new", "old").alias("new"), "old", "type", "entity_id").alias("m")
    )
    lists = done.groupBy("doc_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    out = docs.join(lists, "doc_id", "left").withColumn("ms", F.coalesce("ms", F.expr("cast(array() as " + _LIST + ")")))
    rebuilt = F.aggregate(
        "ms",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("spans")),
        lambda a, m: _step(a, m),
    )
    out = out.withColumn("r", rebuilt)
    return out.select(
        "doc_id", "scope_id", F.concat("r.text", F.expr("substring(text, int(r.at) + 1)")).alias("text"), F.col("r.spans").alias("mentions")
    )


def problems(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(scope_id, doc_id, reason) of mentions that cannot be replaced: unknown_type, out_of_range, overlap."""
    each = mentions.select("doc_id", "start", "end", "type").join(docs.select("doc_id", "scope_id", F.length("text").alias("size")), "doc_id")
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranged = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size"))
    each = each.withColumn("reached", F.max("end").over(before))
    reason = (
        F.when(~F.coalesce(is_entity_type(F.col("type")), F.lit(False)), "unknown_type").when(~F.coalesce(ranged, F.lit(False)), "out_of_range")
        .when(F.col("start") < F.col("reached"), "overlap")
    )
    return each.select("scope_id", "doc_id", reason.alias("reason")).where("reason is not null").distinct()


def run(docs: DataFrame, mentions: DataFrame, secret: bytes, policy: Policy = Policy()) -> Run:
    """Whole scopes or nothing: a scope with a mention that cannot be replaced, a date that cannot be read, or an
    original that is still in an output is refused, and no document of it is given out."""
    bad = kept(problems(docs, mentions), "problems")
    scopes = bad.select("scope_id").distinct()
    good = docs.join(scopes, "scope_id", "left_anti").select("doc_id", "scope_id", "text")
    each = kept(with_forms(good, mentions, secret), "mentions")
    table = form_table(each, policy)
    out = kept(replaced(good, each, table), "replaced")
    left = kept(residual_hits(each.select("scope_id", F.col("old").alias("text"), "type"), out), "residual")
    report = kept(scope_report(good, each, table, left), "report")
    failed = report.where("not ok")
    dates = failed.where("n_unparsed > 0").select("scope_id", F.lit("unparsed_date").alias("reason"))
    seen = left.join(failed.select("scope_id"), "scope_id", "left_semi").select("scope_id", "doc_id").distinct()
    refused = bad.unionByName(dates.select("scope_id", F.lit(None).cast(dict(bad.dtypes)["doc_id"]).alias("doc_id"), "reason"))
    refused = refused.unionByName(seen.select("scope_id", "doc_id", F.lit("residual").alias("reason")))
    # a table of its own, so that its size is known where it is joined
    gone = kept(failed.select("scope_id"), "failed")
    return Run(out.join(gone, "scope_id", "left_anti").select("doc_id", "scope_id", "text", "mentions"), report, refused)


def scope_report(docs: DataFrame, each: DataFrame, table: DataFrame, left: DataFrame) -> DataFrame:
    """One row a scope: documents, entities, mentions, forms by their notes, residual hits, and ok."""
    notes = ("generic", "capped", "month", "dropped", "unparsed", "unclassified")
    counted = table.groupBy("scope_id").agg(
        F.countDistinct("who").alias("n_entities"), *(F.sum(F.when(F.col("note") == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in notes)
    )
    sizes = each.groupBy("scope_id").agg(F.count("*").alias("n_mentions"))
    hits = left.groupBy("scope_id").agg(F.count("*").alias("n_residual"))
    out = docs.groupBy("scope_id").agg(F.count("*").alias("n_docs")).join(sizes, "scope_id", "left").join(counted, "scope_id", "left").join(hits, "scope_id", "left")
    names = ["n_docs", "n_mentions", "n_entities", *(f"n_{x}" for x in notes), "n_residual"]
    out = out.select("scope_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))
    return out.withColumn("ok", (F.col("n_unparsed") == 0) & (F.col("n_residual") == 0))


def publish(result: Run, path: str) -> None:
    """Documents, report and refusals under path, which appears only when all three are whole."""
    spark = result.docs.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(top):
        raise ValueError(f"{path} is there already")
    draft = f"{path.rstrip('/')}.draft"
    for name, df in (("docs", result.docs), ("report", result.report), ("refused", result.refused)):
        df.write.mode("overwrite").parquet(f"{draft}/{name}")
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), top):
        raise OSError(f"{draft} could not become {path}")


_LIST = "array<struct<start: bigint, end: bigint, new: string, old: string, type: string, entity_id: string>>"
_SPANS = "array<struct<start: bigint, end: bigint, text: string, type: string, entity_id: string>>"


def _step(a, m):
    gap = F.call_function("substring", F.col("text"), (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int"))
    begin = (F.length(a["text"]) + m["start"] - a["at"]).cast("long")
    span = F.struct(
        begin.alias("start"), (begin + F.length(m["new"])).cast("long").alias("end"), m["new"].alias("text"), m["type"].alias("type"),
        m["entity_id"].alias("entity_id"),
    )
    return F.struct(
        F.concat(a["text"], gap, m["new"]).alias("text"), m["end"].cast("long").alias("at"), F.concat(a["spans"], F.array(span)).alias("spans")
    )


#: Words that a name shares with any text, and that do not tell an original.
EXEMPT = sorted({*V.TITLES, *V.INSTITUTION_WORDS, *(w.lower() for c in V.COUNTRIES for w in c.split()), "of", "and", "in", "de", "la"})


#: Pieces and documents of a scope up to which its texts meet the pieces as a list.
IN_ROW = 256


def _pieces(text, exempt=tuple(EXEMPT)):
    """Lower-cased words of two characters or more but exempt ones, and runs of three digits or more, of a text."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*exempt))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(low, F.lit("([0-9]{3,})"), 1)))


def residual_hits(before: DataFrame, after: DataFrame, exempt: Sequence[str] = tuple(EXEMPT)) -> DataFrame:
    """(scope_id, doc_id, word): pieces of original mentions that stand in an output document of their scope.

    Dates, ages and generic references apart, a piece is a word of two characters or more, in any case, or a run
    of three digits or more, so a surviving phrase shows by its words; exempt words (titles, words of institutions and
    countries, unless others are given) and the 555 of a telephone number are none. before(scope_id, text, type), after(scope_id, doc_id, text). Pieces
    and words meet in an equi-join; in scopes of up to IN_ROW pieces and documents, each text meets its scope's list of
    pieces, with the same hits. Null texts have no pieces.
    """
    named = before.where(~F.col("type").isin("DATE", "AGE") & ~is_generic(F.col("text")))
    pieces = named.select("scope_id", "type", F.explode(_pieces(F.col("text"), exempt)).alias("word")).where("type <> 'CONTACT' or word <> '555'")
    pieces = kept(pieces.select("scope_id", "word").distinct(), "pieces")
    sizes = pieces.groupBy("scope_id").agg(F.count("*").alias("n")).unionByName(after.groupBy("scope_id").agg(F.count("*").alias("n")))
    large = kept(sizes.where(F.col("n") > IN_ROW).select("scope_id").distinct(), "large-scopes")
    seen = []
    if not large.isEmpty():
        own = after.join(large, "scope_id", "left_semi").select("scope_id", "doc_id", F.explode(_pieces(F.col("text"), exempt)).alias("word"))
        seen.append(own.join(pieces, ["scope_id", "word"]).select("scope_id", "doc_id", "word"))
    lists = kept(pieces.join(large, "scope_id", "left_anti").groupBy("scope_id").agg(F.collect_list("word").alias("own")), "piece-lists")
    if not seen or not lists.isEmpty():
        texts = after.join(large, "scope_id", "left_anti").select("scope_id", "doc_id", F.lower("text").alias("low")).join(lists, "scope_id")
        # a text is cut into words only if it contains one of them at all
        found = texts.withColumn("own", F.filter("own", lambda w: F.contains(F.col("low"), w)))
        hits = F.explode(F.when(F.size("own") > 0, F.array_intersect("own", _pieces(F.col("low"), exempt))))
        seen.append(found.select("scope_id", "doc_id", hits.alias("word")))
    return reduce(DataFrame.unionByName, seen).distinct()


def utility(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scope_id, n_mentions, n_kept, n_shifts, n_weekdays, ok): structure, one shift a scope, weekdays kept.

    before and after: (scope_id, doc_id, ord, text, type, entity_id), compared by position."""
    a = before.select("scope_id", "doc_id", "ord", F.col("text").alias("old"), F.col("type").alias("t"), F.col("entity_id").alias("e"))
    both = a.join(after.drop("scope_id"), ["doc_id", "ord"], "full_outer")
    d0, d1 = parse_date(F.col("old")), parse_date(F.col("text"))
    moved = F.when((F.col("t") == "DATE") & d0.isNotNull(), F.datediff(d1, d0))
    out = both.groupBy("scope_id").agg(
        F.count("*").alias("n_mentions"), F.count_if((F.col("t") == F.col("type")) & (F.col("e") == F.col("entity_id"))).alias("n_kept"),
        F.countDistinct(moved).alias("n_shifts"), F.count_if(weekday_name(d0) != weekday_name(d1)).alias("n_weekdays"),
    )
    ok = (F.col("n_mentions") == F.col("n_kept")) & (F.col("n_shifts") <= 1) & (F.col("n_weekdays") == 0)
    return out.withColumn("ok", ok)
