"""Mentions found again: anchors (text, n-th occurrence) in their text, and ordered mentions in a changed text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from veilframe.operators import contracts, metrics
from veilframe.operators.shared import pinned

_SPAN = "struct<start: bigint, end: bigint, text: string, type: string, entity_id: string>"


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def occurrences(text: pd.Series, needles: pd.Series) -> pd.Series:
    """For each needle of a text its places (from 0) in order, overlaps counted. The text travels once for all."""

    def places(t, needle):
        out, at = [], t.find(needle) if needle else -1
        while at >= 0:
            out.append(at)
            at = t.find(needle, at + 1)
        return out

    return pd.Series([None if t is None or ns is None else [places(t, n) for n in ns] for t, ns in zip(text, needles, strict=True)])


def located(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """docs(doc_id, text), anchored(doc_id, mentions: array of text, n, type, id) -> doc_id, located, unlocatable.

    located has start, end, text, type and entity_id; a mention whose text does not occur n times is unlocatable and
    moved to no other place. A row of anchored without its document, or with a null text, locates nothing.
    """
    each = anchored.select("doc_id", "mentions").join(docs.select("doc_id", "text"), "doc_id", "left")
    each = pinned(each.withColumn("needles", F.array_distinct(F.transform("mentions", lambda m: m["text"]))))
    each = each.withColumn("index", occurrences("text", "needles"))
    starts = lambda m: F.get("index", F.array_position("needles", m["text"]).cast("int") - 1)
    placed = F.transform("mentions", lambda m: F.struct(m.alias("m"), F.get(starts(m), (m["n"] - 1).cast("int")).alias("at")))
    each = each.select("doc_id", placed.alias("p"))
    found = F.transform(
        F.filter("p", lambda x: x["at"].isNotNull()),
        lambda x: F.struct(
            x["at"].alias("start"), (x["at"] + F.length(x["m"]["text"])).alias("end"), x["m"]["text"].alias("text"), x["m"]["type"].alias("type"), x["m"]["id"].alias("entity_id")
        ),
    )
    return each.select("doc_id", found.alias("located"), F.transform(F.filter("p", lambda x: x["at"].isNull()), lambda x: x["m"]).alias("unlocatable"))


def from_predictions(docs: DataFrame, predictions: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """Mentions (doc_id, start, end, type, entity_id) of documents whose prediction can be used, and the others' problems.

    predictions(doc_id, raw_output) by the contract `spans` or `anchors`. Problems are (doc_id, problem):
    no_prediction, the reason of a void output, unlocatable, or unknown_document. A document has one or none.
    """
    known = docs.select("doc_id", F.length("text").alias("size"))
    each = known.withColumn("known", F.lit(True)).join(predictions.select("doc_id", "raw_output", F.lit(True).alias("answered")), "doc_id", "full_outer")
    parsed = contracts.parse_anchored("raw_output") if contract == "anchors" else contracts.parse_spans(F.col("raw_output"), F.col("size"))
    each = each.withColumn("x", parsed)
    early = F.when(F.col("known").isNull(), "unknown_document").when(F.col("answered").isNull(), "no_prediction").otherwise(F.col("x.error"))
    each = each.select("doc_id", early.alias("problem"), F.col("x.mentions").alias("mentions"))
    good = each.where("problem is null")
    if contract == "anchors":
        good = located(docs, good)
        lost = good.where(F.size("unlocatable") > 0).select("doc_id", F.lit("unlocatable").alias("problem"))
        good = good.where(F.size("unlocatable") == 0).withColumnRenamed("located", "mentions")
    else:
        lost = each.limit(0).select("doc_id", "problem")
        good = good.withColumn("mentions", F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["type"].alias("type"), m["id"].alias("entity_id"))))
    mentions = good.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", "m.end", "m.type", "m.entity_id")
    return mentions, each.where("problem is not null").select("doc_id", "problem").unionByName(lost)


def anchored_outcomes(gold: DataFrame, placed: DataFrame) -> DataFrame:
    """Outcomes of metrics.span_outcomes; every different unlocatable mention counts as a false positive of its type.

    gold(doc_id, start, end, type); placed: rows of located.
    """
    found = placed.select("doc_id", F.explode("located").alias("m")).select("doc_id", "m.start", "m.end", "m.type")
    lost = placed.select("doc_id", F.explode("unlocatable").alias("m")).select("doc_id", "m.text", "m.n", "m.type").distinct()
    lost = lost.select("doc_id", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "type", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return metrics.span_outcomes(gold, found, ["doc_id", "start", "end", "type"]).unionByName(lost)


def _count(text: Column, needle: Column) -> Column:
    """Occurrences without overlaps."""
    return (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)


def ordered(records: DataFrame) -> DataFrame:
    """records(..., text, new_text, mentions) with new_mentions and reason: mentions placed anew from left to right.

    mentions is an array of start, end, text, type and entity_id. Each mention, in the order of its old place, goes to
    its first occurrence behind the one before. The record is refused, new_mentions then being null, with the reason
    no_text, empty_mention, count_changed (a mention's text occurs more or less often than before) or not_found.
    """
    sorted_ms = F.array_sort(F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["type"].alias("type"), m["entity_id"].alias("entity_id"))))
    each = pinned(records.withColumn("_ms", sorted_ms))
    needles = F.array_distinct(F.transform("_ms", lambda m: m["text"]))
    changed = F.exists(needles, lambda n: _count(F.col("text"), n) != _count(F.col("new_text"), n))
    early = (
        F.when(F.col("text").isNull() | F.col("new_text").isNull(), "no_text").when(F.exists("_ms", lambda m: F.coalesce(m["text"], F.lit("")) == ""), "empty_mention")
        .when(changed, "count_changed")
    )
    each = each.withColumn("_early", early)

    def place(state, m):
        at = F.call_function("locate", m["text"], F.col("new_text"), (state["at"] + 1).cast("int")).cast("long") - 1
        lost = state["lost"] | (at < 0)
        end = at + F.length(m["text"])
        span = F.struct(at.alias("start"), end.alias("end"), m["text"].alias("text"), m["type"].alias("type"), m["entity_id"].alias("entity_id"))
        return F.struct(
            F.when(lost, state["at"]).otherwise(end).alias("at"), lost.alias("lost"),
            F.when(lost, state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("lost"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))
    each = each.withColumn("_folded", F.when(F.col("_early").isNull(), F.aggregate("_ms", start, place)))
    reason = F.coalesce("_early", F.when(F.col("_folded.lost"), "not_found"))
    return each.withColumn("reason", reason).withColumn("new_mentions", F.when(F.col("reason").isNull(), F.col("_folded.spans"))).drop("_ms", "_early", "_folded")


def paraphrased(records: DataFrame, rewrite: Callable[[str, list[str]], str]) -> DataFrame:
    """records(..., text, mentions) with new_text, new_mentions and reason; a refused record keeps its text and mentions.

    rewrite(text, protected) runs in Arrow batches on the executors; an error in it refuses the record only, with
    the reason error.
    """

    @F.pandas_udf("string")
    def call(text: pd.Series, protected: pd.Series) -> pd.Series:
        def one(t, p):
            try:
                return None if t is None else rewrite(t, list(p))
            except Exception:  # whatever the callable raises keeps the record as it was
                return None

        return pd.Series([one(t, p) for t, p in zip(text, protected, strict=True)], dtype=object)

    protected = F.transform(F.array_sort(F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text")))), lambda m: m["text"])
    moved = ordered(records.withColumn("new_text", call("text", protected)))
    kept = F.col("reason").isNull()
    failed = F.col("new_text").isNull() & F.col("text").isNotNull()
    return moved.select(
        *[c for c in records.columns], F.when(kept, F.col("new_text")).otherwise(F.col("text")).alias("new_text"),
        F.when(kept, F.col("new_mentions")).otherwise(F.transform("mentions", lambda m: F.struct(m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), m["text"].alias("text"), m["type"].alias("type"), m["entity_id"].alias("entity_id")))).alias("new_mentions"),
        F.when(failed, "error").otherwise(F.col("reason")).alias("reason"),
    )
