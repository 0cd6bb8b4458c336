"""Mentions in texts: offsets, numbering, overlaps, gaps, rebuilt texts and needles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from veilframe.functions.keyed import hmac_hex
from veilframe.operators.shared import kept


def with_scope(docs: DataFrame) -> DataFrame:
    """scope_id: the bundle of a bundled document, else the document itself."""
    return docs.withColumn("scope_id", F.coalesce("bundle_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))


@F.pandas_udf(ArrayType(LongType()))
def _starts(text: pd.Series) -> pd.Series:
    """The places (from 0) of a text's tokens between single spaces."""

    def places(t):
        return np.append(0, np.flatnonzero(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") == 32) + 1)

    return pd.Series([None if t is None else places(t) for t in text], dtype=object)


def _cut(text: str) -> Column:
    """The tokens of a text in order, as structs of token and start, found within its row."""
    return F.arrays_zip(F.split(text, " ").alias("token"), _starts(text).alias("start"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, start, token): texts cut at single spaces; start is the token's place from 0."""
    each = docs.select("doc_id", F.posexplode(_cut("text")).alias("ord", "t"))
    return each.select("doc_id", "ord", "t.start", "t.token")


def mention_type(token: Column) -> Column:
    return (
        F.when(token.contains("@"), "CONTACT").when(token.rlike("[0-9]{6,}"), "ID").when(token.rlike("^[A-Z][a-z]+$"), "PATIENT")
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, start, end, text, type, entity_id) of tokens that look like a name, number or address."""
    found = tokens(docs).withColumn("type", mention_type(F.col("token"))).where("type is not null")
    return found.select(
        "doc_id", "ord", "start", (F.col("start") + F.length("token")).alias("end"), F.col("token").alias("text"), "type",
        F.col("token").alias("entity_id"),
    )


def listed(text: str) -> Column:
    """The mentions of a text in order, as structs of start, end, text, type and entity_id, found within its row; null has none."""
    typed = F.transform(_cut(text), lambda t: F.struct(t["start"].alias("start"), t["token"].alias("text"), mention_type(t["token"]).alias("type")))
    whole = F.transform(
        F.filter(typed, lambda m: m["type"].isNotNull()),
        lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text"), m["type"].alias("type"), m["text"].alias("entity_id")),
    )
    return F.coalesce(whole, F.expr("cast(array() as array<struct<start: bigint, end: bigint, text: string, type: string, entity_id: string>>)"))


def renumber(found: DataFrame, scope: str = "doc_id", order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """E1, E2, ... by first appearance of each entity within its scope."""
    firsts = found.groupBy(scope, "entity_id").agg(F.min(F.struct(*order)).alias("first"))
    rank = F.dense_rank().over(Window.partitionBy(scope).orderBy("first", "entity_id"))
    ids = firsts.select(scope, "entity_id", F.concat(F.lit("E"), rank.cast("string")).alias("new_id"))
    return found.join(ids, [scope, "entity_id"])


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans that start before the greatest end of earlier spans of their document."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("end").over(before)).where("start < reached").drop("reached")


def gaps(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, gap): the text before each mention, and the tail after the last."""
    order = Window.partitionBy("doc_id").orderBy("start")
    after = found.select("doc_id", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("a"), F.col("start").alias("b"))
    ends = found.groupBy("doc_id").agg(F.max("end").alias("a"))
    tails = docs.join(ends, "doc_id", "left").select(
        "doc_id", F.coalesce("a", F.lit(0)).alias("a"), F.length("text").cast("long").alias("b")
    )
    cut = after.unionByName(tails).join(docs.select("doc_id", "text"), "doc_id")
    return cut.select("doc_id", F.col("a").alias("start"), F.expr("substring(text, int(a) + 1, int(b - a))").alias("gap"))


def replaced(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, new_text, n_replaced): each mention replaced by 'X' and eight digits of its keyed hash.

    A text is cut and put together again within its row; null texts have no row."""

    def new(token):
        digest = hmac_hex(token) if key is None else hmac_hex(token, key)
        return F.when(mention_type(token).isNull(), token).otherwise(F.concat(F.lit("X"), F.substring(digest, 1, 8)))

    each = docs.where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    hits = F.size(F.filter("w", lambda t: mention_type(t).isNotNull())).cast("long")
    return each.select("doc_id", F.array_join(F.transform("w", new), " ").alias("new_text"), hits.alias("n_replaced"))


def needle_hits(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """Words of documents that are needles of their scope: an equi-join on (scope, word), never scope by scope."""
    words = docs.select("scope_id", "doc_id", F.explode(F.split("text", r"[^A-Za-z0-9@.]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("scope_id", "doc_id", "word").count()
    return counted.join(needles.select("scope_id", F.col("text").alias("word")).distinct(), ["scope_id", "word"])


def _spelt(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase_hits(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """(scope_id, doc_id, phrase, n): how often a phrase of a scope stands in its documents as whole words, in any case.

    needles(scope_id, phrase), docs(scope_id, doc_id, text). A place meets the one row of its word among the first words
    of its scope's phrases, which tells their sizes; its runs of so many words then meet the phrases as a whole, so places
    of a frequent word do not meet all phrases that begin with it. What stands between words does not count. Null texts
    and phrases without a word meet nothing.
    """
    # tables of their own, so that their sizes are known: what is small meets the texts where they are, as scopes may be few
    # and large
    asked = kept(needles.select("scope_id", "phrase").distinct(), "phrases")
    sought = asked.select("scope_id", "phrase", _spelt(F.col("phrase")).alias("p")).where(F.size("p") > 0)
    sought = kept(sought.select("scope_id", "phrase", F.get("p", F.lit(0)).alias("word"), F.size("p").alias("size"), F.array_join("p", " ").alias("run")), "sought")
    firsts = kept(sought.groupBy("scope_id", "word").agg(F.collect_set("size").alias("sizes")), "first-words")
    # as many words travel with a place as the longest phrase of its scope has
    most = kept(sought.groupBy("scope_id").agg(F.max("size").alias("most")), "phrase-sizes")
    words = docs.join(most, "scope_id").select("scope_id", "doc_id", "most", _spelt(F.col("text")).alias("w"))
    places = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.slice("w", i + 1, F.col("most")).alias("next")))
    each = words.select("scope_id", "doc_id", F.explode(places).alias("x")).select("scope_id", "doc_id", "x.word", "x.next").join(firsts, ["scope_id", "word"])
    runs = each.select("scope_id", "doc_id", "next", F.explode("sizes").alias("size")).where(F.size("next") >= F.col("size"))
    runs = runs.select("scope_id", "doc_id", F.array_join(F.slice("next", F.lit(1), F.col("size")), " ").alias("run"))
    found = runs.groupBy("scope_id", "doc_id", "run").agg(F.count("*").alias("n"))
    return found.join(sought.select("scope_id", "run", "phrase"), ["scope_id", "run"]).select("scope_id", "doc_id", "phrase", "n")


def uncovered(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits that lie in no labelled span of their document."""
    s = spans.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return hits.join(s, (F.col("doc_id") == F.col("d")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left_anti")


def overlapping(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs (span, hit) of a document that share a character."""
    h = hits.select(F.col("doc_id").alias("d"), F.col("start").alias("hit_start"), F.col("end").alias("hit_end"))
    meet = (F.col("start") < F.col("hit_end")) & (F.col("hit_start") < F.col("end"))
    return spans.join(h, (F.col("doc_id") == F.col("d")) & meet).drop("d")
