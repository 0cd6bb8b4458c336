"""Benchmark decontamination with DataFrame functions only.

Every window of 13 benchmark words is filed under its longest word. The corpus is split into words
once, each word probes the broadcast hash table of filed words inside the same scan stage, and only
the few words found are checked against the whole window. Hits come back to their document with one
shuffle; an empty first word that every document has makes documents without hits come along.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored

#: Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: cut at all else, capitals kept for now.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows that may be broadcast; a larger benchmark is joined by shuffles instead.
BROADCAST_WINDOWS = 200_000


def _lowered(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), string.ascii_uppercase, string.ascii_lowercase)


def _split(text: Column) -> Column:
    """['', word, ..., word, '']"""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, place, size, normal, items): distinct windows, the filed word and its place in the window."""
    words = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), _split(F.col("text")).alias("w")
    )
    words = words.select("item", F.slice("w", F.lit(2), F.size("w") - 2).alias("w")).where(F.size("w") > 0)
    parts = words.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))),
                lambda i: F.slice(F.col("w"), i, F.least(F.size("w"), F.lit(window))),
            )
        ).alias("w"),
    )
    lengths = F.transform("w", F.length)
    place = (F.array_position(lengths, F.array_max(lengths)) - 1).cast("int")
    return (
        parts.select("item", _lowered(F.col("w")).alias("normal"), F.size("w").alias("size"), place.alias("place"))
        .groupBy("normal", "size", "place")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("key", F.lower(F.element_at(F.split("normal", " "), F.col("place") + 1)))
    )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    n_hit counts the document's words inside any occurrence of a benchmark window, n_items the items
    with an occurring window, items_sha256 digests their ids (sorted as strings, comma-joined);
    contaminated means n_hit > 0 and 20 * n_hit >= n_words; spans are the occurrences (first word
    from 0, words). Null and empty texts have no words; an item of fewer than 13 words is one window,
    null items and items without words none. Repeated rows each get their row. Other columns are ignored.
    """
    windows = stored(benchmark_windows(benchmark, window), "windows")
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    first = docs.sparkSession.range(1).select(
        F.lit("").alias("key"), F.lit(0).alias("place"), F.lit(0).alias("size"),
        F.lit(None).cast("string").alias("normal"), F.array().cast("array<string>").alias("items"),
    )
    filed = windows.select("key", "place", "size", "normal", "items").unionByName(first)
    split = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("h"), F.length("text").alias("n"), _split(F.col("text")).alias("w")
    )
    each = split.select("doc_id", "h", "n", "w", (F.size("w") - 2).alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("place")
    fits = (start >= 1) & (start + F.col("size") <= F.col("n_words") + 1)
    if few:
        found = each.join(F.broadcast(filed), F.lower("word") == F.col("key"))
        same = _lowered(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size"))) == F.col("normal")
    else:
        near = each.select(
            "doc_id", "h", "n", "n_words", "pos", "word",
            F.slice("w", F.greatest(F.col("pos") - window + 2, F.lit(1)), F.lit(2 * window - 1)).alias("near"),
        )
        found = near.where("word <> '' or pos = 0").join(filed, F.lower("word") == F.col("key"))
        begin = F.least(F.col("pos"), F.lit(window - 1)) - F.col("place")
        same = _lowered(F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.col("size"))) == F.col("normal")
    is_first = F.col("normal").isNull()
    hits = found.where(F.when(is_first, F.col("pos") == 0).otherwise(fits & same)).select(
        "doc_id", "h", "n", "n_words", "items", is_first.cast("long").alias("rows"),
        F.when(~is_first, F.struct((start - 1).alias("start"), F.col("size").alias("size"))).alias("span"),
    )
    by_doc = hits.groupBy("doc_id", "h", "n", "n_words").agg(
        F.sum("rows").alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["sum"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("sum"),
        ),
        lambda a: a["sum"].cast("long"),
    )
    out = by_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "spans",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"),
    )
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )
