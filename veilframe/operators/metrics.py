"""Span scores, entity consistency, order statistics, apportionment and keyed orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.shared import kept


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def span_outcomes(gold: DataFrame, pred: DataFrame, span: list[str]) -> DataFrame:
    """Distinct spans of either side with tp, fp and fn as 0 or 1; span must hold the type."""
    g = gold.select(*span).distinct().withColumn("g", F.lit(1))
    p = pred.select(*span).distinct().withColumn("p", F.lit(1))
    g_in, p_in = F.col("g").isNotNull(), F.col("p").isNotNull()
    return g.join(p, span, "full_outer").select(
        *span, (g_in & p_in).cast("int").alias("tp"), (~g_in).cast("int").alias("fp"), (~p_in).cast("int").alias("fn")
    )


def scores(outcomes: DataFrame, *by: str) -> DataFrame:
    sums = outcomes.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        *by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


#: Rows that one task groups where a number of partitions follows from a table's rows.
TASK_ROWS = 200_000


def parts_for(rows: int) -> int:
    """Partitions for so many rows: what a task holds does not grow with the table."""
    return 1 + rows // TASK_ROWS


def consistency(gold: DataFrame, pred: DataFrame, scope: str, span: list[str], parts: int | None = None) -> DataFrame:
    """(scope, entity_id, verdict): incomplete, split, merged or consistent, the first that holds.

    gold(scope, span..., entity_id), pred(scope, span..., id); of repeated predicted spans the least id counts. Both are
    dealt by scope once, into so many parts; all that follows is sorted within a part and keeps no list or set.
    """
    no = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = gold.select(scope, *span, "entity_id", no(pred, "id"), F.lit(True).alias("_gold"))
    both = both.unionByName(pred.select(scope, *span, no(gold, "entity_id"), "id", F.lit(False).alias("_gold")))
    both = both.repartition(parts, scope) if parts else both.repartition(scope)
    # a null in a span or scope meets nothing
    known = F.lit(True)
    for c in (scope, *span):
        known = known & F.col(c).isNotNull()
    met = both.withColumn("id", F.when(known, F.min("id").over(Window.partitionBy(scope, *span)))).where("_gold")
    of_id = Window.partitionBy(scope, "id")
    met = met.withColumn("_merged", F.col("id").isNotNull() & (F.min("entity_id").over(of_id) != F.max("entity_id").over(of_id)))
    each = met.groupBy(scope, "entity_id").agg(
        F.bool_or(F.col("id").isNull()).alias("missing"), (F.min("id") != F.max("id")).alias("split"), F.bool_or("_merged").alias("merged")
    )
    verdict = F.when(F.col("missing"), "incomplete").when(F.col("split"), "split").when(F.col("merged"), "merged").otherwise("consistent")
    return each.select(scope, "entity_id", verdict.alias("verdict"))


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to each row in an order, the row's own included; order must tell rows apart.

    Rows are dealt into ranges and summed within each; the ranges' totals, as many as there are partitions, are summed
    by themselves. No task holds more than a range.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    dealt = kept(dealt, "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_at"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, inside + F.col("_at")).drop("_range", "_value", "_at")


def length_batches(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """rows with batch: the rows in order of length, then key, so many to a batch, so that a batch's lengths differ little.

    A null length comes first; keys are different and not null."""
    placed = running(rows.withColumn("_length", F.coalesce(F.col(length), F.lit(-1))), ["_length", key], F.lit(1), "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place", "_length")


def order_statistics(values: DataFrame, name: str) -> DataFrame:
    """n, least, upper median, 95th percentile by rank, greatest; ranks over distinct values, not rows."""
    counts = values.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).count()
    counts = running(counts, ["v"], F.col("count"), "upto")
    total = values.agg(F.count(name).alias("n"))
    pick = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return counts.crossJoin(F.broadcast(total)).agg(
        F.first("n").alias("n"), F.min("v").alias("least"), pick(F.floor(F.col("n") / 2) + 1).alias("median"),
        pick(F.greatest(F.floor(F.col("n") * 0.95), F.lit(1))).alias("p95"), F.max("v").alias("greatest"),
    )


def apportion(shares: DataFrame, n: int) -> DataFrame:
    """(name, share, place) -> whole counts that sum to n, the largest remainders first, then by place."""
    exact = F.col("share") * n
    parts = shares.select("name", "place", F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("rest"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), "place"))
    return parts.select("name", (F.col("base") + (rank <= left).cast("long")).cast("long").alias("n"))


def keyed_order(rows: DataFrame, key: Column) -> DataFrame:
    """place: the row's rank (from 1) by a hex key. Ranks are taken in 256 buckets and moved by their sums."""
    placed = rows.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 2))
    sizes = placed.groupBy("_b").count()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_at"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_k"))
    return placed.join(F.broadcast(starts), "_b").withColumn("place", (inside + F.col("_at")).cast("long")).drop("_k", "_b", "_at")


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the least value."""
    counts = rows.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("c"), value)).alias("x")).select(
        *by, F.col(f"x.{value}").alias(value), (-F.col("x.c")).alias("n")
    )
