"""The plan of a corpus: what kind of sample each row of a table becomes, in shares, pairs and rotations.

No task holds a slice: places come from running sums over ranges of rows, groups from their first places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.keyed import TEST_KEY, first_bits, hmac_hex
from veilframe.operators import metrics
from veilframe.operators.shared import kept

# The shares of the slices in percent, in their order, and that of hard samples.
SHARES = (("single", 52), ("multi", 24), ("listing", 16), ("bundle", 8))
HARD_SHARE, THREE_SHARE = 10, 15
#: Shares of the hard samples by slice; bundle listings take the rest.
HARD_PARTS = (("single", 40), ("multi", 30), ("listing", 20))
#: The hard cases that the samples of a slice take in turn.
CYCLES = {
    "single": ("month", "misspelt", "nickname", "initials", "shouted"), "multi": ("misspelt", "initials", "month"),
    "listing": ("initials", "shouted"), "bundle_listing": ("initials",),
}


def composition(rows: DataFrame, n: int) -> dict[str, int]:
    """Samples of each slice: largest remainders of n, an odd bundle sample becoming a single one."""
    spark = rows.sparkSession
    shares = spark.createDataFrame([(name, share / 100, i) for i, (name, share) in enumerate(SHARES)], "name string, share double, place int")
    out = {r["name"]: r["n"] for r in metrics.apportion(shares, n).collect()}  # as many rows as there are slices
    odd = out["bundle"] % 2
    return out | {"bundle": out["bundle"] - odd, "single": out["single"] + odd}


def hard_counts(n: int) -> dict[str, int]:
    """Hard samples wanted of each slice: a tenth of all, halves rounded to even, dealt by HARD_PARTS."""
    hard = round(n * HARD_SHARE / 100)
    out = {name: hard * part // 100 for name, part in HARD_PARTS}
    return out | {"bundle_listing": hard - sum(out.values())}


def rotation(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) within their group; group and order together tell rows apart."""
    placed = kept(metrics.running(rows, [*group, *order], F.lit(1), "_place"), "places")
    firsts = placed.groupBy(*group).agg(F.min("_place").alias("_first"))  # as many rows as there are groups
    return placed.join(F.broadcast(firsts), group).withColumn(name, (F.col("_place") - F.col("_first")).cast("long")).drop("_place", "_first")


def plan(rows: DataFrame, id_column: str, key: bytes = TEST_KEY) -> DataFrame:
    """(id, slice, n_patients, bundle_no, listing_rows, hard_kind, doc_index, template_hint) for each row of a table.

    Slots are ranks by a keyed hash of the id; ids are different and not null. Bundle samples come in pairs, the
    narrative before its listing. doc_index is the place in a keyed order of samples and pairs, template_hint counts
    within (slice, n_patients) along it, so that templates are used evenly. An empty table has an empty plan.
    """
    def draw(name: str, of: Column) -> Column:
        return first_bits(hmac_hex(F.concat(F.lit(name), of.cast("string")), key))

    n = rows.count()
    counts, wanted = composition(rows, n), hard_counts(n)
    each = metrics.keyed_order(rows.select(F.col(id_column).alias("id")), hmac_hex(F.concat(F.lit("slot"), F.col("id").cast("string")), key))
    slot, at, slices = F.col("place") - 1, 0, []
    for name, _ in SHARES:
        slices.append((name, at, at + counts[name]))
        at += counts[name]
    kind, first = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, low, high in slices:
        kind, first = F.when((slot >= low) & (slot < high), name).otherwise(kind), F.when((slot >= low) & (slot < high), low).otherwise(first)
    each = each.select("id", slot.alias("slot"), kind.alias("kind"), (slot - first).alias("nth"))
    paired, second = F.col("kind") == "bundle", F.col("nth") % 2 == 1
    each = each.withColumn("bundle_no", F.when(paired, F.floor(F.col("nth") / 2).cast("long")))
    each = each.withColumn("slice", F.when(paired, F.when(second, "bundle_listing").otherwise("bundle_narrative")).otherwise(F.col("kind")))
    each = each.withColumn("nth", F.coalesce("bundle_no", "nth"))
    few = F.when(F.col("kind") == "single", 1).when(F.col("kind") == "multi", F.when(draw("three", F.col("slot")) % 100 < THREE_SHARE, 3).otherwise(2)).when(paired, F.when(draw("two", F.col("bundle_no")) % 100 < 30, 2).otherwise(1)).otherwise(0)
    each = each.withColumn("n_patients", few.cast("long"))
    listed = F.when(F.col("kind") == "listing", 5 + draw("rows", F.col("slot")) % 16).when(F.col("slice") == "bundle_listing", F.col("n_patients") + 4 + draw("rows", F.col("slot")) % 9).otherwise(0)
    hard = F.lit(None).cast("string")
    for name, cycle in CYCLES.items():
        turn = F.element_at(F.array(*map(F.lit, cycle)), (F.col("nth") % len(cycle) + 1).cast("int"))
        hard = F.when((F.col("slice") == name) & (F.col("nth") < wanted[name]), turn).otherwise(hard)
    unit = hmac_hex(F.when(paired, F.concat(F.lit("pair"), F.col("bundle_no").cast("string"))).otherwise(F.concat(F.lit("unit"), F.col("slot").cast("string"))), key)
    each = each.withColumns({"listing_rows": listed.cast("long"), "hard_kind": hard, "_unit": unit})
    ordered = metrics.running(each, ["_unit", "slot"], F.lit(1), "doc_index").withColumn("doc_index", (F.col("doc_index") - 1).cast("long"))
    turned = rotation(ordered.drop("_unit", "kind", "nth", "slot"), ["slice", "n_patients"], ["doc_index"], "template_hint")
    return turned.select("id", "slice", "n_patients", "bundle_no", "listing_rows", "hard_kind", "doc_index", "template_hint")
