"""A hash tree over any number of keyed leaves, with proofs that a leaf belongs to it.

A leaf's place is the hash of its key in hex digits: the nodes of a level are the groups of leaves with that many
digits in common, so a group has about sixteen children whatever the keys look like. A node's hash covers its
children's digits and hashes in order; the root is the only node of level 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node, and leaves of a node of the last level, about.
WIDTH = 16


def levels_for(leaves: int) -> int:
    """Levels that leave about WIDTH leaves to a node of the last."""
    levels, room = 0, WIDTH
    while room < leaves:
        levels, room = levels + 1, room * 16
    return levels


def _joined(children: Column) -> Column:
    """The hash over (place, hash) children in order of their places."""
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["place"], F.lit(":"), c["hash"])), ","), 256)


def _grouped(nodes: DataFrame, level: int) -> DataFrame:
    """(node, children, hash) of a level from its (place, hash) children."""
    by = F.substring("place", 1, level) if level else F.lit("")
    grouped = nodes.groupBy(by.alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("children"))
    return grouped.withColumn("hash", _joined(F.col("children")))


def _levels(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of each level, the last level first. leaves(place, hash)."""
    out, nodes = [], leaves
    for level in range(levels, -1, -1):
        grouped = _grouped(nodes, level)
        out.append(grouped)
        nodes = grouped.select(F.col("node").alias("place"), "hash")
    return out


def place_of(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def root(leaves: DataFrame, levels: int) -> DataFrame:
    """leaves(key, hash), keys different and not null -> one row (n_leaves, root); an empty table has the hash of nothing."""
    placed = leaves.select(place_of(F.col("key")).alias("place"), "hash")
    top = _levels(placed, levels)[-1].select("hash")
    return leaves.agg(F.count("*").alias("n_leaves")).join(top, F.lit(True), "left").select("n_leaves", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("root"))


def proofs(leaves: DataFrame, levels: int) -> DataFrame:
    """leaves(key, hash) with proof: for each level, from the last to the root, the children among which the leaf's node is."""
    placed = leaves.withColumn("place", place_of(F.col("key")))
    steps = _levels(placed.select("place", "hash"), levels)
    out = placed.withColumn("proof", F.expr("cast(array() as array<array<struct<place: string, hash: string>>>)"))
    for level, nodes in zip(range(levels, -1, -1), steps, strict=True):
        by = F.substring("place", 1, level) if level else F.lit("")
        own = nodes.select(F.col("node").alias("at"), "children")
        out = out.withColumn("at", by).join(own, "at").withColumn("proof", F.concat("proof", F.array("children"))).drop("at", "children")
    return out.drop("place")


def proven(key: Column, leaf_hash: Column, proof: Column, top: Column) -> Column:
    """True if the proof leads from the leaf to the root `top`, every step holding the hash of the one before at its place."""
    place, depth = place_of(key), F.size(proof)

    def step(state, i):
        children = F.element_at(proof, i)
        own = F.when(i == 1, place).otherwise(F.substring(place, F.lit(1), depth - i + 1))
        held = F.exists(children, lambda c: (c["place"] == own) & (c["hash"] == state["hash"]))
        inside = F.forall(children, lambda c: c["place"].startswith(F.substring(place, F.lit(1), depth - i)))
        return F.struct((state["ok"] & held & inside).alias("ok"), _joined(children).alias("hash"))

    begin = F.struct(F.lit(True).alias("ok"), leaf_hash.alias("hash"))
    walked = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), begin, step))
    return F.coalesce(walked["ok"] & (walked["hash"] == top), F.lit(False))
