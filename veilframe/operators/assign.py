"""Constrained assignment within scopes, in rounds: draw, find clashes by equi-joins, draw the later ones anew.

No scope meets in one task. A round draws for every open item; an item loses where one of its words is taken or an
item of a lower rank has drawn the word in the same round. What is left settles; the rest goes on with the next
attempt. Every round settles the first open item of each scope whose draw is free, and draws do not run out, so the
open table shrinks to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.shared import kept

ROUNDS = 60


def assign(items: DataFrame, draw: Callable[[DataFrame], DataFrame], taken: DataFrame, key: list[str], rank: str) -> DataFrame:
    """items with the columns that draw adds, such that no two items of a scope have a word in common.

    items(scope_id, key..., rank, ...): key and scope_id name an item, rank orders a scope's items. draw adds
    `words` (array<string>, null for a draw that does not suit its item) and others to rows with `attempt`, a number
    from 0. A column `avoid` (array<string>) that it adds holds words which must not be taken from the start, but
    several items may have. taken(scope_id, word): words that nothing may get.
    """
    name = ["scope_id", *key]
    open_items, settled, used = items.withColumn("attempt", F.lit(0)), None, taken.select("scope_id", "word")
    for _ in range(ROUNDS):
        drawn = kept(draw(open_items), "draws")
        if drawn.isEmpty():
            return drawn if settled is None else settled
        each = drawn.where("words is not null").select(*name, rank, F.explode(F.array_distinct("words")).alias("word"))
        first = each.groupBy("scope_id", "word").agg(F.min(F.struct(rank, *key)).alias("first"))
        later = each.join(first, ["scope_id", "word"]).where(F.struct(rank, *key) != F.col("first")).select(*name)
        lost = each.join(used, ["scope_id", "word"], "left_semi").select(*name).union(later)
        if "avoid" in drawn.columns:
            shunned = drawn.select(*name, F.explode("avoid").alias("word"))
            lost = lost.union(shunned.join(taken.select("scope_id", "word"), ["scope_id", "word"], "left_semi").select(*name))
        lost = lost.distinct()
        won = drawn.where("words is not null").join(lost, name, "left_anti")
        won = kept(won, "won")
        settled = won if settled is None else settled.unionByName(won)
        used = used.union(won.select("scope_id", F.explode("words").alias("word")))
        open_items = drawn.join(won.select(*name), name, "left_anti").select(*items.columns, (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("no free draw was found for every item")
