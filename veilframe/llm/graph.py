"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import discard, stored, tidy

#: Links that one task settles alone, some 16 MB; more are settled by rounds of stars.
ONE_TASK = 1_000_000
#: A fixed point is reached after a number of rounds that grows with the logarithm of the longest chain.
MAX_ROUNDS = 60


def _checked(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    df = stored(df, name)
    got = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return df, tuple(got)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger end to the smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component): labels hook to smaller ones, then pointers are halved."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _alone(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if u:
        nodes, labels = labels_of(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long ids -> (node, component), component being the smallest id reachable.

    Only nodes with a link occur in the result; self links and nulls are ignored. Up to ONE_TASK
    links are settled in one task. Else every round is written to the shared folder, so a lost
    executor costs one round at most; hot nodes are pre-aggregated before each shuffle and no group
    is collected.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now, seen = _checked(now.distinct(), "links")
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if seen[0] <= ONE_TASK:
        done = stored(now.coalesce(1).mapInArrow(tidy(_alone), "node long, component long"), "labels")
        discard(now)
        return done
    for _ in range(MAX_ROUNDS):
        before = now
        now, got = _checked(_small_star(_large_star(now)), "stars")
        discard(before)
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
