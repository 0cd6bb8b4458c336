"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become whole numbers x and get one more component, sqrt(M - |x|^2) with M the largest squared norm, so
all have one length; an anchor q gets 0 there. Then distance^2 = |q|^2 + M - 2 * score: higher scores are nearer,
and a window of scores is an annulus of distances. A small tree over a bounded sample deals all rows into cells;
a cell's rows are split into blocks of bounded size, each with a tree of its own. An anchor visits the cells that
its annulus can meet. Within a block it takes the leaves nearest first and stops as soon as no later leaf can
hold a row that is better than the k-th found. All scores are exact whole numbers; the trees only save work.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.codebooks import matrix, usable
from veilframe.llm.common import discard, release, small_batches, stored, tidy

#: Rows, and bytes of their vectors, of the sample that the upper tree is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 4 << 20
#: Bytes of the vectors of a block, and most rows in it.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 8192
#: Rows of a leaf of a block's tree, about.
LEAF = 256
#: Anchors that meet a block in one task, and that are searched together.
SLICE, TOGETHER = 32_768, 1024
#: Scores are below this, so that they are exact as doubles and fit a long with a row's number in its block.
MOST_SCORE = 2**49
_NONE = np.iinfo(np.int64).min
_SLACK = 1e-9


class VantageTree:
    """A full binary tree over points: a node splits its points at the median distance from one of them."""

    def __init__(self, points: np.ndarray, depth: int):
        n = len(points)
        self.depth, self.order = depth, np.arange(n)
        self.centres = np.zeros(2**depth - 1, np.int64)
        self.spans = np.zeros((2**depth - 1, 2, 2))  # of the near and the far child: least and greatest distance
        ends = np.array([0, n])
        for level in range(depth):
            cut = [0]
            for k in range(2**level):
                rows = self.order[ends[k] : ends[k + 1]]
                away = lambda c, rows=rows: np.sqrt(((points[rows] - points[c]) ** 2).sum(axis=1))
                node, centre = 2**level - 1 + k, rows[int(away(rows[0]).argmax())]
                far, middle = away(centre), len(rows) // 2
                by = np.argsort(far, kind="stable")
                self.order[ends[k] : ends[k + 1]] = rows[by]
                far = far[by]
                self.centres[node] = centre
                self.spans[node] = [[far[0], far[middle - 1]], [far[middle], far[-1]]]
                cut += [ends[k] + middle, ends[k + 1]]
            ends = np.array(cut)
        self.ends = ends

    def leaves_of(self, away: np.ndarray) -> np.ndarray:
        """The leaf of each point of (points, nodes) distances: near up to the greatest near distance."""
        at = np.zeros(len(away), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (away[np.arange(len(away)), at] > self.spans[at, 0, 1])
        return at - (2**self.depth - 1)


def ring(spans: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) least and greatest distances that the triangle inequality leaves for a leaf's points."""
    low, high = np.zeros((len(away), 1)), np.full((len(away), 1), np.inf)
    first = 0
    while first < len(spans):
        nodes = slice(first, 2 * first + 1)
        d, s = away[:, nodes, None], spans[None, nodes]
        least = np.maximum(low[:, :, None], np.maximum(d - s[..., 1], s[..., 0] - d))
        most = np.minimum(high[:, :, None], d + s[..., 1])
        low, high = least.reshape(len(away), -1), most.reshape(len(away), -1)
        first = 2 * first + 1
    return low, high


def _scores(low: np.ndarray, high: np.ndarray, squares: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(greatest, least) scores, with slack for rounding, of points at distances from low to high."""
    whole = squares[:, None] + most
    slack = 1 + _SLACK * whole
    return np.floor((whole - low * low) / 2 + slack), np.ceil((whole - high * high) / 2 - slack)


def _augmented(points: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most - (points * points).sum(axis=1), 0))
    return np.concatenate((points, rest[:, None]), axis=1)


def _away(queries: np.ndarray, centres: np.ndarray, most: float) -> np.ndarray:
    """Distances of anchors, whose last component is 0, to augmented points."""
    squares = (queries * queries).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + most - 2 * (queries @ centres.T), 0))


def _depth(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _ints(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.float64)


def _placed(width: int, scale: float, most: float, centres: np.ndarray, upper: VantageTree):
    """Rows with their cell; rows repeated within a batch go once."""

    def run(batches):
        for batch in batches:
            whole = np.floor(scale * matrix(batch.column("vector"), width))
            squares = (whole * whole).sum(axis=1)
            rest = np.sqrt(np.maximum(most - squares, 0))
            away = np.zeros((len(whole), 0))
            if len(centres):
                gap = rest[:, None] - np.sqrt(np.maximum(most - (centres * centres).sum(axis=1), 0))[None, :]
                straight = squares[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * whole @ centres.T
                away = np.sqrt(np.maximum(straight, 0) + gap * gap)
            raw = [x.tobytes() for x in whole.astype("<i4")]
            ids, kinds = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            once = list({x: i for i, x in enumerate(zip(ids, kinds, raw, strict=True))}.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(upper.leaves_of(away).astype(np.int32)).take(pa.array(once)), *[batch.column(c).take(pa.array(once)) for c in ("vec_id", "label", "anchor")],
                    pa.array([raw[i] for i in once], pa.binary()),
                ],
                ["cell", "vec_id", "label", "anchor", "vector"],
            )

    return run


def _index(width: int, most: float):
    """One block's rows -> one row with its tree: leaves in order, rows of a leaf together."""

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for row in zip(*[table.column(c).to_pylist() for c in ("vec_id", "label", "vector")], strict=True):
            rows[row] = None
        # by id, nulls last: a row's place stands for its id in ties
        own = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        points = np.frombuffer(b"".join(r[2] for r in own), "<i4").reshape(len(own), width)
        tree = VantageTree(_augmented(points.astype(np.float64), most), _depth(len(own), LEAF))
        data = _packed(
            points=points[tree.order], place=tree.order, ends=tree.ends, spans=tree.spans, centres=points[tree.centres],
            ids=np.array([r[0] or 0 for r in own], np.int64), named=np.array([r[0] is not None for r in own]),
            labels=np.array([r[1] for r in own], np.int64),
        )
        return pa.table({"block": table.column("block")[:1], "cell": table.column("cell")[:1], "data": pa.array([data], pa.binary())})

    return run


def search(index, most: float, queries: np.ndarray, about: dict, k: int, same: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(query, window, places of rows, scores): up to k best rows of this block for every window of every query.

    index: arrays of _index. about: ids, labels, low, high of the queries, the last two (queries, windows) with
    low > high for no window; rows below low or above high are out. same: rows of the query's label but itself,
    else rows of other labels. Leaves come nearest first; a window is done when its k-th is out of their reach.
    """
    points, ends, place = index["points"].astype(np.float64), index["ends"], index["place"]
    n, squares = len(points), (queries * queries).sum(axis=1)
    low, high = about["low"], about["high"]
    reach, depth = _scores(*ring(index["spans"], _away(queries, index["centres"].astype(np.float64), most)), squares, most)
    ahead = np.argsort(-reach, axis=1, kind="stable")
    best = np.full((*low.shape, k), _NONE, np.int64)  # score * n + what is less for greater ids; the least first
    labels, ids = index["labels"][place], np.where(index["named"], index["ids"], -1)[place]
    named = index["named"][place]
    each = np.arange(len(queries))
    for turn in range(ahead.shape[1]):
        leaf = ahead[:, turn]
        top, bottom = reach[each, leaf].astype(np.int64), depth[each, leaf]
        kth = best[:, :, 0]
        alive = (low <= high) & (top[:, None] >= low) & ((kth == _NONE) | (top[:, None] * n + n - 1 > kth))
        if not alive.any():
            break
        useful = np.flatnonzero((alive & (bottom[:, None] <= high)).any(axis=1))
        by = useful[np.argsort(leaf[useful], kind="stable")]
        for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(by) else ():
            s, e = ends[leaf[own[0]]], ends[leaf[own[0]] + 1]
            score = np.rint(queries[own] @ points[s:e].T).astype(np.int64)
            alike = about["labels"][own, None] == labels[None, s:e]
            if same:
                twin = named[None, s:e] & (about["ids"][own, None] == ids[None, s:e]) & alike
                for a, b in zip(*np.nonzero(twin), strict=True):
                    alike[a, b] = not np.array_equal(queries[own[a]], points[s + b])
            key = np.where(alike if same else ~alike, score * n + (n - 1 - place[s:e]), _NONE)
            for w in range(low.shape[1]):
                inside = (score >= low[own, w, None]) & (score <= high[own, w, None])
                both = np.concatenate((best[own, w], np.where(inside, key, _NONE)), axis=1)
                best[own, w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    for q, w in zip(*np.nonzero((best != _NONE).any(axis=2)), strict=True):
        found = best[q, w][best[q, w] != _NONE]
        yield q, w, n - 1 - found % n, found // n


def _met(width: int, most: float, k: int, same: bool):
    """A block and the anchors that visit it -> candidates (key, window, vec_id, score)."""

    def run(blocks: pa.Table, visits: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        for raw in blocks.column("data").to_pylist()[:1]:
            index = np.load(io.BytesIO(raw))
            index = {name: index[name] for name in index.files}
            for at in range(0, visits.num_rows, TOGETHER):
                part = visits.slice(at, TOGETHER).combine_chunks()
                queries = _ints(part.column("vector"), width)
                about = {"ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy()}
                about |= {c: part.column(c).combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1) for c in ("low", "high")}
                keys = part.column("key").to_numpy()
                for q, w, places, scores in search(index, most, queries, about, k, same):
                    found[0].append(np.full(len(places), keys[q]))
                    found[1].append(np.full(len(places), w))
                    found[2].append(places)
                    found[3].append(scores)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        named = index["named"][flat[2]] if len(flat[2]) else np.empty(0, bool)
        ids = index["ids"][flat[2]] if len(flat[2]) else flat[2]
        return pa.table(
            {"key": pa.array(flat[0], pa.int64()), "slot": pa.array(flat[1], pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=~named), "score": pa.array(flat[3], pa.int64())}
        )

    return run


def _visits(width: int, most: float, centres: np.ndarray, upper: VantageTree, sample: np.ndarray, kinds: np.ndarray, names: list, k: int, same: bool, blocks: np.ndarray):
    """Anchors with windows -> one row for every block of every cell that a window's annulus can meet.

    What the sample holds bounds the k-th best row from below. blocks: the first block of each cell, and the end.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                if not part.num_rows:
                    continue
                queries, labels = _ints(part.column("vector"), width), part.column("label").to_numpy()
                low = part.column("low").flatten().to_numpy().reshape(part.num_rows, -1).copy()
                high = part.column("high").flatten().to_numpy().reshape(part.num_rows, -1)
                if len(sample) >= k:
                    score = np.rint(queries @ sample.T).astype(np.int64)
                    alike = labels[:, None] == kinds[None, :]
                    fits = alike & (part.column("vec_id").to_numpy()[:, None] != names[None, :]) if same else ~alike
                    for w in range(low.shape[1]):
                        inside = fits & (score >= low[:, w, None]) & (score <= high[:, w, None])
                        kth = np.partition(np.where(inside, score, _NONE), len(sample) - k, axis=1)[:, -k]
                        low[:, w] = np.where(kth == _NONE, low[:, w], np.maximum(low[:, w], kth))
                squares = (queries * queries).sum(axis=1)
                top, bottom = _scores(*ring(upper.spans, _away(queries, centres, most)), squares, most)
                meets = ((low[:, None, :] <= high[:, None, :]) & (top[:, :, None] >= low[:, None, :]) & (bottom[:, :, None] <= high[:, None, :])).any(axis=2)
                who, cell = np.nonzero(meets)
                sizes = blocks[cell + 1] - blocks[cell]
                block = np.repeat(blocks[cell], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                who = np.repeat(who, sizes)
                for s in range(0, len(who), 4096):
                    own = pa.array(who[s : s + 4096])
                    ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * low.shape[1])
                    bounds = [pa.ListArray.from_arrays(ends, pa.array(x[who[s : s + 4096]].ravel())) for x in (low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[s : s + 4096].astype(np.int32)), *[part.column(c).take(own) for c in ("key", "vec_id", "label", "vector")], *bounds],
                        ["block", "key", "vec_id", "label", "vector", "low", "high"],
                    )

    return run


def hard_negatives(
    rows: DataFrame, anchor: Column, vector: str = "embedding", positives: int = 5, negatives: int = 10,
    window: tuple[int, int] = (30, 90), scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, vector).

    Components become floor(scale * x); a score is the inner product of two rows; higher scores come first, ties
    by smaller vec_id, null ids last. anchor is a condition on the rows. An anchor's positives are its first
    `positives` other rows of its label; for each, the first `negatives` rows of other labels are returned whose
    score s has window[0] * p <= 100 * s <= window[1] * p, p being the positive's score (a negative p has none).

    Rows with a null label or an unusable vector take no part; labels are whole numbers. A null vec_id is no
    anchor, but may be a positive or a negative. Rows repeated as a whole count once; different rows with one
    vec_id are rows of their own. Vectors shorter than the longest count as ending in zeros. Other columns are
    ignored; an empty table gives no rows. Vectors whose squared length after scaling reaches 2^49, or with a
    component beyond 31 bits, raise an ArithmeticError.
    """
    spark = rows.sparkSession
    base = rows.where(F.col("label").isNotNull() & usable(F.col(vector))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        (F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"),
    )
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(F.abs(scale * x) + 1, 2.0))
    width, most, count = base.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0)), F.count("*")).first()
    if most >= MOST_SCORE:
        raise ArithmeticError(f"squared lengths of up to {most:g} after scaling are too large for exact scores")
    width = max(width, 1)
    few = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    picked = base.select("vec_id", "label", "vector").orderBy(F.xxhash64("vec_id", "label", "vector"), "vec_id").limit(few).collect()
    picked = list({(r.vec_id, r.label, tuple(r.vector)): r for r in picked}.values())
    sample = np.zeros((len(picked), width))
    for k, row in enumerate(picked):
        sample[k, : len(row.vector)] = row.vector
    sample = np.floor(scale * sample)
    # the least and greatest distances of a cell hold for the sample only: its rows may lie anywhere beyond the outer ones
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * width)))
    upper = VantageTree(_augmented(sample, most), min(_depth(len(sample), 16), _depth(count, block_rows)))
    upper.spans[:, 1, 0], upper.spans[:, 0, 0], upper.spans[:, 1, 1] = upper.spans[:, 0, 1], 0, np.inf
    centres = sample[upper.centres]
    with small_batches(spark, max(1, min(10_000, 4 * BLOCK_BYTES // (8 * width)))):
        placed = stored(
            base.mapInArrow(tidy(_placed(width, scale, most, centres, upper)), "cell int, vec_id long, label long, anchor boolean, vector binary"), "cells"
        )
    sizes = dict(placed.groupBy("cell").count().collect())
    parts = [-(-sizes.get(c, 0) // block_rows) for c in range(2**upper.depth)]
    starts = np.concatenate(([0], np.cumsum(parts))).astype(np.int64)
    start, many = F.array(*map(F.lit, starts[:-1].tolist())), F.array(*(F.lit(max(p, 1)) for p in parts))
    cell = F.col("cell")
    block = (F.get(start, cell) + F.pmod(F.xxhash64("vec_id", "label", "vector"), F.get(many, cell))).cast("int")
    grown = placed.withColumn("block", block).groupBy("block").applyInArrow(_index(width, most), "block int, cell int, data binary")
    index = stored(grown, "trees")
    release(spark)

    asking = placed.where("anchor").select("vec_id", "label", "vector").distinct()
    asking = stored(asking.withColumn("key", F.xxhash64("vec_id", "label", "vector")), "anchors")
    slices = -(-asking.count() // SLICE)
    kinds = np.array([r.label for r in picked], np.int64)
    names = np.array([-1 if r.vec_id is None else r.vec_id for r in picked], np.int64)
    fitted = (width, most, centres, upper, sample, kinds, names)

    def candidates(anchors: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        form = "block int, key long, vec_id long, label long, vector binary, low array<long>, high array<long>"
        visits = anchors.mapInArrow(tidy(_visits(*fitted, k, same, starts)), form)
        visits = visits.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(max(slices, 1))))
        copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(slices, 1) - 1).cast("long"))))
        met = copies.groupBy("block", "part").cogroup(visits.groupBy("block", "part")).applyInArrow(
            _met(width, most, k, same), "key long, slot long, vec_id long, score long"
        )
        order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return stored(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

    every = F.array(F.lit(-MOST_SCORE)), F.array(F.lit(MOST_SCORE))
    own = candidates(asking.withColumns({"low": every[0], "high": every[1]}), positives, True, "positives")
    score = F.col("score")
    own = own.select("key", "rank", F.col("vec_id").alias("positive_id"), score.alias("positive_score"))
    # the window's whole bounds, rounded inwards
    p = F.col("positive_score")
    own = own.withColumn("low", F.when(p < 0, 1).otherwise(F.expr(f"({window[0]} * positive_score + 99) div 100")))
    own = own.withColumn("high", F.when(p < 0, 0).otherwise(F.expr(f"({window[1]} * positive_score) div 100")))
    slots = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    slot = lambda name, none: F.transform(
        F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("w", i)[name], F.lit(none)).cast("long")
    )
    ranged = asking.join(slots, "key").select("key", "vec_id", "label", "vector", slot("low", 1).alias("low"), slot("high", 0).alias("high"))
    found = candidates(ranged, negatives, False, "negatives")
    out = found.select("key", (F.col("slot") + 1).cast("int").alias("place"), "rank", F.col("vec_id").alias("negative_id"), score.alias("negative_score"))
    named = own.withColumnRenamed("rank", "place").join(asking.select("key", F.col("vec_id").alias("anchor_id")), "key")
    discard(placed, index)
    return named.join(out, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
