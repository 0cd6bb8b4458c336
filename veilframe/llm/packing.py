"""Best-fit packing of documents into sequences, by large-item matching on a histogram of lengths.

Only the number of pieces of each length (at most as many lengths as the capacity) comes to the driver.
There, lengths above a third of the capacity, of which two at most share a sequence, are matched
greedily from the longest (each with the longest that still fits), and shorter ones fill the smallest
remaining gaps in descending order. The plan is a list of runs "the r-th to s-th piece of this length go
to these sequences at this offset"; its size depends on the capacity, not on the data. Tasks then look
up each piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import stored, tidy
from veilframe.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0


class _Gaps:
    """Groups of equal sequences by free space: gap -> [(first sequence, count, used)]."""

    def __init__(self):
        self.sizes: list[int] = []
        self.groups: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, gap: int, first: int, count: int, used: int) -> None:
        if gap > 0 and count > 0:
            if not self.groups[gap]:
                insort(self.sizes, gap)
            self.groups[gap].append((first, count, used))

    def take(self, least: int) -> tuple[int, int, int, int] | None:
        """The group with the smallest gap of at least so much."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        group = self.groups[gap].pop()
        if not self.groups[gap]:
            self.sizes.pop(at)
        return (gap, *group)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> runs (first rank, pieces, first sequence, pieces of it in each sequence, offset)."""
    left = {n: c for n, c in counts.items() if c > 0}
    runs: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    gaps, new = _Gaps(), 0

    def place(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs[length].append((rank[length], pieces, first, each, offset))
        rank[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1)
            mate = next((large[k] for k in range(at - 1, -1, -1) if left[large[k]]), None)
            if mate is None:
                alone = left[length]
                place(length, alone, new, 1, 0)
                gaps.add(capacity - length, new, alone, length)
                new += alone
            elif mate == length:
                pairs, single = divmod(left[length], 2)
                place(length, 2 * pairs, new, 2, 0)
                gaps.add(capacity - 2 * length, new, pairs, 2 * length)
                new += pairs
                if single:
                    place(length, 1, new, 1, 0)
                    other = next((large[k] for k in range(at - 1, -1, -1) if left[large[k]]), None)
                    if other is not None:
                        place(other, 1, new, 1, length)
                    used = length + (other or 0)
                    gaps.add(capacity - used, new, 1, used)
                    new += 1
            else:
                pairs = min(left[length], left[mate])
                place(length, pairs, new, 1, 0)
                place(mate, pairs, new, 1, length)
                gaps.add(capacity - length - mate, new, pairs, length + mate)
                new += pairs
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            got = gaps.take(length)
            gap, first, count, used = got or (capacity, new, -(-left[length] // (capacity // length)), 0)
            if got is None:
                new += count
            each = gap // length
            whole = min(count, left[length] // each)
            if whole:
                place(length, whole * each, first, each, used)
                gaps.add(gap - each * length, first, whole, used + each * length)
            if whole < count and left[length]:
                some = left[length]
                place(length, some, first + whole, some, used)
                gaps.add(gap - some * length, first + whole, 1, used + some * length)
                whole += 1
            gaps.add(gap, first + whole, count - whole, used)
    return dict(runs)


def lookup(runs: dict[int, list[tuple[int, int, int, int, int]]], lengths: np.ndarray, ranks: np.ndarray):
    """(sequence, offset) of pieces by length and rank."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for length in np.unique(lengths):
        mine = lengths == length
        table = np.array(runs[int(length)], np.int64)
        run = table[np.searchsorted(table[:, 0], ranks[mine], side="right") - 1]
        inside = ranks[mine] - run[:, 0]
        sequence[mine] = run[:, 2] + inside // run[:, 3]
        offset[mine] = run[:, 4] + inside % run[:, 3] * length
    return sequence, offset


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        source, part = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                raw = memoryview(source.ids(text.as_py()) + end)
                for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                    own = raw[4 * at : 4 * (at + capacity)]
                    length = len(own) // 4
                    rows.append((doc_id, k, at, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own_rank"],
            )

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only longer ones than the capacity are cut, into pieces of the
    capacity and a shorter rest. Pieces lie in their sequence from 0 without gaps. Null is the empty
    text (its end id alone). Repeated rows are packed each on its own; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(
        base.mapInArrow(
            tidy(_pieces(path, capacity, end_id)),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long",
        ),
        "pieces",
    )
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base_rank = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = pieces.groupBy("length").count().collect()  # one row per length, at most the capacity
    runs = plan({r["length"]: r["count"] for r in histogram}, capacity)

    def find(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = lookup(runs, lengths, ranks)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return (
        pieces.join(base_rank, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own_rank")).alias("rank"))
        .mapInArrow(
            tidy(find), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
        )
    )
