"""Packed exchange of keys: which rows share a 64-bit key, without one shuffled row for each key.

Every task packs the keys of a chunk of rows into one blob for each bucket of the key range; a bucket's
blobs meet in one group and are sorted there as arrays. No group holds all rows of a frequent key: a chunk
sends HELD + 1 of a key's owners at most (stars), or so many that the key is known to be frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import give_back, tidy

#: Keys and rows packed together by a task; a row number and a mark fit 16 bits.
CHUNK_KEYS, CHUNK_ROWS = 1 << 19, 1 << 15
#: Further owners of a key that a chunk sends to its bucket; the rest meet the chunk's first owner at once.
HELD = 16
#: Keys of one bucket, on average; a bucket is one group.
BUCKET_KEYS = 1 << 19
#: Rows of one Arrow batch while keys are made.
ROWS = 1000
_BITS32 = np.uint64(32)
_PACKED = "bucket int, keys binary, who binary, ids binary, u binary, v binary, n binary, marked binary"
_PAIRS = "u long, v long, n long, marked long"
_LONGS = ("u", "v", "n", "marked")


def _counted(u: np.ndarray, v: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different pairs, how often each occurs, and how often with a mark."""
    if not len(u):
        return u, v, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
    return u[first], v[first], np.diff(np.append(first, len(u))), np.add.reduceat(marks[order].astype(np.int64), first)


def _pack(
    ids: np.ndarray, keys: list[np.ndarray], marks: list[np.ndarray | None], buckets: int, most: int | None
) -> Iterator[tuple]:
    """(bucket, keys, who, ids, u, v, n, marked) of one chunk; the last four are pairs that meet within it."""
    rank = np.argsort(ids, kind="stable")  # the first owner of a key is the one with the smallest id
    ids, keys, marks = ids[rank], [keys[i] for i in rank], [marks[i] for i in rank]
    flat = np.concatenate(keys)
    who = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(k) for k in keys])
    marked = np.concatenate([np.zeros(len(k), bool) if m is None else m for k, m in zip(keys, marks, strict=True)])
    if not len(flat):
        return
    order = np.argsort(flat, kind="stable")
    flat, who, marked = flat[order], who[order], marked[order]
    begins = np.concatenate(([True], flat[1:] != flat[:-1]))
    fresh = np.concatenate(([True], begins[1:] | (ids[who[1:]] != ids[who[:-1]])))
    if not fresh.all():  # a row with a key several times marks it if one of them does
        marked = np.logical_or.reduceat(marked, np.flatnonzero(fresh))
        flat, who, begins = flat[fresh], who[fresh], begins[fresh]
    first = np.flatnonzero(begins)
    of = np.cumsum(begins) - 1
    pairs = ()
    kept = np.arange(len(flat)) - first[of] <= (HELD if most is None else most)
    if most is None and not kept.all():
        pairs = _counted(ids[who[~kept]], ids[who[first[of[~kept]]]], marked[~kept])
    flat, who, marked = flat[kept], who[kept], marked[kept]
    at = ((flat >> _BITS32) * np.uint64(buckets)) >> _BITS32
    ends = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    low = flat.astype("<u4")
    empty = b""
    for b in range(buckets):
        s, e = ends[b], ends[b + 1]
        if s < e:
            own, table = who[s:e], ids
            if e - s < len(ids):
                used, own = np.unique(own, return_inverse=True)
                own, table = own.astype(np.uint16), ids[used]
            own = own | (marked[s:e].astype(np.uint16) << np.uint16(15))
            yield b, low[s:e].tobytes(), own.tobytes(), table.tobytes(), empty, empty, empty, empty
    if pairs:
        yield int(flat[0] % np.uint64(buckets)), empty, empty, empty, *[x.tobytes() for x in pairs]


def _within(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray, most: int | None) -> tuple[np.ndarray, ...]:
    """(larger id, smaller id, the larger one's mark) of rows with one key: with its smallest owner, or all of few."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    held = np.diff(np.append(first, len(keys)))
    several = (held > 1) if most is None else (held > 1) & (held <= most)
    rows = order[np.repeat(several, held)]
    held = held[several]
    ids, marks = ids[rows], marks[rows]
    if not len(ids):
        return ids, ids, marks
    starts = np.cumsum(held) - held
    if most is None:
        least = np.repeat(np.minimum.reduceat(ids, starts), held)
        other = ids != least
        return ids[other], least[other], marks[other]
    u, v, t = [], [], []
    for c in np.unique(held).tolist():
        at = starts[held == c][:, None] + np.arange(c)
        at = np.take_along_axis(at, np.argsort(ids[at], axis=1, kind="stable"), axis=1)
        group, flags = ids[at], marks[at]
        for i in range(1, c):
            for j in range(i):
                u.append(group[:, i])
                v.append(group[:, j])
                t.append(flags[:, i])
    u, v, t = np.concatenate(u), np.concatenate(v), np.concatenate(t)
    other = u != v
    return u[other], v[other], t[other]


def _meet(most: int | None):
    def run(table: pa.Table) -> pa.Table:
        keys, ids, marks, pairs = [], [], [], [[] for _ in _LONGS]
        for k, who, own, *found in zip(*[table.column(x).to_pylist() for x in ("keys", "who", "ids", *_LONGS)], strict=True):
            if k:
                who = np.frombuffer(who, np.uint16)
                keys.append(np.frombuffer(k, "<u4"))
                ids.append(np.frombuffer(own, np.int64)[who & np.uint16(0x7FFF)])
                marks.append(who > 0x7FFF)
            else:
                for to, x in zip(pairs, found, strict=True):
                    to.append(np.frombuffer(x, np.int64))
        if keys:
            met = _counted(*_within(np.concatenate(keys), np.concatenate(ids), np.concatenate(marks), most))
            for to, x in zip(pairs, met, strict=True):
                to.append(x)
        out = pa.table([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in pairs], names=_LONGS)
        del keys, ids, marks, pairs
        give_back()
        return out

    return run


def buckets_for(keys: int) -> int:
    """Buckets for so many keys."""
    return 1 + keys // BUCKET_KEYS


def meetings(rows: DataFrame, keyed: Callable[[pa.RecordBatch], Iterator[tuple]], buckets: int, most: int | None = None) -> DataFrame:
    """(u, v, n, marked): pairs u > v of ids that share keys, the number of keys met, and of those u marks.

    A pair may have several rows. keyed gives (id, keys, marks or None) of each row of a batch; repeated ids
    count once for each key. With most = None, the owners of a key meet its smallest one, or the smallest in
    their chunk if it has more than HELD + 1 owners of it, and that one the smallest of all: stars that connect
    all owners. Otherwise all owners of a key meet, if it has at most so many; a key of more meets none.
    Store the result under small_batches(spark, ROWS).
    """

    def pack(batches):
        def flush():
            found = list(zip(*_pack(np.array(ids, np.int64), keys, marks, buckets, most), strict=True))
            for i in range(0, len(found[0]) if found else 0, 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i : i + 64], pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(found)], names
                )

        names = [x.split()[0] for x in _PACKED.split(", ")]
        ids, keys, marks, total = [], [], [], 0
        for batch in batches:
            for own, some, flags in keyed(batch):
                ids.append(own)
                keys.append(some)
                marks.append(flags)
                total += len(some)
                if total >= CHUNK_KEYS or len(ids) >= CHUNK_ROWS:
                    yield from flush()
                    ids, keys, marks, total = [], [], [], 0
        if total:
            yield from flush()

    packed = rows.mapInArrow(tidy(pack), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_meet(most), _PAIRS).where(F.col("u") > F.col("v"))
