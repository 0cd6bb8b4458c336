"""Vector code compression: a codebook for every part of the vectors, learned with a reduction tree.

Vectors become whole numbers and are kept as columnar part blocks: for each part a matrix with one row a
dimension and one column a vector. A round sums and counts, block by block, what each codebook entry is
nearest to (distances accumulate dimension by dimension, np.add.at adds into int64 tensors) and merges these
small tensors through RDD.treeAggregate. Only the tensors and the codebooks pass the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import discard, light, small_batches, stored, tidy

#: Bytes of a block's numbers, and most vectors in it.
BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 1024
#: Sums of squares, over a vector's dimensions, stay below this.
MOST_ERROR = 2**62


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold neither a null nor a number that is not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as (rows, width) doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(width: int, scale: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                whole = np.floor(scale * matrix(batch.column("vector"), width)).astype("<i4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                        "labels": pa.ListArray.from_arrays([0, batch.num_rows], batch.column("label")),
                        "block": [np.ascontiguousarray(whole.T).tobytes()],
                    }
                )

    return run


def _columns(raw: bytes, parts: int, width: int, rows: int) -> np.ndarray:
    """(part, dimension in the part, vector) of a block."""
    return np.frombuffer(raw, "<i4").reshape(parts, width // parts, rows).astype(np.int64)


def _nearest(columns: np.ndarray, book: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, vector) -> nearest entry, the lower index in ties, and its squared distance."""
    near = np.empty((len(columns), rows), np.int64)
    error = np.empty((len(columns), rows), np.int64)
    for p, part in enumerate(columns):
        far = np.zeros((book.shape[1], rows), np.int64)
        for d, values in enumerate(part):
            gap = values[None, :] - book[p, :, d, None]
            far += gap * gap
        near[p] = far.argmin(axis=0)
        error[p] = far.min(axis=0)
    return near, error


def _gather(book: np.ndarray, width: int):
    parts, entries, part_width = book.shape

    def add(total, row):
        if total is None:
            total = np.zeros((parts, entries, part_width), np.int64), np.zeros((parts, entries), np.int64)
        columns = _columns(row.block, parts, width, row.n)
        near, _ = _nearest(columns, book, row.n)
        for p in range(parts):
            np.add.at(total[0][p], near[p], columns[p].T)
            np.add.at(total[1][p], near[p], 1)
        return total

    return add


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _coded(book: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            labels = batch.column("labels")
            for i, (ids, raw) in enumerate(zip(batch.column("ids"), batch.column("block").to_pylist(), strict=True)):
                near, error = _nearest(_columns(raw, len(book), width, len(ids)), book, len(ids))
                codes = [bytes(x).hex() for x in near.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels[i].values, pa.array(codes, pa.string()), pa.array(error.sum(axis=0))], ["vec_id", "label", "code", "error"]
                )

    return run


def compress(
    rows: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> DataFrame:
    """rows(vec_id, label, vector) -> vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Components become floor(scale * x). Vectors are cut into equal consecutive parts; each part position has a
    codebook, which starts as that part of the `entries` (256 at most) smallest vec_ids (nulls last, equal ids by
    vector; with fewer rows it has fewer entries). A round assigns every part to its nearest entry, by squared distance, the
    lower index in ties, and moves each entry to the floor of its parts' mean; an unused entry stays. code has two
    hex digits a part; error is the squared distance to the entries of the last round; label_error sums it over
    equal labels, nulls together; the hash covers all final entries' decimal components.

    Null vectors and those with null or non-finite components are left out. Vectors shorter than the longest, and
    all where its length is no multiple of parts, count as ending in zeros. Repeated rows are rows. Other columns
    are ignored; an empty table gives no rows. Components whose squares do not fit raise an ArithmeticError.
    """
    spark = rows.sparkSession
    base = rows.where(usable(F.col(vector))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    label = dict(base.dtypes)["label"]
    longest, most = base.agg(
        F.coalesce(F.max(F.size("vector")), F.lit(0)),
        F.coalesce(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(scale * F.abs(x) + 1).cast("double"))))), F.lit(0.0)),
    ).first()
    width = -(-longest // parts) * parts
    if most >= 2**31 or 4 * most * most * max(width, 1) >= MOST_ERROR:
        raise ArithmeticError(f"components of up to {most:g} after scaling are too large for exact distances")
    firsts = base.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    book = np.zeros((len(firsts), width))
    for k, row in enumerate(firsts):
        book[k, : len(row.vector)] = row.vector
    book = np.floor(scale * book).astype(np.int64).reshape(len(firsts), parts, width // parts).transpose(1, 0, 2)
    form = f"ids array<long>, labels array<{label}>, block binary"
    with small_batches(spark, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(width, 1))))):
        blocks = stored(base.mapInArrow(tidy(_blocks(width, scale)), form), "blocks")
    if firsts:
        columnar = blocks.select(F.size("ids").alias("n"), "block").rdd
        for _ in range(rounds):
            sums, counts = columnar.treeAggregate(None, _gather(book, width), _merge, depth=3)
            book = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    with small_batches(spark, 16):
        coded = stored(blocks.mapInArrow(tidy(_coded(book, width)), f"vec_id long, label {label}, code string, error long"), "codes")
    discard(blocks)
    sums = light(stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
