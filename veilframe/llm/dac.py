"""Token ids as directly addressable codes, in a table of shards.

An id is cut into chunks of 8 bits, lowest first. Level l holds the l-th chunk of every id that has
one, with a bitmap telling which go on to level l + 1 and a rank directory (ones before each block of
512 bits). Any token is found by following its position through the ranks, without decoding others.

File format: one row per shard with part, seq (order), doc_ids, doc_lens, n_ids, and for each level
chunks, bitmap (bit i % 8 of byte i // 8) and ranks (little-endian unsigned 32-bit).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import stored
from veilframe.llm.tokens import encoder

CHUNK_BITS = 8
BLOCK_BITS = 512
#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: The id that ends a document.
END_ID = 1

SHARD = (
    "part int, seq int, doc_ids array<long>, doc_lens array<long>, n_ids long,"
    " levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
)


def encode(ids: np.ndarray) -> list[dict]:
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        high = rest >> np.uint32(CHUNK_BITS)
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(more) // BLOCK_BITS) * BLOCK_BITS, bool)
        whole[: len(more)] = more
        ones = whole.reshape(-1, BLOCK_BITS).sum(axis=1)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
        chunks = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        levels.append({"chunks": chunks.tobytes(), "bitmap": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = high[more]
    return levels


class Codes:
    """Random access to a shard's ids."""

    def __init__(self, levels: list[dict]):
        self.chunks = [np.frombuffer(x["chunks"], np.uint8) for x in levels]
        self.bits = [np.frombuffer(x["bitmap"], np.uint8) for x in levels]
        self.ranks = [np.frombuffer(x["ranks"], "<u4") for x in levels]

    def __len__(self) -> int:
        return len(self.chunks[0]) if self.chunks else 0

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        ones = np.unpackbits(self.bits[level][first : i // 8 + 1], bitorder="little")[: i - first * 8]
        return int(self.ranks[level][block]) + int(ones.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level in range(len(self.chunks)):
            value |= int(self.chunks[level][i]) << (CHUNK_BITS * level)
            if not self.bits[level][i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def all(self) -> np.ndarray:
        below = np.empty(0, np.uint32)
        for chunks, bits in zip(reversed(self.chunks), reversed(self.bits), strict=True):
            now = chunks.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            now[more] |= below << np.uint32(CHUNK_BITS)
            below = now
        return below


def _shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        source = encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, lens, held, size = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def shard():
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "seq": seq, "doc_ids": doc_ids, "doc_lens": lens, "n_ids": len(ids), "levels": encode(ids)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = source.ids(text.as_py()) + end
                if held and size + len(ids) // 4 > SHARD_IDS:
                    yield shard()
                    seq, doc_ids, lens, held, size = seq + 1, [], [], [], 0
                doc_ids.append(doc_id)
                lens.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield shard()

    return run


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())]))),
    ]
)


def write_codes(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs(doc_id, text) in ascending doc_id order (ties by text, nulls first) and store the shards.

    Only document texts cross a shuffle, once, by ranges of doc_id; a task keeps one shard in memory.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(_shards(path, end_id), SHARD), "codes")


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, start: ids before each shard; sums by part first, so one task sees one row per part."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(base, "part").select(
        "part", "seq", (F.col("base") + F.col("own")).alias("start")
    )


def read_codes(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored shards."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["levels"]).all().astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                if len(ids) != row["n_ids"] or (len(ends) and ends[-1] != len(ids)):
                    raise ValueError(f"shard {row['part']}/{row['seq']} is damaged")
                raw, starts = memoryview(ids.tobytes()), ends - np.array(row["doc_lens"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()),
                        pa.array(row["doc_lens"], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    located = shards.join(shard_starts(shards), ["part", "seq"])
    return located.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One row per row of docs: doc_id, start, n_tokens (with the end id), ids_crc32, read back from the files.

    Null is the empty text (its end id alone). Repeated doc_ids follow each other in text order.
    """
    return read_codes(write_codes(docs, path, end_id))
