"""A hidden Markov language model over words, trained by Baum-Welch over the whole training part.

A state emits a word class, a class emits its words: b(word | state) = B[state, class] * p(word | class).
Classes are a fixed function of the word (short words by their hash, longer ones by the hash of their
ending), so the trained matrices are bounded; p(word | class) comes from exact counts of every training
word. The texts are read once: each task writes its documents as class sequences and block-local word
numbers, and its blocks' dictionaries. Word counts are summed over all dictionaries and sent back to the
blocks, so no table of words is broadcast. Each Baum-Welch pass maps over the stored sequences and sums
expected counts over the partitions; the scaled forward recursion then gives the exact likelihood.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, stored, words_of

STATES = 8
SHORT_CLASSES, CLASSES = 1024, 2048
#: The class and hash of the end of a text.
END_CLASS, END_HASH = CLASSES - 1, 0
PASSES = 5
#: Training sequences over WHOLE go in segments side by side, with the states that the whole sequence has at each border.
WHOLE, SEGMENT = 1024, 256
#: Most sequences, and most places (sequences x longest), that training works through at once; sequences scored at once.
SEGMENTS, PLACES, SCORED = 512, 1 << 17, 256
#: Steps after which products of transfer matrices are scaled.
SCALED = 16
#: Words after which a block's dictionary is closed.
BLOCK_WORDS = 2_000_000


def word_class(word: bytes) -> int:
    if len(word) <= 4:
        return zlib.crc32(word) % SHORT_CLASSES
    return SHORT_CLASSES + zlib.crc32(word[-3:]) % (CLASSES - SHORT_CLASSES - 1)


class _Numbered(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


_PACKED = "block long, doc_id long, held_out boolean, words binary, classes binary, hashes binary, counts binary"


def _read_texts(batches):
    """Documents as numbers, then the dictionary of their block (a row without words)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    part, block = TaskContext.get().partitionId(), 0
    names = ["block", "doc_id", "held_out", "words", "classes", "hashes", "counts"]
    numbers, docs, size = _Numbered(), [], 0

    def flush():
        spelled = list(numbers)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else END_HASH for w in spelled), np.uint64, len(spelled))
        classes = np.fromiter((word_class(w) if w else END_CLASS for w in spelled), np.uint16, len(spelled))
        counts, rows, number = np.zeros(len(spelled), np.uint32), [], (part << 24) + block
        for doc_id, held, own in docs:
            if not held:
                counts += np.bincount(own, minlength=len(spelled)).astype(np.uint32)
            rows.append((number, doc_id, held, pack(own.tobytes()), pack(classes[own].tobytes()), None, None))
        rows.append((number, None, None, None, pack(classes.tobytes()), pack(hashes.tobytes()), pack(counts.tobytes())))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
        for i in range(0, len(rows), 2000):
            columns = zip(*rows[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for doc_id, out, text in zip(ids, held, texts, strict=True):
            words = words_of(text.as_py())
            words.append(b"")
            docs.append((doc_id, out, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield from flush()
                numbers, docs, size, block = _Numbered(), [], 0, block + 1
    if docs:
        yield from flush()


def _dictionary(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row in batch.to_pylist():
            hashes = np.frombuffer(unpack(row["hashes"]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes), pa.array(np.full(len(hashes), row["block"])),
                    pa.array(np.arange(len(hashes), dtype=np.int32)),
                    pa.array(np.frombuffer(unpack(row["classes"]), np.uint16).astype(np.int32)),
                    pa.array(np.frombuffer(unpack(row["counts"]), np.uint32).astype(np.int64)),
                ],
                ["hash", "block", "number", "class", "n"],
            )


@dataclass
class _Piece:
    """A stretch of a sequence: its classes, the state distribution that enters it (before its first emission),
    that of the place before (zeros at the begin of a sequence) and the backward state after its last place."""

    seen: np.ndarray
    enter: np.ndarray
    last: np.ndarray
    back: np.ndarray


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    @staticmethod
    def first(states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = np.exp(rng.normal(0, 0.5, (states, CLASSES)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + (0.9 - 0.1 / max(1, states - 1)) * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expect(self, sequences: list[np.ndarray], into: np.ndarray) -> None:
        """Add expected counts of whole class sequences to [start; moves; emissions] (2 * states + 1 rows).

        A sequence over WHOLE is worked through in segments side by side: the products of their transfer
        matrices carry the forward state into each segment and the backward state out of it, so the counts,
        those of the moves across borders too, are those of the uncut sequence.
        """
        states = len(self.start)
        pieces = [_Piece(s, self.start, np.zeros(states), np.ones(states)) for s in sequences if len(s) <= WHOLE]
        pieces += self._segments([s for s in sequences if len(s) > WHOLE])
        pieces.sort(key=lambda p: len(p.seen))
        i = 0
        while i < len(pieces):
            n = min(SEGMENTS, len(pieces) - i)
            while n > 1 and n * len(pieces[i + n - 1].seen) > PLACES:
                n = max(1, min(n - 1, PLACES // len(pieces[i + n - 1].seen)))
            self._expect(pieces[i : i + n], into)
            i += n

    def _segments(self, sequences: list[np.ndarray]) -> list[_Piece]:
        """The segments of sequences, with the forward state before and the backward state after each."""
        states, out = len(self.start), []
        cut = [[s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)] for s in sequences]
        flat, products = [x for own in cut for x in own], []
        for i in range(0, len(flat), SEGMENTS):
            products.extend(self._products(flat[i : i + SEGMENTS]))
        for own in cut:
            through, products = products[: len(own)], products[len(own) :]
            pieces, enter, last = [], self.start, np.zeros(states)
            for seen, product in zip(own, through, strict=True):
                pieces.append(_Piece(seen, enter, last, np.ones(states)))
                last = enter @ product
                last = last / last.sum()
                enter = last @ self.move
            back = np.ones(states)
            for piece, product in zip(reversed(pieces), reversed(through), strict=True):
                piece.back = back
                back = self.move @ (product @ back)
                back = back / back.sum()
            out += pieces
        return out

    def _products(self, group: list[np.ndarray]) -> np.ndarray:
        """Of each segment, up to a factor: its first emissions, then each move and its emissions, as one matrix."""
        states = len(self.start)
        order = sorted(range(len(group)), key=lambda k: len(group[k]))
        lengths = np.array([len(group[k]) for k in order])
        seen = np.zeros((int(lengths[-1]), len(group)), np.int64)
        for c, k in enumerate(order):
            seen[: len(group[k]), c] = group[k]
        first = np.searchsorted(lengths, np.arange(lengths[-1]), side="right").tolist()
        moved, emits = np.ascontiguousarray(self.move.T), np.take(self.emit, seen, axis=1)
        # state reached x state left x segment
        out = np.eye(states)[:, :, None] * emits[:, 0][:, None, :]
        for t in range(1, len(seen)):
            k = first[t]
            now = (moved @ out[:, :, k:].reshape(states, -1)).reshape(states, states, -1)
            np.multiply(now, emits[:, t, k:][:, None, :], out=out[:, :, k:])
            if t % SCALED == 0:
                out[:, :, k:] /= out[:, :, k:].max(axis=(0, 1))
        found = np.empty((len(group), states, states))
        found[order] = (out / out.max(axis=(0, 1))).transpose(2, 1, 0)
        return found

    def _expect(self, group: list[_Piece], into: np.ndarray) -> None:
        """expect() for pieces in the order of their lengths, which fit into PLACES.

        Arrays are states x time x pieces. Both recursions are scaled every SCALED steps only; all else is
        done for all places together.
        """
        states = len(self.start)
        lengths = np.array([len(p.seen) for p in group])
        longest = int(lengths[-1])
        seen = np.zeros((longest, len(group)), np.int64)
        live = np.arange(longest)[:, None] < lengths[None, :]
        for k, p in enumerate(group):
            seen[: len(p.seen), k] = p.seen
        # pieces end in the order of their places: those from first[t] on are still there at t
        first = np.searchsorted(lengths, np.arange(longest), side="right").tolist()
        enter, last, back = (np.array([getattr(p, x) for p in group]).T.copy() for x in ("enter", "last", "back"))
        emits = np.take(self.emit, seen, axis=1)
        ahead, own = np.zeros_like(emits), np.zeros_like(emits)
        factor = np.ones((longest, len(group)))
        moved = np.ascontiguousarray(self.move.T)
        now = enter * emits[:, 0]
        ahead[:, 0] = now
        for t in range(1, longest):
            k = first[t]
            now = (moved @ ahead[:, t - 1, k:]) * emits[:, t, k:]
            if t % SCALED == 0:
                factor[t, k:] = now.sum(0)
                now /= factor[t, k:]
            ahead[:, t, k:] = now
        for t in range(longest - 1, -1, -1):
            k = first[t]
            own[:, t, k:] = back[:, k:]
            if t:
                now = self.move @ (emits[:, t, k:] * back[:, k:])
                if t % SCALED == 0:
                    now /= now.sum(0)
                back[:, k:] = now
        emits *= own
        own *= ahead
        sums = own.sum(0)
        sums[~live] = 1
        own /= sums
        emits *= live / (sums * factor)
        moves = last @ emits[:, 0].T
        for t in range(1, longest):
            moves += ahead[:, t - 1] @ emits[:, t].T
        into[0, :states] += own[:, 0][:, ~last.any(axis=0)].sum(1)
        into[1 : states + 1, :states] += moves * self.move
        flat = seen.ravel()
        for s in range(states):
            into[states + 1 + s] += np.bincount(flat, own[s].ravel(), CLASSES)

    @staticmethod
    def of_counts(counts: np.ndarray, states: int = STATES) -> Model:
        start = counts[0, :states] + 1
        move = counts[1 : states + 1, :states] + 0.1
        emit = counts[states + 1 :] + 0.01
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each class sequence, by the scaled forward recursion over its whole length."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        out = np.zeros(len(sequences))
        for i in range(0, len(order), SCORED):
            rows = order[i : i + SCORED]
            lengths = np.array([len(sequences[k]) for k in rows])
            seen = np.zeros((lengths[0], len(rows)), np.uint16)
            for c, k in enumerate(rows):
                seen[: len(sequences[k]), c] = sequences[k]
            alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            by_class, total = self.emit.T, np.zeros(len(rows))
            now = np.tile(self.start, (len(rows), 1))
            scales = np.ones((min(lengths[0], 1024), len(rows)))
            for t in range(lengths[0]):
                n = alive[t]
                now = (now[:n] @ self.move if t else now[:n]) * by_class[seen[t, :n]]
                sums = now.sum(1)
                now = now / sums[:, None]
                scales[t % len(scales), :n] = sums
                if (t + 1) % len(scales) == 0 or t + 1 == lengths[0]:
                    total += np.log10(scales).sum(0)
                    scales[:] = 1
            out[rows] = total
        return out


def _expectation(model: Model):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        states = len(model.start)
        counts, some = np.zeros((2 * states + 1, CLASSES)), False
        for batch in batches:
            held = [np.frombuffer(unpack(raw), np.uint16) for raw in batch.column("classes").to_pylist()]
            model.expect(held, counts)
            some = some or bool(held)
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(counts)), pa.int32()), pa.array(list(counts), pa.list_(pa.float64()))], ["row", "sums"]
            )

    return run


def train(sequences: DataFrame, passes: int = PASSES, states: int = STATES) -> Model:
    """Baum-Welch passes over all training sequences (classes binary)."""
    model = Model.first(states)
    for _ in range(passes):
        sums = (
            sequences.mapInArrow(_expectation(model), "row int, sums array<double>")
            .select("row", F.posexplode("sums").alias("place", "n"))
            .where("n <> 0").groupBy("row", "place").agg(F.sum("n").alias("n")).collect()
        )
        counts = np.zeros((2 * states + 1, CLASSES))
        for r in sums:  # at most (2 * states + 1) * CLASSES numbers
            counts[r["row"], r["place"]] = r["n"]
        model = Model.of_counts(counts, states)
    return model


def _score(model: Model, words: int, tokens: int, class_words: np.ndarray, class_tokens: np.ndarray):
    """Rows by block, the dictionary's before the documents'."""
    norm = np.log10(class_tokens + class_words + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        block, logs, known, fresh = None, None, None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, logs, fresh = blocks[a], None, []
                numbers = piece.column("number").drop_null().to_numpy()
                if len(numbers):
                    fresh.append((numbers, piece.column("n").drop_null().to_numpy()))
                rows = piece.slice(len(numbers))
                if not len(rows):
                    continue
                if logs is None:
                    at, n = (np.concatenate(x) for x in zip(*fresh, strict=True))
                    counts = np.zeros(at.max() + 1, np.int64)
                    counts[at] = n
                    logs, known, fresh = np.log10(counts + 1.0), counts > 0, []
                own = [np.frombuffer(unpack(x), np.uint32) for x in rows.column("words").to_pylist()]
                classes = [np.frombuffer(unpack(x), np.uint16) for x in rows.column("classes").to_pylist()]
                sizes = np.array([len(x) for x in own])
                firsts, flat = np.cumsum(sizes) - sizes, np.concatenate(own)
                found = np.add.reduceat(logs[flat], firsts)
                hidden = model.log10_likelihoods(classes) - np.add.reduceat(norm[np.concatenate(classes)], firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), rows.column("held_out"), pa.array(sizes, pa.int64()),
                        pa.array(np.add.reduceat(known[flat].astype(np.int64), firsts)),
                        pa.array(np.full(len(rows), tokens, np.int64)),
                        pa.array(found - sizes * np.log10(tokens + words + 1.0)), pa.array(found + hidden),
                    ],
                    names,
                )

    return run


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z lower-cased and one end. Rows whose crc32(doc_id as text)
    mod folds is fold are held out; all others train. base_score is the smoothed unigram log10 probability,
    score the model's. Null is the empty text (its end alone), a null doc_id counts as ''. Repeated rows are
    counted and scored each; other columns are ignored. A word never seen in training has its class's
    reserve: one count of N + V + 1 of the class, as for the unigrams.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.crc32(name) % folds == fold).alias("held_out"),
    )
    packed = stored(base.mapInArrow(_read_texts, _PACKED), "sequences")
    entries = packed.where("hashes is not null").select("block", "classes", "hashes", "counts").mapInArrow(
        _dictionary, "hash long, block long, number int, class int, n long"
    )
    same = Window.partitionBy("hash")
    counted = stored(
        entries.select(
            "block", "number", "class", F.sum("n").over(same).alias("n"),
            (F.row_number().over(same.orderBy("block", "number")) == 1).alias("is_first"),
        ),
        "counts",
    )
    by_class = counted.where("is_first and n > 0").groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    class_words, class_tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class.collect():  # at most CLASSES rows
        class_words[r["class"]], class_tokens[r["class"]] = r["v"], r["n"]
    with small_batches(spark, 2000):
        model = train(packed.where("words is not null and not held_out").select("classes"))
    rows = packed.where("words is not null").select(
        "block", F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("n"),
        "doc_id", "held_out", "words", "classes",
    )
    sent = counted.select("block", "number", "n").unionByName(rows, allowMissingColumns=True)
    placed = sent.repartition("block").sortWithinPartitions("block", F.col("number").asc_nulls_last())
    return placed.mapInArrow(
        _score(model, int(class_words.sum()), int(class_tokens.sum()), class_words, class_tokens),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
