"""Language identification with string kernels.

Texts are compared by the presence of byte n-grams of several lengths (a blended spectrum):
k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y). Landmark texts span a Nyström feature
space, one-versus-rest kernel ridge regression is solved in it on the driver over a bounded sample,
and a batch is scored by one matrix product: presence matrix times (landmark presence times weights).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import tidy

#: Lengths of n-grams, in bytes.
SPECTRUM = (1, 2, 3, 4)
#: N-grams are hashed to so many slots (2 ** SLOT_BITS), each present or absent.
SLOT_BITS = 18
#: The sample: so many labelled rows of each language at most, the first of them landmarks.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 300, 48
RIDGE = 1e-3
BATCH = 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def slots_of(text: str) -> np.ndarray:
    """Slots (repeated ones too) of a text's n-grams; case, digits and ASCII punctuation do not count."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_ONLY_LETTERS) + b" ", np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(SPECTRUM) + 1):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in SPECTRUM:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(mixed >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(out)


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << SLOT_BITS), np.float32)
    for row, text in zip(out, texts, strict=True):
        row[slots_of(text)] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # the slots that any landmark has
    weights: np.ndarray  # slots x languages: landmark presence times regression weights

    def scores(self, texts: list[str]) -> np.ndarray:
        held = np.zeros((len(texts), len(self.slots)), np.float32)
        own = np.zeros(len(texts), np.float32)
        mark = np.zeros(1 << SLOT_BITS, bool)
        for i, text in enumerate(texts):
            mark[:] = False
            mark[slots_of(text)] = True
            own[i] = np.count_nonzero(mark)
            held[i] = mark[self.slots]
        return held @ self.weights / np.sqrt(np.maximum(own, 1))[:, None]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for k in range(0, len(some), BATCH):
            rows = some[k : k + BATCH]
            found = self.scores([texts[i] for i in rows])
            for i, c in zip(rows, found.argmax(axis=1), strict=True):
                names[i] = self.languages[c]
            scores[rows] = np.clip((found.max(axis=1) + 1) / 2, 0, 1)
        return names, scores


def fit(texts: list[str], languages: list[str], landmarks: list[int]) -> Model:
    names = sorted(set(languages))
    if not texts:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    marks = presence([texts[i] for i in landmarks])
    slots = np.flatnonzero(marks.any(axis=0))
    marks = marks[:, slots] / np.sqrt(marks.sum(axis=1))[:, None]
    rows = []
    for i in range(0, len(texts), BATCH):
        own = presence(texts[i : i + BATCH])
        rows.append(own[:, slots] @ marks.T / np.sqrt(own.sum(axis=1))[:, None])
    kernel, between = np.vstack(rows).astype(np.float64), (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ root
    targets = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # one class weighs as much as the other in each one-versus-rest problem
    weights = np.empty((features.shape[1], len(names)))
    for c in range(len(names)):
        mine = targets[:, c] > 0
        each = np.where(mine, 0.5 / mine.sum(), 0.5 / max(1, (~mine).sum())) * len(texts)
        left = features.T @ (features * each[:, None]) + RIDGE * len(texts) * np.eye(features.shape[1])
        weights[:, c] = np.linalg.solve(left, features.T @ (each * targets[:, c]))
    return Model(names, slots, (marks.T @ (root @ weights)).astype(np.float32))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE_PER_LANGUAGE different training rows of each language, drawn by a hash; n counts from 1."""
    rows = docs.where(~held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull()).where(
        "lang is not null and text is not null"
    )
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    # ranked in parts of a language first, so no task holds a frequent one
    best = lambda frame, *by: frame.withColumn(
        "n", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "doc_id", "text"))
    ).where(F.col("n") <= SAMPLE_PER_LANGUAGE)
    keys = rows.select("doc_id", "lang", F.sha2("text", 256).alias("text"), "h", "part").distinct()
    keys = best(best(keys, "part").drop("n")).select("lang", "h", "n", F.col("text").alias("digest"), F.col("doc_id").alias("id"))
    found = rows.join(F.broadcast(keys), ["lang", "h"]).where((F.sha2("text", 256) == F.col("digest")) & (F.col("doc_id") == F.col("id")))
    return found.dropDuplicates(["lang", "n"]).select("doc_id", "lang", "text", "n")


def train(docs: DataFrame) -> Model:
    rows = sample(docs.select("doc_id", "text", "lang")).select("lang", "n", "text").collect()
    rows = sorted((r for r in rows if _LETTER.search(r["text"])), key=lambda r: (r["lang"], r["n"], r["text"]))
    marks = [i for i, r in enumerate(rows) if r["n"] <= LANDMARKS_PER_LANGUAGE] or list(range(len(rows)))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], marks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: slots x languages

    def run(batches):
        for batch in batches:
            names, scores = shared.value.label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, lang), all their columns, whose text has a language found by identify().

    Where nothing could be learned, the rows whose text has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if shared.value.languages:
                names, _ = shared.value.label(texts)
                found = [n != UNKNOWN for n in names]
            else:
                found = [bool(t and _LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows with a lang whose crc32(doc_id as text) mod 5 is not 0, at most
    SAMPLE_PER_LANGUAGE of each language. lang_pred is a learned language, or 'und' with score 0 where
    the text is null or has no letter or nothing could be learned; score is the winner's regression value,
    mapped from -1..1 to 0..1; ties go to the first language by name. Rows repeat as in docs; a null
    doc_id is not held out and not learned from. Other columns are ignored.
    """
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
