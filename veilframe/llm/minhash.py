"""MinHash near-duplicates with tensored banding.

Two small collections of bands are hashed from a set: SIDE bands of HALF minhashes in each. A table's key
combines one band of the first collection with one of the second, so 2 * SIDE * HALF minhashes fill SIDE * SIDE
tables of 2 * HALF minhashes a key, where independent tables would need SIDE times as many. Documents that meet in
a table are candidates; links are confirmed on the full sets, and classes are components of the links.

A pair of similarity s meets nowhere with a probability of 1 - (1 - (1 - s^HALF)^SIDE)^2: 1.5 in 100,000 at s = 0.85,
8 in 100 million at 0.9. Sets too small to have a different partner at all have no keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import mix64
from veilframe.llm.jaccard import near_duplicates

#: Bands in each of the two collections, and minhashes in a band.
SIDE, HALF = 16, 4
#: Elements hashed at a time.
CHUNK = 4096


@dataclass(frozen=True)
class TensoredBands:
    """Table keys of sorted 64-bit elements; sets that can link with none but their equals have none."""

    num: int
    den: int
    side: int = SIDE
    half: int = HALF

    def minhashes(self, elements: np.ndarray) -> np.ndarray:
        """(collection, band, minhash in it); each hash function mixes with an own number and an own odd factor."""
        count = np.arange(2 * self.side * self.half, dtype=np.uint64)
        own, odd = mix64(count + np.uint64(0x51ED)), mix64(count + np.uint64(0xB5297)) | np.uint64(1)
        least = np.full(len(count), np.iinfo(np.uint64).max)
        for at in range(0, len(elements), CHUNK):
            part = (elements[None, at : at + CHUNK] ^ own[:, None]) * odd[:, None]
            least = np.minimum(least, part.min(axis=1))
        return least.reshape(2, self.side, self.half)

    def keys(self, elements: np.ndarray) -> np.ndarray:
        if self.den * len(elements) < self.num * (len(elements) + 1):
            return np.empty(0, np.uint64)
        hashes = self.minhashes(elements)
        bands = np.zeros((2, self.side), np.uint64)
        for k in range(self.half):
            bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + hashes[:, :, k])
        table = np.arange(self.side * self.side, dtype=np.uint64).reshape(self.side, self.side)
        return mix64(mix64(bands[0][:, None] + table) + bands[1][None, :]).ravel()


def deduplicated(docs: DataFrame, n: int = 5, num: int = 85, den: int = 100, side: int = SIDE, half: int = HALF) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when den * |A & B| >= num * |A | B| over their sets of distinct n-word shingles (words split at
    ASCII white space, A-Z lower-cased; a text of fewer words is one shingle). component_id is the smallest doc_id
    reachable by links, its own included; kept is true where it is the document's own.

    Null texts and texts without words have no shingles, link with nothing and are kept. Rows repeated as a whole
    have equal results; different texts under one doc_id are documents of their own; null doc_ids have a null
    component_id and are kept. Other columns are ignored; an empty table gives no rows.
    """
    bands = TensoredBands(num, den, side, half)
    found = near_duplicates(docs, n, num, den, count_links=False, route=bands.keys, route_keys=side * side)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
