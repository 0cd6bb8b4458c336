"""N-gram Jaccard join of whole documents with prefix trees.

A document is the set of its distinct n-word shingles, kept as 64-bit hashes in one global
(ascending) order. Equal sets are one node, named by a digest. Three steps find the linked sets:

1. Routing. Sets of a size bucket are cut at the same points of the hash range. Two linked sets differ
   in at most d elements, so of the first d + 1 parts of a set that have q elements or more one at least
   is identical in both: put first, it is a common prefix of the two, and its hash is the key of a branch
   of the tree. A set with fewer such parts is also cut in other ways, at last with keys for all parts,
   the empty ones too, so no link is lost. Keys meet in packed blobs (exchange.py), not as rows.
2. Clusters. Sets that keys connect form a cluster and travel to it once, however many keys they share.
   A cluster is compared block against block: one block's sets are stored in a prefix tree
   (path-compressed, by their common beginnings), which is walked once for many probes together;
   overlaps of a shared beginning are counted once, and subtrees whose remaining lengths cannot reach
   the required overlap are pruned. A block sends only the links that connect its sets, and counts.
3. Large clusters, unless links are counted: the smallest set of a key is compared with the key's other
   sets (stars); keys whose sets are then not yet in one component are joined block against block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import discard, light, mix64, release, small_batches, stored, tidy, window_hashes, word_hashes, words_of
from veilframe.llm.exchange import ROWS, buckets_for, meetings
from veilframe.llm.graph import components

#: Sets in one Arrow batch.
TREE_SETS = 256
#: Sets and bytes of elements in one block of a key's sets; a set travels once for each block of its key.
BLOCK_SETS, BLOCK_BYTES = 1024, 8 << 20
#: Sets that keys connect and that are compared as one cluster.
CLUSTER_SETS = 4096
#: Rounds of stars before the rest is joined block by block.
STAR_ROUNDS = 2
#: Most elements that a part must have to be a key.
QUORUM = 5
#: Ways to cut a set before all its parts get keys.
LEVELS = 6
#: Elements between two tests of the remaining-length bound; less than 256, as overlaps within are bytes.
STRIDE = 128
#: Probes of one walk, and bytes of the table of their elements.
PROBES, PRESENT_BYTES = 256, 32 << 20
_BITS32 = np.uint64(32)


def shingle_set(data: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; fewer words make one shingle, none an empty set."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(hashes, n))


def buckets(size: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """(bucket, largest size in it) where a set of this size meets all its possible partners."""
    low, index = 1, 0
    while True:
        high = max(low, low * 3 // 2)
        if size <= high:
            yield index, high
            if size >= low and size * den // num <= high:
                return
            if size < low:
                return
        low, index = high + 1, index + 1


def difference(size: int, other: int, num: int, den: int) -> int:
    """Most elements in only one of two linked sets of these sizes."""
    return (size + other) * (den - num) // (den + num)


@lru_cache(maxsize=4096)
def cut_plan(high: int, num: int, den: int) -> tuple[int, int]:
    """(parts, q) for sets of at most so many elements: parts of q elements or more are keys.

    The largest q, and for it the fewest parts, that leave most sets of the bucket enough such parts
    if its elements fall at random; parts of few elements are often the same by chance.
    """
    most = difference(high, high, num, den)
    for q in range(QUORUM, 1, -1):
        for step in range(40, 4, -1):  # elements in a part, on average, in steps of a quarter
            parts = -(-4 * high // step)
            if parts > most and all(_enough(size, parts, q, high, num, den) for size in (high, high * num // den, high * 2 // 3)):
                return parts, q
    return most + 1 + (2 + most // 10 if most else 0), 1


def _enough(size: int, parts: int, q: int, high: int, num: int, den: int) -> bool:
    mean = size / parts
    share = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(q))
    wanted = difference(size, min(high, size * den // num), num, den) + 1
    return parts * share - 0.5 * math.sqrt(parts * share * (1 - share)) >= wanted


def routing_keys(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that two sets with Jaccard >= num/den, 100 of one size or not, have one in common.

    A set needs keys for its first d + 1 parts of q elements or more only, d being its largest difference from
    a partner: where the first of two linked sets reaches so many, at most d of them differ, and the other set,
    which reaches its own number there or later, has a key for the part that is the same.
    """
    out = []
    size = len(elements)
    for bucket, high in buckets(size, num, den):
        parts, quorum = cut_plan(high, num, den)
        wanted = difference(size, min(high, size * den // num), num, den) + 1
        for level in range(LEVELS + 1):
            cut = elements if level == 0 else np.sort(mix64(elements ^ np.uint64(0xA5A5 + level)))
            at = ((cut >> _BITS32) * np.uint64(parts)) >> _BITS32
            ends = np.cumsum(np.bincount(at.astype(np.int64), minlength=parts))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(cut), dtype=np.uint64)))
            starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
            full = np.flatnonzero(ends - starts >= quorum)
            label = np.arange(parts, dtype=np.uint64) + np.uint64(((bucket * 64 + level) << 32) + 1)
            keys = mix64((sums[ends] - sums[starts]) ^ mix64(label))
            enough = len(full) >= wanted
            out.append(keys if level == LEVELS and not enough else keys[full[:wanted]])
            if enough:
                break
    return np.concatenate(out)


class PrefixTree:
    """Ordered sets by common beginnings: lexicographic order and the length shared with the last one."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)
        self.universe, flat = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.places = np.split(flat, np.cumsum([len(x) for x in self.sets])[:-1])

    def together(self) -> int:
        """Probes that one walk takes."""
        return max(1, min(PROBES, PRESENT_BYTES // (len(self.universe) + STRIDE)))

    def walk(self, probes: list[np.ndarray], num: int, den: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, mask of linked probes) of the stored sets that have a link, Jaccard similarity >= num/den.

        wanted(position) masks the probes whose link with that set matters; None stands for all.
        """
        lengths = np.array([len(p) for p in probes], np.int64)
        held = np.zeros((-(-len(self.universe) // STRIDE) * STRIDE, len(probes)), np.uint8)
        for c, probe in enumerate(probes):
            spot = np.minimum(np.searchsorted(self.universe, probe), len(self.universe) - 1)
            held[spot[self.universe[spot] == probe], c] = 1
        # elements of each probe below every STRIDE-th of the universe: no more of it are passed there
        below = np.cumsum(held.reshape(-1, STRIDE, len(probes)).sum(axis=1, dtype=np.int32), axis=0)
        below = np.concatenate((np.zeros((1, len(probes)), np.int32), below))
        every = np.ones(len(probes), bool)
        # (depth, overlap of each probe up to there): one entry for each tested branching point
        path: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(probes), np.int64))]
        pruned_at = -1  # all sets that share so many elements with the last are pruned
        for k, own in enumerate(self.places):
            common = self.shared[k]
            if pruned_at >= 0:
                if common >= pruned_at:
                    continue
                pruned_at = -1
            while path[-1][0] > common:
                path.pop()
            need = -(-num * (lengths + len(own)) // (num + den))
            open_ = (every if wanted is None else wanted(self.order[k])) & (need <= np.minimum(lengths, len(own)))
            if not open_.any():
                continue
            depth, overlap = path[-1]
            while depth < len(own):
                end = min(len(own), depth + STRIDE)
                overlap = overlap + np.add.reduce(held[own[depth:end]], axis=0, dtype=np.uint8)
                depth = end
                path.append((depth, overlap))
                if not (open_ & (overlap + (len(own) - depth) >= need)).any():
                    # another set below this node may be longer or wanted: the subtree goes only if no probe's
                    # own remainder suffices there
                    left = lengths - below[own[depth - 1] // STRIDE]
                    if (overlap + left < -(-num * (lengths + depth) // (num + den))).all():
                        pruned_at = depth
                    break
            else:
                linked = open_ & (den * overlap >= num * (lengths + len(own) - overlap))
                if linked.any():
                    yield self.order[k], linked


class _Forest:
    """Components of the sets of one block, as labels."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.edges: list[tuple[int, int]] = []
        self.parts = size

    def join(self, a: int, b: int) -> None:
        if self.label[a] != self.label[b]:
            self.label[self.label == self.label[b]] = self.label[a]
            self.edges.append((a, b))
            self.parts -= 1


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, counts: bool):
    """Links between two blocks of different sets, or within one (right = None).

    (edges, numbers): edges connect all linked sets, named by position, those of right after those of left;
    numbers has every set's links in this comparison, if they are asked for.
    """
    sets = left + (right or [])
    forest, numbers = _Forest(len(sets)), np.zeros(len(sets), np.int64)
    tree, first = PrefixTree(right if right is not None else left), len(left) if right is not None else 0
    at, size = 0, tree.together() if counts else 1
    while at < len(left) and (counts or forest.parts > 1):
        own = np.arange(at, min(len(left), at + size))
        wanted = (lambda k, own=own: own != k) if right is None else None
        if not counts:
            wanted = lambda k, own=own: forest.label[own] != forest.label[first + k]
        for k, linked in tree.walk([left[i] for i in own], num, den, wanted):
            for i in own[linked].tolist() if forest.parts > 1 else ():
                forest.join(first + k, i)
            if counts:
                numbers[own] += linked
                if right is not None:
                    numbers[first + k] += int(linked.sum())
        at, size = at + size, min(tree.together(), 4 * size)
    return forest.edges, numbers


def _digest(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, seed=1) - 2**63


def _digests(n: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, n) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(map(len, sets), pa.int64()),
                    pa.array([_digest(x.tobytes()) for x in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "node"],
            )

    return run


def _routed(n: int, route: Callable[[np.ndarray], np.ndarray]):
    """(node, routing keys, None) of the different sets of a batch of texts."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        seen = set()
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            elements = shingle_set(text, n)
            node = _digest(elements.tobytes())
            if len(elements) and node not in seen:
                seen.add(node)
                yield node, route(elements), None

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            ids, sets, again = [], [], []
            columns = (batch.column("text").cast(pa.binary()), batch.column("node"), batch.column("again"))
            for text, node, repeated in zip(*[c.to_pylist() for c in columns], strict=True):
                raw = shingle_set(text, n).tobytes()
                if _digest(raw) == node:  # not another text of that doc_id
                    ids.append(node)
                    sets.append(raw)
                    again.append(repeated)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(again, pa.bool_())],
                ["id", "elements", "n_bytes", "again"],
            )

    return run


def _keys(route: Callable[[np.ndarray], np.ndarray]):
    def run(batches):
        for batch in batches:
            for own, raw in zip(batch.column("id").to_pylist(), batch.column("elements").to_pylist(), strict=True):
                keys = np.unique(route(np.frombuffer(raw, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), own, np.int64))], ["key", "id"])

    return run


def _probe(num: int, den: int):
    """Rows (probe, probe_set, id, elements), equal probes mostly adjacent -> links."""

    def run(batches):
        for batch in batches:
            probes = batch.column("probe").to_pylist()
            ids = batch.column("id").to_pylist()
            own, theirs = batch.column("probe_set"), batch.column("elements")
            u, v, start = [], [], 0
            for i in range(1, len(probes) + 1):
                if i == len(probes) or probes[i] != probes[start]:
                    tree = PrefixTree([np.frombuffer(theirs[j].as_py(), np.uint64) for j in range(start, i)])
                    for k, _ in tree.walk([np.frombuffer(own[start].as_py(), np.uint64)], num, den):
                        u.append(ids[start + k])
                        v.append(probes[start])
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _blocks(num: int, den: int, counts: bool):
    """Rows (key, a, b, side, id, elements) sorted by the first three -> (u, v) that connect, (u, null, links)."""

    def answer(rows):
        left = [r for r in rows if r[0] != 2]
        right = [r for r in rows if r[0] == 2] if any(r[0] for r in rows) else None
        if len(rows) < 2 or not left or right == []:
            return
        sets = [[np.frombuffer(r[2], np.uint64) for r in part] for part in (left, right or [])]
        edges, numbers = compare(sets[0], sets[1] if right else None, num, den, counts)
        ids = [r[1] for r in left + (right or [])]
        for a, b in edges:
            yield max(ids[a], ids[b]), min(ids[a], ids[b]), None
        for k in np.flatnonzero(numbers).tolist():
            yield ids[k], None, int(numbers[k])

    def run(batches):
        group, rows = None, []
        for batch in batches:
            found = []
            for key, a, b, *row in zip(
                *[batch.column(c).to_pylist() for c in ("key", "a", "b", "side", "id", "elements")], strict=True
            ):
                if (key, a, b) != group:
                    found.extend(answer(rows))
                    group, rows = (key, a, b), []
                rows.append(row)
            yield _found(found)
        yield _found(list(answer(rows)))

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v", "n"])


def _element_sets(base: DataFrame, prepared: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """id, elements, n_bytes of each wanted (doc_id, node), and the table they are stored in.

    Only the sets of repeated doc_ids are shuffled.
    """
    repeated = prepared.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    wanted = wanted.join(repeated, "doc_id", "left").select("doc_id", "node", F.coalesce("again", F.lit(False)).alias("again"))
    wanted = light(stored(wanted, "wanted"))
    with small_batches(base.sparkSession, ROWS):
        sets = stored(
            base.join(wanted, "doc_id").mapInArrow(tidy(_sets(n)), "id long, elements binary, n_bytes long, again boolean"), "elements"
        )
    once = sets.where("not again").select("id", "elements", "n_bytes")
    return once.union(sets.where("again").select("id", "elements", "n_bytes").dropDuplicates(["id"])), sets


def near_duplicates(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, count_links: bool = True,
    route: Callable[[np.ndarray], np.ndarray] | None = None, route_keys: int = 0,
) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id and, if asked for, n_links.

    Two documents link when den * |A & B| >= num * |A | B| over their sets of distinct n-word
    shingles (words split at ASCII white space, A-Z lower-cased; a text of fewer words is one
    shingle). component_id is the smallest doc_id reachable by links, the document's own included;
    n_links counts all links of its set to other, different sets: every two sets of a cluster are
    compared for it. Without it, links that a component implies are skipped.
    Null texts and texts without words have n_shingles 0 and link with nothing. Rows repeated as a
    whole have equal results; different texts under one doc_id are documents of their own; null
    doc_ids keep a null component_id. Other columns are ignored.

    route gives the keys, about route_keys of them, by which a set (its sorted hashes) meets those it may link
    with; without it routing_keys does, which lose no link.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark, ROWS):
        prepared = stored(base.mapInArrow(tidy(_digests(n)), "doc_id long, n_shingles long, node long"), "sets")
    named = base.where("doc_id is not null")
    rows, elements = prepared.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    keys = rows * route_keys if route else 4 * rows + 3 * elements * (den - num) // (den + num)
    route = route or partial(routing_keys, num=num, den=den)
    with small_batches(spark, ROWS):
        met = stored(meetings(named, _routed(n, route), buckets_for(keys)).select("u", "v").distinct(), "met")
    clusters = components(met)
    discard(met)
    reps = prepared.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    reps = stored(reps, "reps")
    sets, table = _element_sets(named, prepared, clusters.join(reps, "node").select(F.col("rep").alias("doc_id"), "node"), n)
    release(spark)

    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.lit(not count_links) & (F.col("size") > CLUSTER_SETS)), "large")
    members = clusters.join(large, "component", "left_anti").select(F.col("component").alias("key"), F.col("node").alias("id"))
    with small_batches(spark, TREE_SETS):
        found = stored(_block_join(members, sets, num, den, count_links), "found")
    release(spark)
    links = found.where("v is not null").select("u", "v")
    if not large.isEmpty():
        inside = clusters.join(large, "component", "left_semi").select(F.col("node").alias("id"))
        links = links.union(_large_clusters(sets.join(inside, "id"), num, den, route))

    labels = components(links)
    discard(table)
    release(spark)
    linked = reps.join(labels, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    classes = reps.join(linked.join(least, "component").select("node", "least"), "node", "left")
    if count_links:
        degree = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
        classes = classes.join(degree, "node", "left")
    else:
        classes = classes.withColumn("n_links", F.lit(0))
    classes = classes.select("node", F.coalesce("least", "rep").alias("least"), "n_links")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    some = prepared.where("n_shingles > 0").join(classes, "node", "left").select("doc_id", "n_shingles", of, *count)
    none = prepared.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if count_links else [])
    )
    return some.union(none)


def _large_clusters(sets: DataFrame, num: int, den: int, route: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Links that connect the linked sets (id, elements, n_bytes) of clusters too large to be compared as a whole."""
    spark = sets.sparkSession
    keys = sets.select("id", "elements").mapInArrow(tidy(_keys(route)), "key long, id long").repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("probe"), F.max("id").alias("last")).where("probe < last")
    members, links, rest = stored(keys.join(shared.select("key", "probe"), "key"), "members"), None, True
    for _ in range(STAR_ROUNDS):
        pairs = members.where("id <> probe").select("probe", "id").distinct()
        probed = pairs.join(sets.select("id", "elements"), "id").join(
            sets.select(F.col("id").alias("probe"), F.col("elements").alias("probe_set")), "probe"
        )
        with small_batches(spark, TREE_SETS):
            found = stored(probed.mapInArrow(tidy(_probe(num, den)), "u long, v long"), "found")
        del probed
        release(spark)
        links = found if links is None else links.union(found)
        members, rest = _unsettled(members, components(links))
        if not rest:
            return links
    with small_batches(spark, TREE_SETS):
        found = stored(_block_join(_clustered(members), sets, num, den, False), "found")
    return links.union(found.select("u", "v"))


def _unsettled(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """Members, without the probes done, of keys that still hold several components; a new probe each."""
    named = (
        members.where("id <> probe").select("key", "id")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"))
    )
    named = stored(named, "named")
    open_keys = (
        named.groupBy("key")
        .agg(
            F.min("component").alias("a"), F.max("component").alias("b"), F.min("id").alias("probe"),
            F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"),
        )
        .where("a < b")
    )
    # keys of the same members ask the same question
    once = open_keys.groupBy("who", "n", "probe").agg(F.min("key").alias("key")).select("key", "probe")
    out = stored(named.join(once, "key").select("key", "id", "probe", "component"), "members")
    return out, not out.isEmpty()


def _clustered(members: DataFrame) -> DataFrame:
    """(key, id) with a cluster in place of its keys where the cluster is small enough."""
    clusters = components(members.where("id <> probe").select(F.col("id").alias("u"), F.col("probe").alias("v")))
    placed = stored(
        members.select("key", "id")
        .join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
        .select("key", "id", "cluster"),
        "clusters",
    )
    once = placed.select("cluster", "id").distinct()
    small = once.groupBy("cluster").count().where(F.col("count") <= CLUSTER_SETS).select("cluster")
    return once.join(small, "cluster").select(F.col("cluster").alias("key"), "id").union(
        placed.join(small, "cluster", "left_anti").select("key", "id")
    )


def _block_join(members: DataFrame, sets: DataFrame, num: int, den: int, counts: bool) -> DataFrame:
    """Links (u, v) and numbers (u, null, n) among each key's sets, block against block."""
    sizes = members.join(sets.select("id", "n_bytes"), "id").groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_SETS), F.sum("n_bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        "id",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    # against another block, a set of the first probes the second's tree; the block's own pairs are (a, a)
    together = spread.join(sets.select("id", "elements"), "id").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side", "id")
    return together.mapInArrow(tidy(_blocks(num, den, counts)), "u long, v long, n long")
