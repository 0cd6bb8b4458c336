"""Tensored banding: similarity estimates, keys, and classes against brute force."""

import random

import numpy as np

from tests.llm.test_operators import brute_components
from veilframe.llm import graph, jaccard
from veilframe.llm.minhash import HALF, SIDE, TensoredBands, deduplicated


def test_minhashes_estimate_similarity_and_tables_combine_two_collections():
    rng = np.random.default_rng(5)
    bands = TensoredBands(85, 100)
    same = []
    for _ in range(60):
        union = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.sort(union[:170]), np.sort(union[30:])  # 140 of 200
        same.append((bands.minhashes(a) == bands.minhashes(b)).mean())
    assert abs(np.mean(same) - 0.7) < 0.02
    own = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    keys = bands.keys(own)
    assert len(keys) == len(set(keys.tolist())) == SIDE * SIDE and bands.minhashes(own).size == 2 * SIDE * HALF
    missed = 0
    for k in range(400):  # pairs at the threshold itself
        union = np.random.default_rng(k).integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.sort(union[:185]), np.sort(union[15:])  # 170 of 200
        missed += not len(np.intersect1d(bands.keys(a), bands.keys(b)))
    assert missed == 0
    assert [len(bands.keys(np.arange(n, dtype=np.uint64))) for n in (0, 1, 5, 6)] == [0, 0, 0, SIDE * SIDE]


def documents(rng):
    docs = {}
    for group in range(8):
        base = [f"g{group}w{k}" for k in range(rng.randint(8, 160))]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"n{rng.getrandbits(30)}"
            docs[len(docs) * 3] = " ".join(own)
    for text in ("", None, "one", "One", "one two", "a b c d e", "a b c d e f", "\x0b\x1c", "x " * 3000, "line one two three four five " * 400):
        docs[len(docs) * 3] = text
    return docs


def test_classes_equal_brute_force(spark, monkeypatch):
    docs = documents(random.Random(4))
    frame = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs.items()], "doc_id long, text string, node string, kept string, rep int")
    want = brute_components(docs, 5, 85, 100)
    for size in (jaccard.CLUSTER_SETS, 1):
        monkeypatch.setattr(jaccard, "CLUSTER_SETS", size)
        got = deduplicated(frame)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (7, text), (7, text), (9, text.upper()), (7, "other words than those"), (None, None)]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 56, None, True), (7, 56, 7, True), (7, 56, 7, True), (9, 56, 7, False), (7, 1, 7, True), (None, 0, None, True)], key=str
    )
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_alone_and_by_stars_agree(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300, 420)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "u long, v long")
    alone = sorted(map(tuple, graph.components(frame).collect()))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert sorted(map(tuple, graph.components(frame).collect())) == alone
    assert (420, 300) in alone and graph.components(frame.limit(0)).collect() == []
