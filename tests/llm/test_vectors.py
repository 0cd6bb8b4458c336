"""Hard negatives and vector codes against brute force, with nulls, ties, repeats, odd lengths and empty tables."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.core.oracle import connect, rows
from veilframe.llm import codebooks, hard_negatives, queries

FORM = "vec_id long, label int, embedding array<double>, score string, cell string, block int, bucket int"


def table(spark, data):
    """Rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in data], FORM)


def random_rows(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    out = [(i, int(rng.integers(labels)), (0.2 * (centres[i % 5] + rng.normal(size=dim))).tolist()) for i in range(n)]
    for i in range(0, n, 9):  # exact copies of vectors under other ids
        out[i] = (i, out[i][1], out[i // 2][2])
    return out


ODD = [
    (900, None, [0.1, 0.2]), (901, 1, None), (902, 1, [0.1, None]), (903, 1, [0.1, math.nan]), (904, 1, [math.inf, 0.2]), (None, 2, [0.3, 0.1]),
]


def usable(data):
    return [r for r in data if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


def brute_negatives(data, anchors, width, positives=5, negatives=10):
    seen = {}
    for vec_id, label, v in usable(data):
        if label is not None:
            v = [math.floor(256 * x) for x in v]
            seen[vec_id, label, tuple(v + [0] * (width - len(v)))] = None
    best = lambda rows: sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    out = []
    for a in seen:
        if a[0] is None or not anchors(a[0]):
            continue
        scored = [(r[0], sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[1] == a[1]) for r in seen if r != a]
        for positive, p, _ in best([s for s in scored if s[2]])[:positives]:
            inside = [s for s in scored if not s[2] and 30 * p <= 100 * s[1] <= 90 * p]
            out += [(a[0], positive, k + 1, n, p, s) for k, (n, s, _) in enumerate(best(inside)[:negatives])]
    return sorted(out, key=str)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("leaf", "block", "sample", "together"), [(256, 8192, 4096, 1024), (4, 40, 64, 7), (3, 16, 5, 1024)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, leaf, block, sample, together):
    for name, value in {"LEAF": leaf, "BLOCK_ROWS": block, "SAMPLE_ROWS": sample, "TOGETHER": together, "SLICE": 10}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    data = random_rows(300, 6, 3) + [(900, None, [0.1] * 6), (901, 1, None), (902, 1, [0.1, math.nan]), (None, 2, [0.3, 0.1]), (20, 1, [0.5] * 6), (903, 2, [])]
    data += data[40:60]  # repeated as a whole
    got = hard_negatives.hard_negatives(table(spark, data), F.col("vec_id") % 20 == 0)
    assert got.columns == NAMES
    want = brute_negatives(data, lambda i: i % 20 == 0, 6)
    assert len(want) > 300 and sorted(map(tuple, got.collect()), key=str) == want


def test_hard_negatives_of_edges(spark):
    mine = lambda data: hard_negatives.hard_negatives(table(spark, data), F.col("vec_id") % 100 == 0)
    assert mine([]).collect() == [] and mine([(0, 1, [0.1])]).collect() == [] and mine([(0, 1, [])]).collect() == []
    one_vector = [(i, i % 2, [0.25, 0.5]) for i in range(40)]  # all scores tie, outside every window
    assert mine(one_vector).collect() == []
    ties = [(0, 1, [0.5]), (1, 1, [0.5]), *[(i, 2, [0.25]) for i in range(30, 9, -1)], (None, 2, [0.25])]
    assert [(r.rank, r.negative_id) for r in sorted(mine(ties).collect())] == [(k + 1, 10 + k) for k in range(10)]
    zeros = [(0, 1, [0.0]), (1, 1, [0.5]), (2, 2, [0.7])]  # a positive's score of 0 asks for scores of 0
    assert [tuple(r) for r in mine(zeros).collect()] == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ArithmeticError):
        mine([(0, 1, [1e30])])


def test_search_stops_before_far_leaves():
    """With well-parted clusters the tree leaves most leaves unread and still finds the best rows."""
    rng = np.random.default_rng(1)
    points = np.repeat(rng.integers(-900, 900, size=(16, 8)), 64, axis=0) + rng.integers(-3, 4, size=(1024, 8))
    most = float((points * points).sum(axis=1).max())
    tree = hard_negatives.VantageTree(hard_negatives._augmented(points.astype(float), most), 5)
    low, _ = hard_negatives.ring(tree.spans, hard_negatives._away(points[:1].astype(float), points[tree.centres].astype(float), most))
    scores = points @ points[0]
    top, _ = hard_negatives._scores(low, low, np.array([float(points[0] @ points[0])]), most)
    kth = np.sort(scores)[-10]
    assert (top[0] >= kth).sum() <= 16
    for leaf in range(32):
        assert scores[tree.order[tree.ends[leaf] : tree.ends[leaf + 1]]].max() <= top[0, leaf]


def brute_codes(data, parts, entries, rounds, width):
    kept = sorted(usable(data), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = width // parts
    full = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in full]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(p, v[p])[1], []).append(v[p])
            books[p] = [
                tuple(sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)) if e in groups else c for e, c in enumerate(books[p])
            ]
    out, of_label = [], {}
    for (vec_id, label, _), v in zip(kept, cut, strict=True):
        found = [near(p, v[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        of_label[label] = of_label.get(label, 0) + error
        out.append((vec_id, label, "".join(f"{f[1]:02x}" for f in found), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, of_label[label], digest) for i, label, code, error in out), key=str)


@pytest.mark.parametrize(("n", "dim", "parts"), [(200, 8, 8), (200, 10, 4), (9, 4, 2)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dim, parts):
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 7)
    data = random_rows(n, dim, n) + ODD + [(5, 3, [0.5])]
    data += data[4:8] + data[:1]
    got = codebooks.compress(table(spark, data), parts=parts, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    width = -(-dim // parts) * parts
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(data, parts, 16, 3, width)


def test_codes_of_edges(spark):
    assert codebooks.compress(table(spark, [])).collect() == []
    assert codebooks.compress(table(spark, [(1, 1, None)])).collect() == []
    row = codebooks.compress(table(spark, [(1, None, [])])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in row] == [(1, "00" * 8, 0, 0)]
    with pytest.raises(ArithmeticError):
        codebooks.compress(table(spark, [(1, 1, [1e12])]))


def test_vector_queries_equal_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name in ("op11_vantage_point_negatives", "op12_tensored_minhash", "op13_vector_codebooks"):
        got = rows(queries.queries()[name](spark, sf_dir).toPandas())
        assert got == rows(con.execute(queries.oracle_sql()[name]).df())


def test_matrix_pads_short_vectors():
    import pyarrow as pa

    column = pa.array([[1.0], [], [2.0, 3.0]])
    assert codebooks.matrix(column, 3).tolist() == [[1, 0, 0], [0, 0, 0], [2, 3, 0]]
    assert codebooks.matrix(column.slice(1), 2).tolist() == [[0, 0], [2, 3]]
    assert list(itertools.chain(*codebooks.matrix(column.slice(2), 2).tolist())) == [2, 3]
