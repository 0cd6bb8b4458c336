"""Packed keys against a plain dictionary of owners."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from veilframe.llm import exchange

KEYS = np.random.default_rng(0).integers(0, 2**64, 300, dtype=np.uint64)


def owners_of(docs):
    owners = defaultdict(set)
    for doc, keys, marks in docs:
        for key, mark in zip(keys.tolist(), marks.tolist(), strict=True):
            owners[key].add((doc, mark))
    return owners


@pytest.mark.parametrize("most", [None, 3])
@pytest.mark.parametrize("held", [1, 16])
def test_meetings(spark, monkeypatch, most, held):
    monkeypatch.setattr(exchange, "HELD", held)
    monkeypatch.setattr(exchange, "CHUNK_ROWS", 20)
    rng = np.random.default_rng(1)
    docs = []
    for doc in rng.permutation(np.arange(-30, 30)).tolist():
        at = rng.choice(300, 20, replace=False)
        docs.append((doc, KEYS[at], at % 3 == 0))
    own = {doc: (keys, marks) for doc, keys, marks in docs}
    owners = owners_of(docs)

    def keyed(batch):
        for doc in batch.column("doc").to_pylist():
            yield doc, np.concatenate((own[doc][0], own[doc][0][:3])), np.concatenate((own[doc][1], own[doc][1][:3]))

    rows = spark.createDataFrame([(doc,) for doc, *_ in docs], "doc long").repartition(3)
    got = Counter()
    for r in exchange.meetings(rows, keyed, 2, most).collect():
        assert r.u > r.v
        got[r.u, r.v, 0] += r.n
        got[r.u, r.v, 1] += r.marked
    want = Counter()
    for found in owners.values():
        found = sorted(found)
        if most is None and len(found) > 1:
            pairs = [(x, found[0]) for x in found[1:]]
        else:
            pairs = [(x, y) for x in found for y in found if x > y] if len(found) <= (most or 0) else []
        for (u, mark), (v, _) in pairs:
            want[u, v, 0] += 1
            want[u, v, 1] += mark
    if most is None and held == 1:  # owners are connected, in as many meetings, but not all with the smallest
        total = lambda x: sum(n for (*_, k), n in x.items() if not k)
        assert total(got) == total(want)
    else:
        assert +got == +want
