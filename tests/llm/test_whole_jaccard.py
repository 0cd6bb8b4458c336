"""Numbers of links against brute force."""

import random

from tests.llm.test_operators import brute_components, words
from veilframe.llm import jaccard


def brute_links(texts, n, num, den):
    sets = {}
    for i, text in texts.items():
        own = words(text)
        sets[i] = frozenset(tuple(own[k : k + n]) for k in range(len(own) - n + 1)) or frozenset([tuple(own)] if own else [])
    kinds = set(sets.values()) - {frozenset()}
    linked = lambda a, b: a != b and den * len(a & b) >= num * len(a | b)
    count = {a: sum(linked(a, b) for b in kinds) for a in kinds}
    return {i: count.get(own, 0) for i, own in sets.items()}


def test_links_of_groups_are_counted(spark, monkeypatch):
    rng = random.Random(8)
    docs = {}
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(150)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(150)] = f"n{rng.getrandbits(30)}"
            docs[len(docs)] = " ".join(own)
    docs[len(docs)] = docs[3].upper()
    docs[len(docs)] = ""
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want, classes = brute_links(docs, 3, 90, 100), brute_components(docs, 3, 90, 100)
    assert max(want.values()) > 10
    for size in (jaccard.CLUSTER_SETS, 1):  # one cluster at a time, key by key
        monkeypatch.setattr(jaccard, "CLUSTER_SETS", size)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 8 if size == 1 else 1024)
        got = jaccard.near_duplicates(frame, n=3, num=90, den=100).collect()
        assert {r.doc_id: r.n_links for r in got} == want
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes
