"""The training-data operators against brute force, exact round trips, held-out accuracy and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import chains, dac, hmm, jaccard, langid, packing, pages, png, token_counts
from veilframe.llm.decontam import benchmark_hits
from veilframe.llm.queries import queries
from veilframe.llm.tokens import WORD_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, key string, id long, h long, n int, u long, rep long, counts string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""
    texts = [
        None, "", " \n\t", "42 !!", "A", "same words here and there", "same words here and there", "Ünïcode ẞ 漢字 <|endoftext|> 's 're",
        " ".join(f"w{i % 977}" for i in range(30_000)), "x" * 70_000, "a b c\x00d",
    ]
    rows = [(i, t, "en" if i % 2 else None, "k", 1, 2, 3, 4, 5, "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all", "de", None, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# language ID


def test_language_of_held_out_documents(documents):
    got = langid.identify(documents).toPandas().merge(documents.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.95
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.score.between(0, 1).all()


def test_language_edge_cases(odd, empty):
    got = langid.identify(odd).toPandas()
    assert len(got) == odd.count()
    assert set(got[got.doc_id.isin([0, 1, 2, 3])].lang_pred) == {"und"}
    assert langid.identify(empty).count() == 0
    kept = langid.with_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, None}


def test_kernel_is_the_presence_kernel():
    texts = ["the cat sat", "der hund lief", "the dog ran", "die katze sass"]
    model = langid.fit(texts, ["en", "de", "en", "de"], [0, 1, 2, 3])
    got = model.scores(texts)
    marks = langid.presence(texts)
    scaled = marks / np.sqrt(marks.sum(1))[:, None]
    kernel = (scaled @ scaled.T).astype(float)
    # with all texts as landmarks the feature space is exact: ridge regression in the kernel's own form
    weights = np.linalg.solve(kernel + langid.RIDGE * 4 * np.eye(4), np.where(np.arange(4) % 2 == 0, -1.0, 1.0))
    assert np.allclose(got[:, model.languages.index("de")], kernel @ weights, atol=1e-3)


# tokens


def test_token_counts_match_the_library(documents, odd, library):
    for docs in (documents, odd):
        got = token_counts.token_counts(docs, WORD_BPE).collect()
        texts = docs.select("doc_id", "text").collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in texts]
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_prefix_counts(library):
    prefix = token_counts.prefix_counts(WORD_BPE)
    for chunk in ("unbelievable,don't", "they're12ab", "Straßenbahn's", "<|endoftext|>x", "日本語"):
        got = prefix.chunk(chunk.encode())
        assert got == [len(ids_of(library, chunk[:i])) for i in range(len(chunk) + 1)]


def test_budget_cut(library):
    text = "some words, don't you know that it's unbelievable " * 9
    ends = np.cumsum(token_counts.chunk_counts(encoder(WORD_BPE), text.encode()), dtype=np.int64)
    for budget in (1, 7, 31, 50):
        cut = token_counts.budget_cut(WORD_BPE, text.encode(), ends, budget)
        assert len(ids_of(library, text[:cut])) <= budget
        assert all(len(ids_of(library, text[:n])) > budget for n in range(cut + 1, cut + 12))


def test_token_files(documents, odd, empty, library):
    for docs in (documents, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        got = dac.token_files(docs, WORD_BPE).orderBy("doc_id").toPandas()
        at = 0
        rows = sorted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], key=lambda r: r[0])
        for (doc_id, text), row in zip(rows, got.itertuples(), strict=True):
            ids = ids_of(library, text) + [1]
            assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc(ids))
            at += len(ids)
    assert dac.token_files(empty, WORD_BPE).count() == 0
    assert dac.token_files(odd, WORD_BPE).count() == odd.count()


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.array([], np.uint32), rng.integers(0, 2**32, 3000, np.uint32), rng.integers(0, 300, 5000, np.uint32)):
        codes = dac.Codes(dac.encode(ids))
        assert (codes.all() == ids).all() and len(codes) == len(ids)
        assert all(codes[int(i)] == ids[i] for i in rng.integers(0, max(1, len(ids)), 200) if len(ids))


# packing


def check_packing(got, docs, library, capacity=2048):
    by_doc = {}
    for r in got.itertuples():
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = ids_of(library, text) + [0]
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.start == r.piece * capacity and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
            assert r.length == capacity or r.piece == len(own) - 1
    assert not by_doc
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= capacity


def test_packing(documents, odd, empty, library):
    got = packing.pack(documents, WORD_BPE).toPandas()
    check_packing(got, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], library)
    assert got.sequence_id.nunique() <= 1.03 * math.ceil(got.length.sum() / 2048) + 1
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(some, WORD_BPE).toPandas(), [(r.doc_id, r.text) for r in some.collect()], library)
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_packing_plan_on_random_lengths():
    rng = random.Random(3)
    for capacity in (7, 30, 100):
        for _ in range(30):
            counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(12)}
            runs = packing.plan(counts, capacity)
            placed = {}
            for length, count in counts.items():
                s, o = packing.lookup(runs, np.full(count, length), np.arange(count))
                for a, b in zip(s, o, strict=True):
                    placed.setdefault(int(a), []).append((int(b), length))
            for own in placed.values():
                own.sort()
                ends = list(itertools.accumulate(n for _, n in own))
                assert [b for b, _ in own] == [0, *ends[:-1]] and ends[-1] <= capacity
            best = math.ceil(sum(n * c for n, c in counts.items()) / capacity)
            assert len(placed) <= 1.25 * best + 2


# passages


def planted(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared, short, fuzzy = text(70), text(40), text(120).split()
    changed = list(fuzzy)
    changed[30], changed[75] = "other", "else"
    del changed[50]
    docs = {i: text(150 + i) for i in range(12)}
    docs[2] += " " + shared + " " + text(20)
    docs[5] = shared.upper() + "\n" + docs[5]
    docs[7] += "\t" + shared
    docs[3] += " " + short
    docs[6] += " " + short
    docs[8] += " " + " ".join(fuzzy)
    docs[9] = " ".join(changed) + " " + docs[9]
    docs[11] = docs[10]
    return docs


def test_planted_passages(spark):
    docs = planted()
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, start int")
    got = {(r.doc_id, r.source_id): r for r in chains.passages(frame).collect()}
    assert set(got) == {(5, 2), (7, 2), (9, 8), (11, 10)}
    assert (got[5, 2].start, got[5, 2].n_words, got[5, 2].source_start) == (0, 70, 152)
    assert got[9, 8].start == 0 and got[9, 8].n_words == 119 and got[9, 8].matching == 117
    assert got[11, 10].n_words == 160
    cut = {r.doc_id: r.text for r in chains.cut_out(frame, chains.passages(frame)).collect()}
    assert 11 not in cut and words(cut[5]) == words(planted()[5])[70:] and cut[3] == docs[3] and cut[2] == docs[2]
    assert words(cut[7]) == words(docs[7])[:-70]


def test_passages_of_the_table_against_exact_repeats(documents):
    """Every run of 50 words that two documents share lies in a passage of all but its first document."""
    got = chains.passages(documents).toPandas()
    texts = {r.doc_id: words(r.text) for r in documents.collect()}
    covered = {}
    for r in got.itertuples():
        assert r.source_id < r.doc_id and min(r.n_words, r.source_words) >= 50 and r.matching >= 0.8 * r.n_words
        covered.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    first, missed, total = {}, 0, 0
    for doc_id in sorted(texts):
        own = texts[doc_id]
        for i in range(len(own) - 49):
            run = tuple(own[i : i + 50])
            if first.setdefault(run, doc_id) != doc_id:
                total += 1
                missed += not any(a <= i and i + 50 <= b for a, b in covered.get(doc_id, ()))
    assert total > 1000 and missed == 0


def test_chaining_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        anchors = sorted({(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(rng.randint(1, 14))})
        pos, rpos = [a for a, _ in anchors], [b for _, b in anchors]
        best = [1.0] * len(anchors)
        for i, (p, r) in enumerate(anchors):
            for j in range(i):
                if pos[j] < p and rpos[j] < r:
                    best[i] = max(best[i], 1 + best[j] - (p - pos[j] + r - rpos[j]) / chains.GAP)
        got = chains.chain(pos, rpos)
        top = got[0]
        value = len(top) - sum((pos[b] - pos[a] + rpos[b] - rpos[a]) / chains.GAP for a, b in zip(top, top[1:]))
        assert math.isclose(value, max(best))
        assert sorted(i for c in got for i in c) == list(range(len(anchors)))


def test_passages_edge_cases(odd, empty):
    assert chains.passages(odd).count() == 0
    assert chains.passages(empty).count() == 0
    cut = chains.cut_out(odd, chains.passages(odd))
    assert cut.columns == odd.columns and cut.count() == odd.count()


# hidden Markov model


def test_scores(documents):
    got = hmm.score(documents).toPandas().set_index("doc_id")
    texts = {r.doc_id: [*words(r.text), ""] for r in documents.collect()}
    counts = {}
    for i, own in texts.items():
        assert got.held_out[i] == (zlib.crc32(str(i).encode()) % 7 == 2)
        if not got.held_out[i]:
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, own in texts.items():
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(w in counts for w in own), total)
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in own)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_forward_recursion_and_expectations_by_enumeration():
    rng = np.random.default_rng(2)
    states, seq = 3, np.array([1, 5, 1, 7], np.uint16)
    move, start = rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(states))
    emit = rng.dirichlet(np.ones(hmm.CLASSES), states)
    model = hmm.Model(start, move, emit)
    total, counts = 0.0, np.zeros((2 * states + 1, hmm.CLASSES))
    for path in itertools.product(range(states), repeat=len(seq)):
        p = start[path[0]] * emit[path[0], seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= move[a, b] * emit[b, c]
        total += p
        counts[0, path[0]] += p
        for a, b in zip(path, path[1:]):
            counts[1 + a, b] += p
        for s, c in zip(path, seq):
            counts[1 + states + s, c] += p
    short = np.array([2], np.uint16)
    assert np.allclose(model.log10_likelihoods([short, seq])[1], math.log10(total))
    got = np.zeros_like(counts)
    model.expect([seq], got)
    assert np.allclose(got, counts / total)


def plain_expectations(model, seq):
    """Baum-Welch counts of one uncut sequence, place by place."""
    states, n = len(model.start), len(seq)
    ahead, back = np.zeros((n, states)), np.ones((n, states))
    for t in range(n):
        now = (ahead[t - 1] @ model.move if t else model.start) * model.emit[:, seq[t]]
        ahead[t] = now / now.sum()
    for t in range(n - 2, -1, -1):
        now = model.move @ (model.emit[:, seq[t + 1]] * back[t + 1])
        back[t] = now / now.sum()
    counts = np.zeros((2 * states + 1, hmm.CLASSES))
    for t in range(n):
        own = ahead[t] * back[t] / (ahead[t] @ back[t])
        counts[1 + states :, seq[t]] += own
        if t:
            joint = ahead[t - 1][:, None] * model.move * (model.emit[:, seq[t]] * back[t])[None, :]
            counts[1 : 1 + states, :states] += joint / joint.sum()
        else:
            counts[0, :states] += own
    return counts


@pytest.mark.parametrize(("whole", "segment", "places"), [(1024, 256, 1 << 17), (5, 4, 64), (1, 1, 1), (40, 17, 300)])
def test_expectations_are_those_of_uncut_sequences(monkeypatch, whole, segment, places):
    monkeypatch.setattr(hmm, "WHOLE", whole)
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "PLACES", places)
    rng = np.random.default_rng(5)
    model = hmm.Model.first()
    model.emit[:, ::3] *= 1e-9  # classes that hardly any state emits
    sequences = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 2, 5, 6, 17, 18, 33, 300, 1024, 1025, 1500)]
    got = np.zeros((2 * hmm.STATES + 1, hmm.CLASSES))
    model.expect(sequences, got)
    assert np.allclose(got, sum(plain_expectations(model, s) for s in sequences), rtol=1e-8, atol=1e-10)
    nothing = np.zeros_like(got)
    model.expect([], nothing)
    assert not nothing.any()


def test_score_edge_cases(odd, empty):
    got = hmm.score(odd).toPandas()
    assert len(got) == odd.count() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert got[got.doc_id.isin([0, 1, 2])].n_tokens.eq(1).all()
    assert hmm.score(empty).count() == 0


# n-gram Jaccard join


def brute_components(texts, n, num, den):
    sets = {}
    for i, text in texts.items():
        own = words(text)
        sets[i] = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} or ({tuple(own)} if own else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    for a, b in {(a, b) for x in by_shingle.values() for a in x for b in x if a < b}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join(documents, n, num):
    got = jaccard.near_duplicates(documents, n=n, num=num, den=100).toPandas()
    want = brute_components({r.doc_id: r.text for r in documents.collect()}, n, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert any(i != c for i, (_, c) in want.items())


def test_jaccard_join_of_chained_copies(spark):
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = {}
    for i in range(60):  # each a step from the one before: linked in a chain, the ends far apart
        base = list(base)
        base[(i * 7) % 120] = f"n{i}"
        docs[i] = " ".join(base)
    for i in range(60, 90):
        docs[i] = " ".join(f"z{(i * k) % 31}" for k in range(rng.randint(1, 9)))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = jaccard.near_duplicates(frame, n=3, num=90, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 3, 90, 100)


def test_jaccard_edge_cases(odd, empty):
    got = jaccard.near_duplicates(odd, n=3, num=90, den=100).toPandas()
    assert len(got) == odd.count()
    assert got[got.doc_id.isin([0, 1, 2])].n_shingles.eq(0).all()
    assert set(got[got.doc_id.isin([5, 6])].component_id) == {5}
    assert jaccard.near_duplicates(empty).count() == 0


# media


def test_media(documents, odd, empty):
    for docs in (documents, odd):
        got = png.media_features(docs).toPandas()
        texts = docs.select("doc_id", "text").toPandas()
        want = []
        for i, t in texts.itertuples(index=False):
            raw = (t or "").encode()
            full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
        assert sorted(zip(map(str, got.doc_id), got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32)) == sorted(want)
        assert got.groupby("payload_sha256").feature.nunique().eq(1).all()
    assert png.media_features(empty).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (10, 6), np.uint8).astype(int)
    kinds, lines = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0]), np.zeros((10, 6), np.uint8)
    for r, k in enumerate(kinds):
        for i in range(6):
            left, up = (rows[r, i - 1] if i else 0), (rows[r - 1, i] if r else 0)
            corner = rows[r - 1, i - 1] if r and i else 0
            p = left + up - corner
            nearest = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            lines[r, i] = (rows[r, i] - [0, left, up, (left + up) // 2, nearest][k]) % 256
    assert (png.unfilter(kinds, lines) == rows).all()
    image = png.encode(bytes(range(64)) * 3)
    assert png.decode(image).tobytes() == bytes(range(64)) * 3
    for i in (3, 20, 45, len(image) - 5):
        damaged = bytearray(image)
        damaged[i] ^= 1
        with pytest.raises(ValueError):
            png.decode(bytes(damaged))


# decontamination


def test_decontamination(spark, documents, sf_dir, odd, empty):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = spark.createDataFrame([(9001, "A"), (9002, None), (9003, "!!"), (9004, "same WORDS, here")], benchmark.schema)
    items = benchmark.union(extra)
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for docs in (documents, odd):
        windows = {}
        for r in items.collect():
            own = cut.findall(lower(r.text or ""))
            for i in range(max(len(own) - 12, 1) if own else 0):
                windows.setdefault(tuple(own[i : i + 13]), set()).add(str(r.item_id))
        sizes = sorted({len(w) for w in windows})
        want = []
        for r in docs.select("doc_id", "text").collect():
            own, hit, found = cut.findall(lower(r.text or "")), set(), set()
            for i in range(len(own)):
                for k in sizes:
                    if (w := tuple(own[i : i + k])) in windows and len(w) == k:
                        hit.update(range(i, i + k))
                        found |= windows[w]
            digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            want.append((str(r.doc_id), len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
        got = benchmark_hits(docs, items).collect()
        rows = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
        assert sorted(rows) == sorted(want)
    assert benchmark_hits(empty, benchmark).count() == 0
    assert benchmark_hits(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_a_large_benchmark_is_joined_by_shuffles(spark, documents, sf_dir, monkeypatch):
    from veilframe.llm import decontam

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    few = decontam.benchmark_hits(documents, benchmark).drop("spans").toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    many = decontam.benchmark_hits(documents, benchmark).drop("spans").toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(few, many)


# pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="wrap"><div class="post-12"><h1>{0}  title</h1><p>First &lt;b&gt;
 <b>bold</b> {0} text, long enough to count as running text.<br>Next<p>Second&nbsp;para <a href="#">link</a></div>
<aside>Side text that is rather long, longer than anything.</aside><form>Name <input><button>Go</button></form>
<section id="comments"><p>A reader says something quite long here, a comment of some length.</p></section></div>
<footer>&copy; 2020</footer></body></html>"""
TEXT = "{0} title\nFirst <b> bold {0} text, long enough to count as running text. Next\nSecond para link"


def test_main_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(f"n{i}"), 1) for i in range(6)]
    rows += [(6, "https://a.example/6", None, 1), (7, None, "", 1), (8, "https://a.example:80/x", "plain words", 1)]
    rows += [(9, "http://b.example/", "<article><p>only &#65;rticle<section><p>more", 1), rows[0]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = pages.main_text(frame).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert [texts[i] for i in range(6)] == [TEXT.format(f"n{i}") for i in range(6)]
    assert texts[6] == texts[7] == "" and texts[9] == "only Article\nmore"
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.main_text(frame.limit(0)).count() == 0


def test_hosts_beyond_the_broadcast(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    few = {(r.page_id, r.text) for r in pages.main_text(table).collect()}
    monkeypatch.setattr(pages, "BROADCAST_HOSTS", 0)
    assert {(r.page_id, r.text) for r in pages.main_text(table).collect()} == few


def test_articles_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in pages.main_text(table).collect()}
    import html

    for r in table.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].split("\n") == [b for b in blocks if b]


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries() if n != "pipeline"]
    assert names == [f"op{n}" for n in range(1, 11)] and "pipeline" in queries()
