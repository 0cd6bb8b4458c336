"""Rows without a doc_id and different texts under one doc_id in the stages of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import langid, pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    alone, near, one, two, shared, item = text(70), text(90), text(80), text(80), text(60), text(20)
    more, front, bad = text(40), text(75), item + " " + text(10)
    texts = [
        (None, alone), (None, near + " end"), (1, near), (2, one), (2, two), (2, one), (3, shared + " " + more),
        (4, front + " " + shared), (4, text(150)), (5, bad), (5, text(30)), (None, bad),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    pairs = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path))
    gone = [texts[1], texts[5], texts[11]]
    want = list(texts)
    for row in gone:
        want.remove(row)
    assert pairs(kept) == sorted(want, key=str) and kept.columns == docs.columns

    cut = corpus_pipeline.substring_dedup(spark, kept, str(tmp_path))
    want[want.index(texts[7])] = (4, front + " ")
    assert pairs(cut) == sorted(want, key=str) and cut.columns == docs.columns

    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert pairs(clean) == sorted([r for r in texts if r[1] != bad], key=str) and clean.columns == docs.columns


def test_a_table_without_labels_keeps_texts_with_letters(spark, tmp_path):
    texts = [(1, "some words", None), (2, "42 !", None), (3, None, None), (4, "", None), (None, "ж", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in texts], SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}


def test_the_language_sample_keeps_its_bound(spark):
    rows = [(7, f"mot {i}", "fr") for i in range(400)] + [(8, "same text", "en")] * 400 + [(i, f"word {i}", "en") for i in range(9, 40)]
    rows += [(1, None, "fr"), (2, "x", None), (None, "y", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for (i,) in frame.select("doc_id").where(langid.held_out(F.col("doc_id"), 5, 0)).distinct().collect()}
    got = langid.sample(frame).collect()
    counts = {lang: [r.n for r in got if r.lang == lang] for lang in ("en", "fr")}
    for lang, numbers in counts.items():
        known = len({(i, t) for i, t, x in rows if x == lang and i is not None and t is not None and i not in held})
        assert sorted(numbers) == list(range(1, min(known, langid.SAMPLE_PER_LANGUAGE) + 1))
    assert all(r.doc_id not in held and r.text is not None for r in got)


def test_deep_pages_do_not_recurse():
    page = "<html><body>" + "<div>" * 3000 + "<p>some running text of the article</p>" + "</div>" * 3000 + "</body></html>"
    assert pages.extract(page, "html>body>section") == "some running text of the article"
    assert pages.extract(page, "html>body>div") == "some running text of the article"


RUNNING = "some running text of the article that is long enough"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><article><p>{RUNNING}</p></article><div class="sidebar"><p>links</p></div></div>', RUNNING),
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{RUNNING}</p></article>', f"Title\n{RUNNING}"),
        (f'<div id="story-with-related"><h1>T</h1><p>{RUNNING}</p><div class="related"><p>more</p></div></div>', f"T\n{RUNNING}"),
        (f'<div class="post has-comments"><h1>T</h1><p>{RUNNING}</p><div class="comments"><p>{RUNNING * 5}</p></div></div>', f"T\n{RUNNING}"),
        # these stay condemned
        (f'<div class="header"><h1>Site</h1></div><article><p>{RUNNING}</p></article>', RUNNING),
        (f'<article><p>{RUNNING}</p></article><div class="comments"><article class="comment"><p>{RUNNING * 5}</p></article></div>', RUNNING),
        (f'<article><header><h1>Title</h1></header><p>{RUNNING}</p></article><div class="sidebar"><p>{RUNNING * 5}</p></div>', RUNNING),
    ],
)
def test_class_words_yield_to_the_article(page, text):
    assert pages.extract(f"<html><body>{page}</body></html>", None) == text
