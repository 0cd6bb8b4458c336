"""Stages on rows with columns of clashing names, on empty tables and very long texts; pages whose class words mislead."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import pages

NAMES = ["_row", "_doc_id", "_id", "_digest", "_number", "_least", "_last", "rest", "node", "doc", "spans", "n.chars"]


def rows(sf_dir):
    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(30_000))
    return [
        (1, long, 5), (2, long + " end", 6), (2, long + " end", 6), (3, "x " + long, 7), (3, "another text of this id", 8), (None, "no id at all", 9),
        (None, None, None), (4, other, 1), (5, "", 0), (6, other + " tail", 2), (7, None, 3),
    ]


@pytest.mark.parametrize("stage", [corpus_pipeline.jaccard_join, corpus_pipeline.substring_dedup, corpus_pipeline.decontamination])
def test_columns_of_any_name_change_no_decision(spark, sf_dir, stage):
    docs = spark.createDataFrame(rows(sf_dir), "doc_id long, text string, n_chars long")
    clashing = docs.select("doc_id", *(F.concat(F.lit(f"{n}-"), F.coalesce("n_chars", F.lit(0))).alias(n) for n in NAMES), "text", "n_chars")
    plain, more = stage(spark, docs, sf_dir), stage(spark, clashing, sf_dir)
    assert more.columns == clashing.columns and plain.columns == docs.columns
    key = lambda r: (str(r.doc_id), str(r.text), str(r.n_chars))
    assert sorted(map(key, plain.collect())) == sorted(map(key, more.collect()))
    # a row keeps its own values
    assert all(r["_row"].removeprefix("_row-") == r["n.chars"].removeprefix("n.chars-") for r in more.collect())
    empty = stage(spark, clashing.limit(0), sf_dir)
    assert empty.collect() == [] and empty.columns == clashing.columns


def page_text(html):
    found = pages.votes(html)
    return pages.extract(html, found[0][0] if found else None)


WORDS = " ".join(["word"] * 80)


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div id="story-with-related">', '<div class="page-banner-layout">'])
def test_names_do_not_condemn_the_container_of_the_article(wrapper):
    text = page_text(f'<body>{wrapper}<p>{WORDS}</p><p>{WORDS} end</p><div class="sidebar"><p>aside</p></div></div><div class="footer">foot</div></body>')
    assert text == f"{WORDS}\n{WORDS} end"
    assert page_text(f"<body><div><p>{WORDS}</p></div><div class='comments'><p>{WORDS * 9}</p></div></body>") == WORDS


def test_labels_stay_in_their_paragraph():
    assert page_text(f"<body><p>He said <label>yes</label> now. {WORDS}</p></body>") == f"He said yes now. {WORDS}"


def test_deep_pages_take_little_memory():
    html = "".join('<div class="a"><section class="b">' for _ in range(20_000)) + f"<p>{WORDS}</p>"
    tracemalloc.start()
    text = page_text(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == WORDS and peak < 100e6
