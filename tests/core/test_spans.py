"""Texts that are cut within their row, and phrases that meet as a whole."""

from pyspark.sql import functions as F

from veilframe.operators import shared, spans


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_within_their_row(spark):
    rows = [(1, "Ann  met 🙂 Bob at b@c.d in 1234567 x"), (2, ""), (3, None), (4, "none"), (5, " Ém Eva")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flat = spans.mentions(docs)
    lists = docs.select("doc_id", F.explode(spans.listed("text")).alias("m")).select("doc_id", "m.*")
    assert "Exchange" not in plan(flat) and "Exchange" not in plan(lists) and "Exchange" not in plan(spans.replaced(docs))
    got = {(r.doc_id, r.start, r.end, r.text, r.type) for r in lists.collect()}
    assert got == {(r.doc_id, r.start, r.end, r.text, r.type) for r in flat.collect()}
    assert {(d, dict(rows)[d][s:e]) for d, s, e, _, _ in got} == {(d, t) for d, _, _, t, _ in got} and len(got) == 5
    new = {r.doc_id: (r.new_text, r.n_replaced) for r in spans.replaced(docs).collect()}
    assert new[2] == ("", 0) and new[4] == ("none", 0) and 3 not in new and new[1][1] == 4 and new[1][0].endswith(" x")


def test_phrases_meet_as_a_whole(spark):
    """Places of a frequent first word meet one row of it, and phrases by all their words."""
    needles = spark.createDataFrame([("s", f"the w{i}") for i in range(50)] + [("s", "The"), ("s", "the, w1"), ("t", "the")], "scope_id string, phrase string")
    docs = spark.createDataFrame([("s", 1, "the w1 the w2 the w1. The"), ("s", 2, "w1 the"), ("u", 3, "the")], "scope_id string, doc_id long, text string")
    hits = spans.phrase_hits(needles, docs)
    assert {(r.doc_id, r.phrase, r.n) for r in hits.collect()} == {(1, "the w1", 2), (1, "the, w1", 2), (1, "the w2", 1), (1, "The", 4), (2, "The", 1)}
    joins = [line for line in plan(hits).splitlines() if "Join" in line]
    assert joins and not any("slice" in line for line in joins) and any("run#" in line for line in joins)


def test_batches_are_small_for_a_while_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with shared.small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
