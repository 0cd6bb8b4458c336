"""Phrases meet texts where the texts are."""

import re

from pyspark.sql import functions as F

from veilframe.operators import spans


def test_texts_are_not_dealt_by_their_scope(spark):
    """A scope may hold most of the texts, so none is one task's."""
    docs = spark.range(1 << 20).select(F.lit("en").alias("scope_id"), F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"))
    needles = docs.where("doc_id < 4").select("scope_id", F.col("text").alias("phrase")).union(docs.limit(1).select("scope_id", F.lit("A  b!")))
    hits = spans.phrase_hits(needles, docs)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\(scope_id#\d+, \d+\)", plan)
    few = spans.phrase_hits(needles, docs.where("doc_id < 6"))
    got = {(r.doc_id, r.phrase, r.n) for r in few.collect()}
    assert got == {(k, "A  b!", 1) for k in range(6)} | {(k, f"a b {k}", 1) for k in range(4)}
