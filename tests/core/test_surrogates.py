"""Surrogates of scopes whose own words stand in the pools."""

from pyspark.sql import functions as F

from veilframe.functions import vocabulary
from veilframe.operators import surrogates


def test_no_surrogate_is_a_word_of_its_scope(spark):
    docs, mentions = [], []
    for i in range(60):
        name, place = ("Hugo Falk", "TULSA") if i % 2 else ("Mira Holm", "Guelph")
        docs.append((i, f"s{i}", f"{name} of {place}"))
        mentions += [(i, 0, len(name), "PATIENT", "p"), (i, len(name) + 4, len(name) + 4 + len(place), "LOCATION", "l")]
    every = " ".join(vocabulary.CITIES)
    docs.append((60, "all", every))
    mentions.append((60, 0, len(every), "LOCATION", "l"))
    docs = spark.createDataFrame(docs, "doc_id long, scope_id string, text string")
    mentions = spark.createDataFrame(mentions, "doc_id long, start long, end long, type string, entity_id string")
    out = surrogates.deidentify(docs, mentions, b"secret")
    before = mentions.join(docs, "doc_id").select("scope_id", F.expr("substring(text, int(start) + 1, int(end - start))").alias("text"), "type")
    lower = lambda frame: frame.withColumn("text", F.lower("text"))
    assert out.count() == 61 and out.where("text is null or text = ''").count() == 0
    assert surrogates.residual_hits(lower(before), lower(out)).count() == 0


def test_the_residual_scan_finds_planted_survivors(spark):
    """Other case, words of two letters, words of a phrase, digit runs; ages, other scopes and null texts do not count."""
    before = [
        (1, "Otto Berg", "PATIENT"), (1, "Li Wu", "PATIENT"), (1, "ID 4711-22", "ID"), (1, "44", "AGE"), (1, None, "SITE"), (2, "Gotha", "SITE"),
    ]
    after = [
        (1, 1, "we met otto berg and Li Wu again"), (1, 2, "code 4711x"), (1, 3, "gotha 44"), (2, 4, "in GOTHA"), (1, 5, None), (1, 6, ""),
    ]
    before = spark.createDataFrame(before, "scope_id long, text string, type string")
    after = spark.createDataFrame(after, "scope_id long, doc_id long, text string")
    got = {tuple(r) for r in surrogates.residual_hits(before, after).collect()}
    assert got == {(1, 1, "otto"), (1, 1, "berg"), (1, 1, "li"), (1, 1, "wu"), (1, 2, "4711"), (2, 4, "gotha")}
    assert surrogates.residual_hits(before.limit(0), after).count() == 0
    # without exempt words every word of an original counts
    mine = spark.createDataFrame([(1, "General Hospital of Gotha", "SITE")], before.schema)
    there = spark.createDataFrame([(1, 1, "the hospital, of course")], after.schema)
    assert surrogates.residual_hits(mine, there).count() == 0
    assert {r.word for r in surrogates.residual_hits(mine, there, exempt=()).collect()} == {"hospital", "of"}


def test_the_residual_scan_makes_no_row_of_each_word(spark, monkeypatch):
    """Small scopes find in their rows what the equi-join finds; a scope may be of either kind, and both give all hits."""
    names = [f"w{k % 7}x{k}" for k in range(40)]
    before = [(k % 3, names[k], "SITE") for k in range(40)] + [(3, "li 123", "ID")]
    after = [(s, 10 * s + d, " ".join(names[d :: s + 2]) + " W1X1y li, code 1234 and 123") for s in range(5) for d in range(4)]
    before = spark.createDataFrame(before, "scope_id long, text string, type string")
    after = spark.createDataFrame(after + after[:2], "scope_id long, doc_id long, text string")
    every, plans = [], []
    for size in (0, 5, 256):
        monkeypatch.setattr(surrogates, "IN_ROW", size)
        hits = surrogates.residual_hits(before, after)
        plans.append(hits._jdf.queryExecution().executedPlan().toString())
        every.append(sorted(map(tuple, hits.collect())))
    assert every[0] == every[1] == every[2] and len(every[0]) == len(set(every[0])) > 40
    assert {r for r in every[0] if r[0] == 3} == {(3, 30 + d, w) for d in range(4) for w in ("li", "123")}
    assert "array_intersect" not in plans[0] and "array_intersect" in plans[2]
