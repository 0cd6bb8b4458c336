"""Files, policies, streams, and the source of labelled documents."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions import keyed, vocabulary
from veilframe.functions import text as T
from veilframe.operators import surrogates
from veilframe.sources import files, synthetic
from veilframe.streaming.deid import deidentify_stream

POLICY = {
    "policy_id": "p-1", "version": 2, "min_weeks": 4, "max_weeks": 52, "direction": "backward", "age": "cap", "age_cap": 90, "age_label": "90 or more", "unresolved_month": "drop",
}


def docs_of(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("own text\n\nof "), "id")).alias("text"))


def test_json_lines_round_trip_and_a_broken_line_fails(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "täxt\n", [(0, 2, "tä", "AGE", "E1")]), ("b", "x", None, None)], files.DOCUMENT)
    files.write_jsonl(rows, str(tmp_path / "out"))
    again = files.read_jsonl(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(set(x) == {"sample_id", "bundle_id", "text", "mentions"} for x in lines)
    (tmp_path / "bad").write_text('{"sample_id":"a"}\n{"sample_id":\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad")).collect()


def test_keyed_rows_fail_where_a_key_repeats(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, n int")
    assert files.keyed(rows, "k").count() == 4 and files.keyed(rows, "k").columns == ["k", "n"]
    with pytest.raises(Exception, match="k repeats: a"):
        files.keyed(rows.union(rows.limit(1)), "k").collect()


def test_lines_and_words(spark, tmp_path):
    (tmp_path / "lines").write_text("# comment\n\n  one two \nthree|3\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "lines")).collect()] == ["one two", "three|3"]
    row = spark.createDataFrame([("It's Anne-Marie, 42 x",)], "t string").select(T.words_of(F.col("t")).alias("w")).first()
    assert row.w == ["it's", "anne-marie", "x"]


def test_policies_are_checked_and_used(spark, tmp_path):
    import yaml

    path = tmp_path / "policy.yaml"
    path.write_text(yaml.safe_dump(POLICY))
    policy, digest = files.read_policy(str(path))
    assert policy == surrogates.Policy(**POLICY) and len(digest) == 64
    for change in ({"min_weeks": 60}, {"min_weeks": True}, {"direction": "sideways"}, {"age_label": ""}, {"more": 1}, {"version": -1}, {"min_weeks": "4"}):
        path.write_text(yaml.safe_dump(POLICY | change))
        with pytest.raises(ValueError):
            files.read_policy(str(path))
    path.write_text(yaml.safe_dump({k: v for k, v in POLICY.items() if k != "age"}))
    with pytest.raises(ValueError):
        files.read_policy(str(path))
    keys = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    shifts = {d: [r[0] for r in keys.select(surrogates.Policy(direction=d, max_weeks=6).shift(F.col("k"))).collect()] for d in ("backward", "forward", "either")}
    assert set(shifts["backward"]) == {-28, -35, -42} and set(shifts["forward"]) == {28, 35, 42}
    assert set(shifts["either"]) == {-28, -35, -42, 28, 35, 42} and 100 < sum(x < 0 for x in shifts["either"]) < 200
    forms = spark.createDataFrame([("s", "k", "AGE", "E1", "aged 93"), ("s", "k", "AGE", "E1", "aged 45"), ("s", "k", "DATE", "D1", "one week after the March visit")], "scope_id string, key string, type string, who string, old string")
    new = lambda policy: {r.old: (r.new, r.note) for r in surrogates.form_table(forms, policy).collect()}
    assert new(policy) == {"aged 93": ("aged 90 or more", "capped"), "aged 45": ("aged 45", None), "one week after the March visit": ("one week after the visit", "dropped")}
    assert new(surrogates.Policy(age="keep", unresolved_month="keep"))["aged 93"] == ("aged 93", None)


def test_a_key_of_any_length_gives_its_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 64, b"x" * 65, b"y" * 200):
        got = spark.range(1).select(keyed.hmac_hex(F.lit("message"), key)).first()[0]
        assert got == hmac.new(key, b"message", hashlib.sha256).hexdigest()


def test_weighted_draws_follow_their_weights(spark):
    drawn = spark.range(10_000).select(synthetic.weighted(synthetic.bits(F.col("id").cast("string")), (("a", 5), ("b", 3), ("c", 2))).alias("x"))
    counts = {r.x: r["count"] for r in drawn.groupBy("x").count().collect()}
    assert abs(counts["a"] - 5000) < 200 and abs(counts["b"] - 3000) < 200 and abs(counts["c"] - 2000) < 200
    exact = spark.range(10).select(synthetic.weighted(F.col("id"), (("a", 5), ("b", 3), ("c", 2))).alias("x"))
    assert "".join(r.x for r in exact.collect()) == "aaaaabbbcc"


def test_casts_have_no_collisions_and_extensions_respect_them(spark):
    bundles = spark.range(400).select(F.col("id").cast("string").alias("bundle_id"))
    cast = synthetic.casts(bundles).collect()
    assert len(cast) == 400
    for c in cast:
        words = [c[f"{p}_{i}"].lower() for p in ("first", "last") for i in (1, 2, 3)] + [c.city.lower()]
        assert len({w[:3] for w in words}) == 7 and len({c[f"first_{i}"][0] + c[f"last_{i}"][0] for i in (1, 2, 3)}) == 3
    assert sorted(map(str, synthetic.casts(bundles).collect())) == sorted(map(str, cast))
    frame = spark.createDataFrame(cast)
    members = frame.limit(5).select("bundle_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string"))).alias("member"))
    used = {(r.bundle_id, r.word) for r in synthetic.cast_words(frame).collect()}
    words = [(m.bundle_id, w) for m in synthetic.extended(frame, members).collect() for w in (m.first.lower(), m.last.lower(), (m.first[0] + m.last[0]).lower() + "|")]
    assert len(words) == len(set(words)) == 5 * 40 * 3 and not used & set(words)


def test_narratives_pass_their_gates_and_broken_ones_do_not(spark):
    docs = synthetic.narratives(docs_of(spark, 60)).cache()
    assert {r.gate: r.failures for r in synthetic.gates(docs).collect()} == dict.fromkeys(("offsets", "overlaps", "types", "dates", "hard_cases", "paragraphs"), 0)
    row = docs.where("doc_id = 4").first()
    assert row.text.endswith("own text\n\nof 4") and all(row.text[m.start : m.end] == m.text for m in row.mentions)
    broken = docs.withColumn("text", F.concat(F.lit("x"), "text")).withColumn("days", F.slice("days", 1, 3))
    broken = broken.withColumn("hard_kind", F.when(F.col("hard_kind") == "month", "initials").otherwise("month"))
    found = {r.gate: r.failures for r in synthetic.gates(broken).collect()}
    assert found["offsets"] > 700 and found["dates"] == 60 and found["hard_cases"] == 60 and found["types"] == 0
    assert synthetic.gates(docs.limit(0)).agg(F.sum("failures")).first()[0] == 0


def test_a_stream_is_deidentified_as_a_batch(spark, tmp_path):
    docs = synthetic.narratives(docs_of(spark, 6)).select("doc_id", "bundle_id", "text", "mentions")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = deidentify_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), b"a secret of tests")
    query.awaitTermination()
    got = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    scoped = docs.withColumn("scope_id", F.col("bundle_id"))
    marks = scoped.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*").drop("text")
    want = surrogates.deidentify(scoped.select("doc_id", "scope_id", "text"), marks, b"a secret of tests").collect()
    assert got == {r.doc_id: r.text for r in want} and len(got) == 6


def test_nothing_that_tells_a_cast_stands_in_its_texts(spark):
    """Texts full of the pools' words and of all numbers of three digits: the casts of their bundles are others."""
    every = " ".join([*vocabulary.KNOWN_FEMALE, *vocabulary.REGIONS, "Falls Dosesa Nomere", *map(str, range(100, 1000))])
    docs = synthetic.narratives(spark.createDataFrame([(0, every), (1, None), (3668, "a"), (3669, "in 473 ways")], "doc_id long, text string"))
    assert docs.where(F.size("mentions") == 14).count() == 4
    assert {r.gate: r.failures for r in synthetic.gates(docs).collect() if r.failures} == {}
    scoped = docs.withColumn("scope_id", F.col("bundle_id"))
    before = scoped.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", "m.end", "m.type", "m.entity_id")
    report = surrogates.run(scoped.select("doc_id", "scope_id", "text"), before, b"secret").report.collect()
    assert [(r.n_docs, r.n_residual, r.ok) for r in report] == [(2, 0, True)] * 2
