"""Reports, evaluations by both contracts, training rows, manifests, differences of runs."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.core.test_command_line import made  # noqa: F401
from veilframe.operators import reports
from veilframe.sources import corpus_plan, files

MENTIONS = "mentions array<struct<start: long, end: long, type: string, entity_id: string>>"


def test_tally_of_items_and_lists(spark):
    rows = spark.createDataFrame([("a", ["x", "y", None], 49), ("a", None, 50), (None, [], None)], "k string, tags array<string>, n int")
    sections = {"k": F.col("k"), "tags": F.col("tags"), "n": reports.binned(F.col("n"), 50)}
    got = {(r.section, r.item): r.n for r in reports.tally(rows, sections).collect()}
    assert got == {("k", "a"): 2, ("tags", "x"): 1, ("tags", "y"): 1, ("n", "0-49"): 1, ("n", "50-99"): 1}
    assert reports.tally(rows.limit(0), sections).collect() == []


def test_first_failures_of_each_gate(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("gate"), F.col("id"))
    got = sorted((r.gate, r.place, r.id) for r in reports.first_failures(rows, "gate", "id", shown=3).collect())
    assert got == [(0, 1, 0), (0, 2, 2), (0, 3, 4), (1, 1, 1), (1, 2, 3), (1, 3, 5)]


def _evaluated(spark, contract, answers):
    own = [(0, 3, "PATIENT", "E1"), (8, 11, "PATIENT", "E1"), (4, 7, "SITE", "E2")]
    docs = spark.createDataFrame([(i, "Ann Lab Ann Day", own, [None, "odd"] if i % 2 else None) for i in range(len(answers))] + [(99, None, None, None)], f"doc_id long, text string, {MENTIONS}, slices array<string>")
    rows = [(i, a, i != 1) for i, a in enumerate(answers) if a != "absent"]
    return reports.evaluate(docs, spark.createDataFrame(rows, "doc_id long, raw_output string, finished boolean"), contract)


def _output(*mentions):
    return json.dumps({"mentions": list(mentions)})


def test_evaluation_by_anchors(spark):
    a = lambda text, n, kind, own: {"text": text, "n": n, "type": kind, "id": own}
    right = [a("Ann", 1, "PATIENT", "P"), a("Ann", 2, "PATIENT", "P"), a("Lab", 1, "SITE", "S")]
    split = [a("Ann", 1, "PATIENT", "P"), a("Ann", 2, "PATIENT", "Q"), a("Lab", 1, "SITE", "Q")]
    done = _evaluated(spark, "anchors", [_output(*right), _output(*split, a("Ann", 3, "PATIENT", "P")), "{", "absent", None, _output()])
    verdicts = {(r.doc_id, r.entity_id): r.verdict for r in done.verdicts.collect()}
    assert verdicts[0, "E1"] == verdicts[0, "E2"] == "consistent" and (verdicts[1, "E1"], verdicts[1, "E2"]) == ("split", "merged")
    assert {v for (d, _), v in verdicts.items() if d > 1} == {"incomplete"}
    whole = {r.slice: r for r in done.scores().collect()}
    assert (whole["all"].tp, whole["all"].fp, whole["all"].fn) == (6, 1, 12) and (whole["odd"].tp, whole["odd"].fp, whole["odd"].fn) == (3, 1, 6)
    counts = {r.slice: r for r in done.counts().collect()}
    assert tuple(counts["all"])[1:] == (7, 4, 1, 7, 1) and counts["odd"].samples == 3
    assert [tuple(r) for r in done.reasons().collect()] == [("no_prediction", 2), ("no_output", 1), ("not_json", 1)]


def test_evaluation_by_spans_and_unknown_documents(spark):
    m = lambda s, e, kind, own: {"span": [s, e], "type": kind, "id": own}
    done = _evaluated(spark, "spans", [_output(m(0, 3, "PATIENT", "P"), m(8, 11, "SITE", "P")), _output(m(0, 99, "SITE", "S"))])
    by = {(r.slice, r.type): (r.tp, r.fp, r.fn) for r in done.scores("type").collect()}
    assert by["all", "PATIENT"] == (1, 0, 3) and by["all", "SITE"] == (0, 1, 2) and by["odd", "SITE"] == (0, 0, 1)
    docs = spark.createDataFrame([(1, "a", None, None)], f"doc_id long, text string, {MENTIONS}, slices array<string>")
    for stray in (2, None):
        with pytest.raises(ValueError, match="unknown document"):
            reports.evaluate(docs, spark.createDataFrame([(stray, "", True)], "doc_id long, raw_output string, finished boolean"), "spans")


def test_differences_and_digests_of_runs(spark):
    first = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "d")], "doc_id long, raw_output string")
    second = spark.createDataFrame([(5, None), (3, None), (2, None), (1, "a")], "doc_id long, raw_output string")
    assert {tuple(r) for r in reports.run_differences(first, second).collect()} == {(3, "changed"), (4, "lost"), (5, "added")}
    root = lambda rows: reports.run_digest(rows, 1).first()["root"]
    assert root(first) == root(first.orderBy(F.desc("doc_id"))) and root(first) != root(second)


def test_training_files_are_checked_as_a_whole(spark, tmp_path):
    row = {"sample_id": "a", "instruction_version": "v2", "instruction": "Mark", "input": "x", "output": "{}"}
    write = lambda name, *rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows)) and str(tmp_path / name)
    assert files.read_training(spark, write("good", row, row | {"sample_id": "b"}), "v2").count() == 2
    bad = write("bad", row, row, row | {"sample_id": "c", "instruction": "Other"}, row | {"instruction_version": "v1"}, {k: v for k, v in row.items() if k != "input"})
    with pytest.raises(ValueError, match="missing_key: 1 rows, a the first; other_instruction: 1 rows, c the first; other_version: 1 rows"):
        files.read_training(spark, bad, "v2")
    (tmp_path / "none").write_text("")
    with pytest.raises(ValueError, match="no rows"):
        files.read_training(spark, str(tmp_path / "none"), "v2")


def test_evaluate_and_report_from_files(spark, made, capsys):  # noqa: F811
    folder, call = made
    rows = [json.loads(r.value) for r in spark.read.text(str(folder / "corpus")).collect()]
    answers = [{"sample_id": r["sample_id"], "raw_output": json.dumps({"mentions": [{"span": [m["start"], m["end"]], "type": m["type"], "id": m["entity_id"]} for m in r["mentions"]]})} for r in rows]
    (folder / "answers").write_text("\n".join(map(json.dumps, answers)) + "\n")
    with pytest.raises(ValueError, match="names none"):
        call("evaluate", corpus="corpus", predictions="answers", out="none")
    (folder / "answers.manifest.json").write_text(json.dumps({"contract": "spans", "decoding": {}}))
    assert files.contract_of(spark, str(folder / "answers"), "anchors") == "anchors"
    assert call("evaluate", corpus="corpus", predictions="answers", out="evaluation") == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["contract"] == "spans" and told["f1"] == 1.0 and told["tp"] == sum(len(r["mentions"]) for r in rows)
    assert call("report", corpus="corpus", out="report") == 0
    lines = [r.value for r in spark.read.text(str(folder / "report")).collect()]
    assert lines[0] == "# Corpus" and "| samples | scopes | repeated_texts |" in lines and "| mention type | SITE | 16 |" in lines
    (folder / "answers.manifest.json").write_text(json.dumps({"contract": "v9"}))
    with pytest.raises(ValueError, match="unknown contract"):
        call("evaluate", corpus="corpus", predictions="answers", out="again")


@pytest.mark.parametrize("n", [0, 1, 7, 137])
def test_plans_keep_shares_pairs_and_rotations(spark, n):
    rows = sorted(corpus_plan.plan(spark.range(n), "id").collect(), key=lambda r: r.doc_index)
    assert [r.doc_index for r in rows] == list(range(n)) and sorted(r.id for r in rows) == list(range(n))
    by = Counter(r.slice for r in rows)
    assert by["bundle_narrative"] == by["bundle_listing"] and all(abs(by[s] - n * share / 100) < 2 for s, share in corpus_plan.SHARES if s != "bundle")
    for a, b in zip(rows, rows[1:]):
        if a.slice == "bundle_narrative":
            assert (b.slice, b.bundle_no, b.n_patients) == ("bundle_listing", a.bundle_no, a.n_patients)
    seen = Counter()
    for r in rows:
        assert r.template_hint == seen[r.slice, r.n_patients] and (r.listing_rows > 0) == r.slice.endswith("listing")
        seen[r.slice, r.n_patients] += 1
    wanted = corpus_plan.hard_counts(n)
    assert sum(wanted.values()) == round(n * 0.1)
    for s, most in wanted.items():
        assert sum(r.slice == s and r.hard_kind is not None for r in rows) == min(most, by[s])
