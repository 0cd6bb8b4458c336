"""keygen, generate, run and verify, from files to files."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from tests.core.test_sources import POLICY, docs_of
from veilframe.__main__ import main
from veilframe.operators import metrics, spans


@pytest.fixture
def made(spark, tmp_path, capsys):
    docs_of(spark, 8).write.parquet(str(tmp_path / "documents"))
    (tmp_path / "policy.yaml").write_text(yaml.safe_dump(POLICY))
    call = lambda command, **options: main([command, *(x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", str(tmp_path / v) if k != "contract" else v))], spark)
    assert call("keygen", keys="keys") == 0 and call("generate", documents="documents", out="corpus") == 0
    assert not any(json.loads(capsys.readouterr().out.strip().splitlines()[-1]).values())
    return tmp_path, call


def test_from_documents_to_a_verified_run_and_a_found_change(spark, made, capsys):
    folder, call = made
    own = {"corpus": "corpus", "keys": "keys", "policy": "policy.yaml", "out": "out", "receipt": "receipt.json"}
    assert call("run", **own) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["documents"] == 8 and told["refused_scopes"] == 0
    check = {"out": "out", "policy": "policy.yaml", "public_key": "keys/signing_key.pub", "receipt": "receipt.json"}
    assert call("verify", **check) == 0
    table = spark.read.parquet(str(folder / "out/docs")).withColumn("text", F.when(F.col("doc_id") == "3", F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    table.write.parquet(str(folder / "changed/docs"))
    spark.read.parquet(str(folder / "out/receipts")).write.parquet(str(folder / "changed/receipts"))
    assert call("verify", **(check | {"out": "changed"})) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"fault": None, "scopes": {"output": 1}}
    assert call("keygen", keys="other") == 0
    assert call("verify", **(check | {"public_key": "other/signing_key.pub"})) == 1


def test_predictions_that_cannot_be_used_refuse_their_scope(spark, made, capsys):
    folder, call = made
    rows = [json.loads(r.value) for r in spark.read.text(str(folder / "corpus")).collect()]
    answers = [
        {"sample_id": r["sample_id"], "raw_output": json.dumps({"mentions": [{"span": [m["start"], m["end"]], "type": m["type"], "id": m["entity_id"]} for m in r["mentions"]]})}
        for r in rows if r["sample_id"] != "5"
    ]
    next(a for a in answers if a["sample_id"] == "0")["raw_output"] += "."
    (folder / "answers").write_text("\n".join(map(json.dumps, answers)) + "\n")
    assert call("run", corpus="corpus", keys="keys", policy="policy.yaml", out="out", receipt="receipt.json", predictions="answers", contract="spans") == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["documents"] == 4
    refused = {(r.scope_id, r.doc_id, r.reason) for r in spark.read.parquet(str(folder / "out/refused")).collect()}
    assert refused == {("b0", "0", "not_json"), ("b2", "5", "no_prediction")}


def test_phrases_are_found_as_whole_words(spark):
    needles = spark.createDataFrame([(1, "Grand Forks"), (1, "forks"), (1, "..."), (2, "Grand Forks"), (1, None), (1, "a a")], "scope_id int, phrase string")
    docs = spark.createDataFrame([(1, 1, "GRAND  forks, Grand-Forks grandforks Forksville"), (1, 2, "a a a"), (2, 3, "forks"), (1, 4, None), (1, 5, "grand")], "scope_id int, doc_id int, text string")
    got = {(r.doc_id, r.phrase, r.n) for r in spans.phrase_hits(needles, docs).collect()}
    assert got == {(1, "Grand Forks", 2), (1, "forks", 2), (2, "a a", 2)}


def test_running_sums_and_batches(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 97).alias("size"))
    got = {r.id: r.total for r in metrics.running(rows, ["size", "id"], F.col("size"), "total").collect()}
    total, want = 0, {}
    for r in sorted(rows.collect(), key=lambda r: (r.size, r.id)):
        total += r.size
        want[r.id] = total
    assert got == want
    batches = metrics.length_batches(rows.withColumn("size", F.when(F.col("id") != 9, F.col("size"))), "size", "id", 64).collect()
    assert sorted(r.batch for r in batches) == [k // 64 for k in range(500)] and next(r.batch for r in batches if r.id == 9) == 0
    assert metrics.length_batches(rows.limit(0), "size", "id", 64).collect() == []
