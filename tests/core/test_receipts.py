"""Receipts of scopes: every way of tampering is detected."""

import copy
import stat

import pytest
from pyspark.sql import functions as F

from veilframe.operators import hashtree, receipts

POLICY = {"min_weeks": 4, "policy_id": "p"}
FORM = "scope_id string, doc_id long, text string, mentions array<struct<start: long, end: long, type: string, entity_id: string>>"


@pytest.fixture(scope="module")
def signed(spark):
    docs = spark.createDataFrame([(f"s{i % 40}", i, f"text {i}", [(0, 4, "AGE", "E1")]) for i in range(90)], FORM).cache()
    report = docs.groupBy("scope_id").agg(F.count("*").alias("n_docs"), F.lit(True).alias("ok"))
    signer = receipts.Signer(spark)
    proved, run = receipts.sign_scopes(receipts.scope_receipts(docs, docs, report, POLICY), signer, POLICY, b"0123456789abcdef")
    return docs, proved.cache(), run, signer


def test_an_intact_run_has_no_fault(spark, signed):
    docs, proved, run, signer = signed
    fault, scopes = receipts.verify_scopes(spark, proved, run, docs, POLICY, signer.public_hex)
    assert fault is None and scopes.collect() == [] and run["payload"]["scopes"] == 40 and run["payload"]["levels"] == 1


def test_tampering_with_documents_is_found_in_its_scope(spark, signed):
    docs, proved, run, signer = signed
    last = F.col("doc_id") == 7
    moved = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("end"), F.lit("AGE").alias("type"), F.lit("E1").alias("entity_id")))
    cases = {
        "text": docs.withColumn("text", F.when(last, "x").otherwise(F.col("text"))), "null text": docs.withColumn("text", F.when(~last, F.col("text"))),
        "mention": docs.withColumn("mentions", F.when(last, moved).otherwise(F.col("mentions"))), "lost": docs.where(~last),
        "added": docs.union(spark.createDataFrame([("s7", 900, "", [])], FORM)),
    }
    for changed in cases.values():
        fault, scopes = receipts.verify_scopes(spark, proved, run, changed, POLICY, signer.public_hex)
        assert fault is None and [tuple(r) for r in scopes.collect()] == [("s7", "output")]
    other = docs.where("scope_id <> 's7'").union(spark.createDataFrame([("new", 900, "", [])], FORM))
    _, scopes = receipts.verify_scopes(spark, proved, run, other, POLICY, signer.public_hex)
    assert {tuple(r) for r in scopes.collect()} == {("s7", "no_output"), ("new", "no_receipt")}


def test_tampering_with_receipts_is_found(spark, signed):
    docs, proved, run, signer = signed
    verify = lambda table, run=run, policy=POLICY, key=signer.public_hex: receipts.verify_scopes(spark, table, run, docs, policy, key)
    own = F.col("scope_id") == "s7"
    swap = lambda column, value: proved.withColumn(column, F.when(own, value).otherwise(F.col(column)))
    fault, scopes = verify(swap("payload", F.replace("payload", F.lit('"ok":true'), F.lit('"ok":false'))))
    assert fault is None and [tuple(r) for r in scopes.collect()] == [("s7", "payload")]
    forged = swap("payload", F.replace("payload", F.lit('"ok":true'), F.lit('"ok":false'))).withColumn("hash", F.sha2("payload", 256))
    fault, scopes = verify(forged)
    assert fault == "root" and [tuple(r) for r in scopes.collect()] == [("s7", "proof")]
    fault, scopes = verify(proved.where(~own))
    assert fault == "scopes" and [tuple(r) for r in scopes.collect()] == [("s7", "no_receipt")]
    assert verify(proved, policy={"min_weeks": 5, "policy_id": "p"})[0] == "policy"
    assert verify(proved, key=receipts.Signer(spark).public_hex)[0] == "signature"
    for path, value in ((("payload", "root"), "0" * 64), (("payload", "scopes"), 41), (("signature",), "00" * 64), (("signature",), "xyz"), (("key_id",), "0" * 16)):
        broken = copy.deepcopy(run)
        at = broken
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        assert verify(proved, run=broken)[0] == "signature"
    assert verify(proved, run={"payload": run["payload"]})[0] == "signature"


def test_keys_and_secrets_are_stored(spark, tmp_path):
    signer = receipts.Signer(spark)
    private, public, secret = str(tmp_path / "k.pem"), str(tmp_path / "k.pub"), str(tmp_path / "secret")
    signer.save(private, public)
    again = receipts.Signer.load(spark, private, public)
    assert again.key_id == signer.key_id and signer.verify(again.sign({"a": 1})) and not receipts.Signer(spark).verify(again.sign({"a": 1}))
    receipts.save_secret(b"x" * 32, secret)
    assert receipts.load_secret(secret) == b"x" * 32 and len(receipts.secret_id(b"x" * 32)) == 16
    assert all(stat.S_IMODE((tmp_path / n).stat().st_mode) == 0o600 for n in ("k.pem", "secret"))
    with pytest.raises(FileExistsError):
        receipts.save_secret(b"y" * 32, secret)
    (tmp_path / "short").write_text("00ff\n")
    with pytest.raises(ValueError):
        receipts.load_secret(str(tmp_path / "short"))


@pytest.mark.parametrize(("n", "levels"), [(0, 0), (1, 0), (3, 2), (60, 1)])
def test_proofs_of_all_leaves_hold_and_of_others_do_not(spark, n, levels):
    leaves = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    top = hashtree.root(leaves, levels).first()
    assert top.n_leaves == n and len(top.root) == 64
    proofs = hashtree.proofs(leaves, levels)
    ok = lambda key, h: hashtree.proven(key, h, F.col("proof"), F.lit(top.root))
    held = proofs.select(ok(F.col("key"), F.col("hash")).alias("a"), ok(F.lit("zz"), F.col("hash")).alias("b"), ok(F.col("key"), F.sha2("key", 256)).alias("c")).collect()
    assert len(held) == n and all((r.a, r.b, r.c) == (True, False, False) for r in held)
    assert hashtree.levels_for(16) == 0 and hashtree.levels_for(17) == 1 and hashtree.levels_for(257) == 2
