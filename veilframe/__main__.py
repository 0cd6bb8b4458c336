"""Command line: python -m veilframe keygen | generate | run | verify | evaluate | report.

run exits with 1 where a scope was refused, verify where a check failed; what was refused is among the results.
evaluate and report write Markdown.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import secrets
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import receipts, relocate, reports, surrogates
from veilframe.sources import files, synthetic

PRIVATE, PUBLIC, SECRET, RECEIPT = "signing_key.pem", "signing_key.pub", "surrogate_secret.hex", "run_receipt.json"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, scope_id, text and mentions of a JSON Lines corpus; the scope is the bundle, or the document itself."""
    rows = files.keyed(files.read_jsonl(spark, path), "sample_id")
    return rows.select(F.col("sample_id").alias("doc_id"), F.coalesce("bundle_id", "sample_id").alias("scope_id"), "text", "mentions")


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", "m.end", "m.type", "m.entity_id")


def keygen(spark: SparkSession, args) -> int:
    out = Path(args.keys)
    out.mkdir(parents=True, exist_ok=True)
    signer, secret = receipts.Signer(spark), secrets.token_bytes(32)
    signer.save(str(out / PRIVATE), str(out / PUBLIC))
    receipts.save_secret(secret, str(out / SECRET))
    print(f"signing key {signer.key_id}, secret {receipts.secret_id(secret)}")
    return 0


def generate(spark: SparkSession, args) -> int:
    """A labelled corpus in JSON Lines, a narrative for each document of a Parquet table; the gates' failures are printed."""
    docs = synthetic.narratives(spark.read.parquet(args.documents))
    found = {r["gate"]: r["failures"] for r in synthetic.gates(docs).collect()}
    files.write_jsonl(docs.select(F.col("doc_id").cast("string").alias("sample_id"), "bundle_id", "text", "mentions"), args.out)
    print(json.dumps(found))
    return int(any(found.values()))


def run(spark: SparkSession, args) -> int:
    keys, (policy, digest) = Path(args.keys), files.read_policy(args.policy)
    secret, signer = receipts.load_secret(str(keys / SECRET)), receipts.Signer.load(spark, str(keys / PRIVATE), str(keys / PUBLIC))
    docs = _documents(spark, args.corpus)
    mentions, lost = _exploded(docs), None
    if args.predictions:
        answers = files.keyed(files.read_jsonl(spark, args.predictions, files.PREDICTION), "sample_id").withColumnRenamed("sample_id", "doc_id")
        mentions, lost = relocate.from_predictions(docs, answers, files.contract_of(spark, args.predictions, args.contract, "anchors"))
        lost = lost.join(docs.select("doc_id", "scope_id"), "doc_id", "left").select("scope_id", "doc_id", F.col("problem").alias("reason"))
        docs = docs.join(lost.select("scope_id").where("scope_id is not null").distinct(), "scope_id", "left_anti")
    done = surrogates.run(docs.select("doc_id", "scope_id", "text"), mentions, secret, policy)
    if lost is not None:
        done = dataclasses.replace(done, refused=done.refused.unionByName(lost))
    surrogates.publish(done, args.out)
    # what follows reads what was given out
    given, report = (spark.read.parquet(f"{args.out}/{name}") for name in ("docs", "report"))
    lists = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "entity_id")).alias("mentions"))
    before = docs.drop("mentions").join(lists, "doc_id", "left").join(given.select("doc_id"), "doc_id", "left_semi")
    identity = {"id": policy.policy_id, "sha256": digest, "version": policy.version}
    scopes = receipts.scope_receipts(before, given, report.where("ok"), identity)
    proved, receipt = receipts.sign_scopes(scopes, signer, identity, secret)
    proved.write.parquet(f"{args.out}/receipts")
    Path(args.receipt).write_text(json.dumps(receipt, sort_keys=True) + "\n")
    refused = spark.read.parquet(f"{args.out}/refused").select("scope_id").distinct().count()
    print(json.dumps({"documents": given.count(), "refused_scopes": refused, "root": receipt["payload"]["root"]}))
    return int(refused > 0)


def verify(spark: SparkSession, args) -> int:
    policy, digest = files.read_policy(args.policy)
    identity = {"id": policy.policy_id, "sha256": digest, "version": policy.version}
    public = receipts.public_hex_of(args.public_key)
    docs, proved = (spark.read.parquet(f"{args.out}/{name}") for name in ("docs", "receipts"))
    fault, scopes = receipts.verify_scopes(spark, proved, json.loads(Path(args.receipt).read_text()), docs, identity, public)
    faults = {r["fault"]: r["n"] for r in scopes.groupBy("fault").agg(F.count("*").alias("n")).collect()}
    print(json.dumps({"fault": fault, "scopes": faults}))
    return int(fault is not None or bool(faults))


def evaluate(spark: SparkSession, args) -> int:
    """Predictions against a labelled corpus: scores by slice and type, entities by verdict, reasons of void outputs."""
    docs = _documents(spark, args.corpus)
    docs = docs.withColumn("slices", F.array(F.when(F.col("scope_id") != F.col("doc_id"), "bundle").otherwise("single")))
    answers = files.keyed(files.read_jsonl(spark, args.predictions, files.PREDICTION), "sample_id").withColumnRenamed("sample_id", "doc_id")
    contract = files.contract_of(spark, args.predictions, args.contract)
    done = reports.evaluate(docs, answers, contract)
    tables = {"Samples": done.counts(), "Spans": done.scores(), "Spans by type": done.scores("type"), "Entities": done.entities(), "Void outputs": done.reasons()}
    reports.write_lines(spark, reports.markdown(f"Evaluation by the contract {contract}", tables), args.out)
    whole = done.scores().where("slice = 'all'").first()
    print(json.dumps({"contract": contract} | (whole.asDict() if whole else {})))
    return 0


def report(spark: SparkSession, args) -> int:
    """What a labelled corpus holds: kinds, lengths, mentions by type, forms and mentions of its patients."""
    docs = _documents(spark, args.corpus)
    own = docs.select("doc_id", F.explode("mentions").alias("m")).where("m.type = 'PATIENT'").groupBy("doc_id", "m.entity_id")
    own = own.agg(F.countDistinct(F.lower("m.text")).alias("forms"), F.count("*").alias("mentions"))
    found = reports.tally(docs, {
        "kind": F.when(F.col("scope_id") != F.col("doc_id"), "bundle").otherwise("single"), "words": reports.binned(T.word_count(F.col("text")), 50),
        "mention type": F.transform("mentions", lambda m: m["type"]),
    })
    more = reports.tally(own, {"forms of a patient": F.col("forms"), "mentions of a patient, 12 and more together": F.least("mentions", F.lit(12))})
    sums = docs.agg(F.count("*").alias("samples"), F.countDistinct("scope_id").alias("scopes"), (F.count("text") - F.countDistinct("text")).alias("repeated_texts"))
    reports.write_lines(spark, reports.markdown("Corpus", {"Composition": sums, "Counts": found.unionByName(more)}), args.out)
    print(json.dumps(sums.first().asDict()))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    wanted = {
        keygen: ("keys",), generate: ("documents", "out"), run: ("corpus", "keys", "policy", "out", "receipt"), verify: ("out", "policy", "public-key", "receipt"),
        evaluate: ("corpus", "predictions", "out"), report: ("corpus", "out"),
    }
    for function, options in wanted.items():
        command = commands.add_parser(function.__name__, help=function.__doc__)
        command.set_defaults(function=function)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        if function is run:
            command.add_argument("--predictions")
        if function in (run, evaluate):
            command.add_argument("--contract", choices=("anchors", "spans"))
    args = parser.parse_args(argv)
    return args.function(spark or SparkSession.builder.appName("veilframe").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
