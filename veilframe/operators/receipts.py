"""Hashes of scopes in bounded groups, and signed receipts of a run."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import hashtree

#: Documents, or scopes, hashed together before their hashes are hashed.
BLOCK = 1024


def _digest(column: str):
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["h"]), ","), 256)


def scope_hashes(docs: DataFrame) -> DataFrame:
    """docs(scope_id, doc_id, text) -> (scope_id, n_docs, digest). A document's hash covers its id and text;
    BLOCK ids in a row are hashed first, so a scope of any number of documents meets as block hashes only."""
    each = docs.select(
        "scope_id", F.floor(F.col("doc_id") / BLOCK).alias("block"),
        F.struct("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256).alias("h")).alias("x"),
    )
    blocks = each.groupBy("scope_id", "block").agg(F.count("*").alias("n"), _digest("x").alias("h"))
    return blocks.groupBy("scope_id").agg(F.sum("n").alias("n_docs"), _digest_of_blocks().alias("digest"))


def _digest_of_blocks():
    parts = F.array_sort(F.collect_list(F.struct("block", "h")))
    return F.sha2(F.array_join(F.transform(parts, lambda x: x["h"]), ","), 256)


def root_hash(hashes: DataFrame) -> DataFrame:
    """One row: the hash over all scopes, by the first three digits of the hash of their names."""
    placed = hashes.select(F.substring(F.sha2("scope_id", 256), 1, 3).alias("block"), F.struct("scope_id", F.col("digest").alias("h")).alias("x"))
    blocks = placed.groupBy("block").agg(F.count("*").alias("n"), _digest("x").alias("h"))
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_scopes"), _digest_of_blocks().alias("digest"))


class Signer:
    """Ed25519 keys of the driver's JVM; no private key reaches an executor."""

    def __init__(self, spark: SparkSession, private=None, public=None):
        self.spark, self.security = spark, spark._jvm.java.security
        if private is None:
            pair = self.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
            private, public = pair.getPrivate(), pair.getPublic()
        self.private, self.public = private, public

    @classmethod
    def load(cls, spark: SparkSession, private_path: str, public_path: str) -> Signer:
        factory = spark._jvm.java.security.KeyFactory.getInstance("Ed25519")
        spec = spark._jvm.java.security.spec
        private = factory.generatePrivate(spec.PKCS8EncodedKeySpec(_read_pem(private_path)))
        return cls(spark, private, factory.generatePublic(spec.X509EncodedKeySpec(_read_pem(public_path))))

    def save(self, private_path: str, public_path: str) -> None:
        """PEM files; the private one is readable by its owner only, and no file is written over."""
        _write_pem(private_path, "PRIVATE KEY", self._encoded(self.private, "PKCS8EncodedKeySpec"), 0o600)
        _write_pem(public_path, "PUBLIC KEY", self._encoded(self.public, "X509EncodedKeySpec"), 0o644)

    def _encoded(self, key, form: str) -> bytes:
        of = self.spark._jvm.java.lang.Class.forName(f"java.security.spec.{form}")
        return bytes(self.security.KeyFactory.getInstance("Ed25519").getKeySpec(key, of).getEncoded())

    @property
    def public_hex(self) -> str:
        """The raw public key: the last 32 bytes of its encoding."""
        return self._encoded(self.public, "X509EncodedKeySpec")[-32:].hex()

    @property
    def key_id(self) -> str:
        return hashlib.sha256(bytes.fromhex(self.public_hex)).hexdigest()[:16]

    def sign(self, payload: dict) -> dict:
        signature = self.security.Signature.getInstance("Ed25519")
        signature.initSign(self.private)
        signature.update(canonical(payload))
        return {"payload": payload, "signature": bytes(signature.sign()).hex(), "public_key": self.public_hex, "key_id": self.key_id}

    def verify(self, receipt: dict) -> bool:
        return trusted(self.spark, receipt, self.public_hex)


#: The encoding of an Ed25519 public key is this and the raw key.
_PUBLIC_HEAD = bytes.fromhex("302a300506032b6570032100")


def trusted(spark: SparkSession, receipt: dict, public_hex: str) -> bool:
    """True if the receipt names this public key and was signed with its private one."""
    security = spark._jvm.java.security
    try:
        if receipt["public_key"] != public_hex or receipt["key_id"] != hashlib.sha256(bytes.fromhex(public_hex)).hexdigest()[:16]:
            return False
        spec = security.spec.X509EncodedKeySpec(_PUBLIC_HEAD + bytes.fromhex(public_hex))
        signature = security.Signature.getInstance("Ed25519")
        signature.initVerify(security.KeyFactory.getInstance("Ed25519").generatePublic(spec))
        signature.update(canonical(receipt["payload"]))
        return bool(signature.verify(bytes.fromhex(receipt["signature"])))
    except Exception:  # a receipt without these parts, a key or a signature of another form
        return False


def _write_pem(path: str, kind: str, raw: bytes, mode: int) -> None:
    body = base64.encodebytes(raw).decode()
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "w") as file:
        file.write(f"-----BEGIN {kind}-----\n{body}-----END {kind}-----\n")


def _read_pem(path: str) -> bytes:
    lines = Path(path).read_text().split("\n")
    return base64.b64decode("".join(x for x in lines if x and not x.startswith("-----")))


def public_hex_of(path: str) -> str:
    """The raw key of a public PEM file."""
    return _read_pem(path)[-32:].hex()


def save_secret(secret: bytes, path: str) -> None:
    """The surrogates' secret in hex, readable by its owner only; no file is written over."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as file:
        file.write(secret.hex() + "\n")


def load_secret(path: str) -> bytes:
    secret = bytes.fromhex(Path(path).read_text().strip())
    if len(secret) < 16:
        raise ValueError("a secret has 16 bytes or more")
    return secret


def secret_id(secret: bytes) -> str:
    """Tells which secret a run used and reveals nothing of it."""
    return hashlib.sha256(secret).hexdigest()[:16]


def canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sign_run(docs: DataFrame, signer: Signer, policy: dict) -> dict:
    """A receipt of a whole run: counts and hashes only, no text."""
    top = root_hash(scope_hashes(docs)).first()
    payload = {
        "policy": hashlib.sha256(canonical(policy)).hexdigest(), "scopes": top["n_scopes"], "documents": docs.count(), "root": top["digest"],
    }
    return signer.sign(payload)


def verify_run(receipt: dict, docs: DataFrame, signer: Signer, policy: dict) -> str | None:
    """None, or the first reason to reject."""
    if not signer.verify(receipt):
        return "signature"
    payload = receipt["payload"]
    if payload["policy"] != hashlib.sha256(canonical(policy)).hexdigest():
        return "policy"
    if payload["documents"] != docs.count():
        return "documents"
    return None if payload["root"] == root_hash(scope_hashes(docs)).first()["digest"] else "root"


# Receipts of every scope under one signature


def document_hash(doc_id: Column, text: Column, mentions: Column) -> Column:
    """Over a document's canonical JSON: id, text and mentions in order; a null text is not an empty one."""
    span = lambda m: F.struct(m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), m["type"].alias("type"), m["entity_id"].alias("entity_id"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, type: string, entity_id: string>>)")
    own = F.array_sort(F.coalesce(F.transform(mentions, span), none))
    whole = F.struct(doc_id.cast("string").alias("doc_id"), own.alias("mentions"), text.alias("text"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def document_hashes(docs: DataFrame) -> DataFrame:
    """docs(scope_id, doc_id, text, mentions) -> (scope_id, n_docs, digest): hashes of documents, in blocks by the beginning of
    the hash of their id, so a scope of any size meets as block hashes only."""
    each = docs.select(
        "scope_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2).alias("block"),
        F.struct("doc_id", document_hash(F.col("doc_id"), F.col("text"), F.col("mentions")).alias("h")).alias("x"),
    )
    blocks = each.groupBy("scope_id", "block").agg(F.count("*").alias("n"), _digest("x").alias("h"))
    return blocks.groupBy("scope_id").agg(F.sum("n").alias("n_docs"), _digest_of_blocks().alias("digest"))


def scope_receipts(before: DataFrame, after: DataFrame, report: DataFrame, policy: dict) -> DataFrame:
    """(scope_id, payload, hash): what each scope's run took in, gave out and counted, as canonical JSON, and its hash.

    before and after: (scope_id, doc_id, text, mentions); report: (scope_id, counts..., ok).
    """
    counts = F.struct(*sorted(c for c in report.columns if c != "scope_id"))
    each = document_hashes(before).select("scope_id", F.struct("digest", F.col("n_docs").alias("documents")).alias("input"))
    each = each.join(document_hashes(after).select("scope_id", F.struct("digest", F.col("n_docs").alias("documents")).alias("output")), "scope_id", "full_outer")
    each = each.join(report.select("scope_id", counts.alias("report")), "scope_id", "left")
    payload = F.struct("input", "output", F.lit(hashlib.sha256(canonical(policy)).hexdigest()).alias("policy"), "report", F.col("scope_id").cast("string").alias("scope_id"))
    each = each.select("scope_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    return each.withColumn("hash", F.sha2("payload", 256))


def sign_scopes(receipts: DataFrame, signer: Signer, policy: dict, secret: bytes) -> tuple[DataFrame, dict]:
    """Receipts (scope_id, payload, hash) with proofs of membership, and one signed receipt over their hash tree."""
    levels = hashtree.levels_for(receipts.count())
    leaves = receipts.select(F.col("scope_id").alias("key"), "hash")
    top = hashtree.root(leaves, levels).first()
    proved = hashtree.proofs(leaves, levels).select(F.col("key").alias("scope_id"), "proof")
    payload = {
        "levels": levels, "policy": hashlib.sha256(canonical(policy)).hexdigest(), "root": top["root"], "scopes": top["n_leaves"], "secret": secret_id(secret),
    }
    return receipts.join(proved, "scope_id"), signer.sign(payload)


def verify_scopes(spark: SparkSession, receipts: DataFrame, run: dict, after: DataFrame, policy: dict, public_hex: str) -> tuple[str | None, DataFrame]:
    """(fault of the run, faults of its scopes (scope_id, fault)) against a key that the caller trusts.

    Faults of the run: signature, policy, scopes (another number of receipts), root. Faults of a scope: payload (it is
    not what its hash covers), proof (it does not belong to the tree), policy, output (documents are not those of the
    receipt), no_output, no_receipt. Scopes without a fault have no row.
    """
    empty = spark.createDataFrame([], "scope_id string, fault string")
    if not trusted(spark, run, public_hex):
        return "signature", empty
    payload, wanted = run["payload"], hashlib.sha256(canonical(policy)).hexdigest()
    out = document_hashes(after).select(F.col("scope_id").cast("string").alias("scope_id"), F.col("digest").alias("now"), F.col("n_docs").alias("n_now"))
    own = receipts.select(F.col("scope_id").cast("string").alias("scope_id"), "payload", "hash", "proof")
    each = own.join(out, "scope_id", "full_outer")
    told = F.from_json("payload", "output struct<digest: string, documents: long>, policy string, scope_id string")
    each = each.withColumn("told", told)
    proven = hashtree.proven(F.col("scope_id"), F.col("hash"), F.col("proof"), F.lit(payload["root"]))
    fault = (
        F.when(F.col("payload").isNull(), "no_receipt")
        .when((F.sha2("payload", 256) != F.col("hash")) | ~F.col("told.scope_id").eqNullSafe(F.col("scope_id")), "payload").when(~proven, "proof")
        .when(F.col("told.policy") != wanted, "policy").when(F.col("now").isNull() & F.col("told.output").isNotNull(), "no_output")
        .when(~F.col("now").eqNullSafe(F.col("told.output.digest")) | ~F.col("n_now").eqNullSafe(F.col("told.output.documents")), "output")
    )
    faults = each.select("scope_id", fault.alias("fault")).where("fault is not null")
    if payload["policy"] != wanted:
        return "policy", faults
    if receipts.count() != payload["scopes"]:
        return "scopes", faults
    top = hashtree.root(receipts.select(F.col("scope_id").alias("key"), "hash"), payload["levels"]).first()
    return (None if top["root"] == payload["root"] else "root"), faults
