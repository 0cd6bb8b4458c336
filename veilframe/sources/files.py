"""Files: JSON Lines with declared schemas, line lists, policies; compact JSON Lines out."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.contracts import CONTRACTS
from veilframe.operators.surrogates import Policy

DOCUMENT = (
    "sample_id string, bundle_id string, text string,"
    " mentions array<struct<start: long, end: long, text: string, type: string, entity_id: string>>"
)
PREDICTION = "sample_id string, raw_output string, finished boolean"
TRAINING = "sample_id string, instruction_version string, instruction string, input string, output string"


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One JSON object per line; a line that breaks the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows, with an error at run time if a key repeats; null keys may repeat."""
    again = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_times")).where("_times > 1")
    fault = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("boolean")
    return rows.join(again, key, "left").where(F.when(F.col("_times").isNull(), True).otherwise(fault)).select(*rows.columns)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that are neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def training_problems(rows: DataFrame, version: str) -> DataFrame:
    """(problem, n, first_id) of rows by TRAINING: missing_key (a null in any), other_version, other_instruction.

    The instruction is the most frequent one, of equally frequent ones the least. A row has its first problem only.
    """
    names = [f.split()[0] for f in TRAINING.split(", ")]
    usual = rows.where("instruction is not null").groupBy("instruction").count().agg(F.min(F.struct((-F.col("count")).alias("n"), "instruction")).alias("u")).select(F.col("u.instruction").alias("_usual"))
    each = rows.crossJoin(F.broadcast(usual))  # one row
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    problem = F.when(missing, "missing_key").when(F.col("instruction_version") != version, "other_version").when(F.col("instruction") != F.col("_usual"), "other_instruction")
    each = each.withColumn("problem", problem).where("problem is not null")
    return each.groupBy("problem").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


def read_training(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Training rows of one version and instruction; an empty file, or any row with a problem, is an error."""
    rows = read_jsonl(spark, path, TRAINING)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    found = [f"{r['problem']}: {r['n']} rows, {r['first_id']} the first" for r in training_problems(rows, version).orderBy("problem").collect()]
    if found:
        raise ValueError(f"{path}: {'; '.join(found)}")
    return rows


def contract_of(spark: SparkSession, predictions: str, given: str | None = None, default: str | None = None) -> str:
    """The contract of a file of predictions: the given one, else that in <predictions>.manifest.json, else the default."""
    if given:
        return given
    told = None
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{predictions.rstrip('/')}.manifest.json")
    if beside.getFileSystem(spark._jsc.hadoopConfiguration()).exists(beside):
        told = spark.read.schema("contract string").option("multiLine", True).json(beside.toString()).first()
    named = (told and told["contract"]) or default
    if named is None:
        raise ValueError(f"no contract is given, and {beside.toString()} names none")
    if named not in CONTRACTS:
        raise ValueError(f"{beside.toString()} names an unknown contract: {named}")
    return named


_POLICY = {"policy_id": str, "version": int, "min_weeks": int, "max_weeks": int, "direction": str, "age": str, "age_cap": int, "age_label": str, "unresolved_month": str}
_CHOICES = {"direction": ("backward", "forward", "either"), "age": ("cap", "keep"), "unresolved_month": ("drop", "keep")}


def read_policy(path: str) -> tuple[Policy, str]:
    """(checked policy, SHA-256 of its bytes); unknown or missing keys and values of no meaning are errors."""
    import yaml

    raw = Path(path).read_bytes()
    found = yaml.safe_load(raw)
    if not isinstance(found, dict) or set(found) != set(_POLICY):
        raise ValueError(f"a policy has exactly the keys {sorted(_POLICY)}")
    if wrong := [k for k, t in _POLICY.items() if type(found[k]) is not t or found[k] == ""]:
        raise ValueError(f"values of another type or empty: {wrong}")
    if wrong := [k for k, values in _CHOICES.items() if found[k] not in values]:
        raise ValueError(f"values that have no meaning: {wrong}")
    if not 0 < found["min_weeks"] <= found["max_weeks"] or found["age_cap"] < 1 or found["version"] < 0:
        raise ValueError("the shift window is empty, or a number is too small")
    return Policy(**found), hashlib.sha256(raw).hexdigest()
