"""Reports as tables: counts of items by section, first failures of each gate, evaluations of predictions, differences of
two runs; and Markdown of such tables, whose rows are as few as there are items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators import contracts, hashtree, metrics, relocate
from veilframe.operators.shared import kept, small_batches

#: Failures that a report shows of each gate.
SHOWN = 50
#: Outputs that are read in Python at once: a mention takes some 1000 times its length there.
OUTPUTS = 256
_SPAN = ["doc_id", "start", "end", "type"]


def binned(value: Column, width: int) -> Column:
    """The bin of a whole number, as '50-99'; null has none."""
    low = F.floor(value / width) * width
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def tally(rows: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """(section, item, n): how often each item stands in each section, in one pass with one shuffle of sums.

    A section is a column of single items or of arrays of them. Nulls are no items; an empty table has no rows.
    """
    lists = rows.select(*(c.alias(name) for name, c in sections.items()))
    labelled = lambda own, name: F.transform(own, lambda x: F.struct(F.lit(name).alias("section"), x.alias("item")))
    parts = []
    for field in lists.schema.fields:
        own = F.col(f"`{field.name}`")
        own = own.cast("array<string>") if field.dataType.typeName() == "array" else F.array(own.cast("string"))
        own = F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda x: x.isNotNull())
        parts.append(labelled(own, field.name))
    return lists.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.section", "x.item").agg(F.count("*").alias("n"))


def first_failures(failures: DataFrame, gate: str, *order: str, shown: int = SHOWN) -> DataFrame:
    """The first failures of each gate in an order, with place (from 1); each task sends as many of a gate at most."""
    place = F.row_number().over(Window.partitionBy(gate).orderBy(*order))
    return failures.withColumn("place", place).where(F.col("place") <= shown)


@dataclass
class Evaluation:
    """samples(doc_id, slices, reason, unfinished, n_predicted, n_unlocatable), outcomes(doc_id, start, end, type, tp, fp,
    fn), verdicts(doc_id, entity_id, verdict)."""

    samples: DataFrame
    outcomes: DataFrame
    verdicts: DataFrame

    def _by_slice(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.samples.select("doc_id", F.explode("slices").alias("slice")), "doc_id")

    def scores(self, *by: str) -> DataFrame:
        """Span scores of each slice, by type if that is asked for."""
        return metrics.scores(self._by_slice(self.outcomes), "slice", *by)

    def counts(self) -> DataFrame:
        """Of each slice its samples, those without a usable output, unfinished ones, mentions predicted and unlocatable."""
        each = self.samples.withColumn("slice", F.explode("slices"))
        sums = (F.sum(c).alias(c) for c in ("n_predicted", "n_unlocatable"))
        return each.groupBy("slice").agg(F.count("*").alias("samples"), F.count("reason").alias("malformed"), F.count_if("unfinished").alias("unfinished"), *sums)

    def entities(self) -> DataFrame:
        """Entities of each slice by their verdict."""
        return self._by_slice(self.verdicts).groupBy("slice", "verdict").agg(F.count("*").alias("n"))

    def reasons(self, shown: int = 5) -> DataFrame:
        """The most frequent reasons for which an output could not be used."""
        return self.samples.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(shown)


def evaluate(docs: DataFrame, predictions: DataFrame, contract: str) -> Evaluation:
    """docs(doc_id, text, mentions, slices) against predictions(doc_id, raw_output, finished).

    An output that breaks the contract, or none, misses every mention and leaves every entity incomplete; nothing is
    repaired. A mention that cannot be located is a false positive and places nothing. Every sample is in slice all,
    whatever its slices (null: none). Only finished = false is unfinished. Predictions of unknown documents, null ids
    included, are an error; doc_ids of either side are different.
    """
    with small_batches(docs.sparkSession, OUTPUTS):
        return _evaluated(docs, predictions, contract)


def _evaluated(docs: DataFrame, predictions: DataFrame, contract: str) -> Evaluation:
    stray = predictions.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"a prediction of an unknown document: {stray[0]['doc_id']}")
    answers = predictions.select("doc_id", "raw_output", F.coalesce("finished", F.lit(True)).alias("finished"), F.lit(True).alias("answered"))
    met = docs.select("doc_id", "text", "slices").join(answers, "doc_id", "left")
    parsed = contracts.parse_anchored("raw_output") if contract == "anchors" else contracts.parse_spans(F.col("raw_output"), F.length("text"))
    met = kept(met.withColumn("x", parsed), "parsed")
    usable = met.select("doc_id", F.coalesce("x.mentions", F.expr("cast(array() as array<struct<text: string, n: bigint, start: bigint, end: bigint, type: string, id: string>>)")).alias("mentions"))
    gold = docs.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", "m.end", "m.type", "m.entity_id")
    if contract == "anchors":
        placed = kept(relocate.located(docs.select("doc_id", "text"), usable), "placed")
        found = placed.select("doc_id", F.explode("located").alias("m")).select("doc_id", "m.start", "m.end", "m.type", F.col("m.entity_id").alias("id"))
        outcomes = relocate.anchored_outcomes(gold.drop("entity_id"), placed)
        lost = placed.select("doc_id", F.size("unlocatable").cast("long").alias("n_unlocatable"))
    else:
        found = usable.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", "m.end", "m.type", "m.id")
        outcomes = metrics.span_outcomes(gold, found, _SPAN)
        lost = usable.select("doc_id", F.lit(0).cast("long").alias("n_unlocatable"))
    slices = F.array_distinct(F.concat(F.array(F.lit("all")), F.coalesce(F.array_compact("slices"), F.array().cast("array<string>"))))
    samples = met.join(lost, "doc_id", "left").select(
        "doc_id", slices.alias("slices"), F.when(F.col("answered").isNull(), "no_prediction").otherwise(F.col("x.error")).alias("reason"),
        (~F.coalesce("finished", F.lit(True))).alias("unfinished"),
        F.coalesce(F.size("x.mentions"), F.lit(0)).cast("long").alias("n_predicted"), F.coalesce("n_unlocatable", F.lit(0).cast("long")).alias("n_unlocatable"),
    )
    return Evaluation(kept(samples, "samples"), kept(outcomes, "outcomes"), kept(metrics.consistency(gold, found, "doc_id", ["start", "end", "type"]), "verdicts"))


def output_hash(raw: Column) -> Column:
    """The hash of an output, in which null differs from the empty text."""
    return F.sha2(F.coalesce(F.concat(F.lit("="), raw), F.lit("")), 256)


def run_digest(outputs: DataFrame, levels: int) -> DataFrame:
    """(n_leaves, root) of outputs(doc_id, raw_output), whatever the order of their rows; doc_ids different and not null."""
    return hashtree.root(outputs.select(F.col("doc_id").alias("key"), output_hash(F.col("raw_output")).alias("hash")), levels)


def run_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, difference): outputs(doc_id, raw_output) of two runs that are changed, lost or added in the second."""
    a = first.select("doc_id", output_hash(F.col("raw_output")).alias("a"))
    b = second.select("doc_id", output_hash(F.col("raw_output")).alias("b"))
    kind = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "doc_id", "full_outer").select("doc_id", kind.alias("difference")).where("difference is not null")


def markdown(title: str, tables: dict[str, DataFrame]) -> list[str]:
    """The lines of a report: each table under its name, rows in the order of their columns. For tables of few rows."""
    lines = [f"# {title}", ""]
    for name, rows in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|---" * len(rows.columns) + "|"]
        for row in rows.orderBy(*rows.columns).collect():
            lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |")
        lines.append("")
    return lines


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """One text file in a folder of any store that Spark writes to."""
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "place int, value string").coalesce(1).sortWithinPartitions("place").select("value").write.text(path)
