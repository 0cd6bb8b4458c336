"""De-identification of a stream of labelled documents; surrogates need no state, as keys derive from the scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.surrogates import Policy, deidentify


def deidentify_stream(docs: DataFrame, path: str, checkpoint: str, secret: bytes, policy: Policy = Policy()) -> StreamingQuery:
    """docs(doc_id, bundle_id, text, mentions) as a stream -> Parquet, one complete scope within a batch."""

    def write(batch: DataFrame, number: int) -> None:
        scoped = batch.withColumn("scope_id", F.coalesce("bundle_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
        mentions = scoped.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*").drop("text")
        deidentify(scoped.select("doc_id", "scope_id", "text"), mentions, secret, policy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
