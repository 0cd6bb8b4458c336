"""Tables of intermediate rows."""

from pyspark.sql import functions as F

from veilframe.operators import shared


def test_tables_are_written_with_small_broadcasts_only(spark):
    """Sides of some MB meet by a shuffle while a table is written; the session's own bound comes back."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key, None)
    side = shared.kept(spark.range(60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), "side")
    few = shared.kept(spark.range(10), "few")

    def plan(right):
        return spark.range(1 << 20).join(right, "id")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(side)
    with shared.small_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan(side) and "BroadcastHashJoin" in plan(few)
    assert spark.conf.get(key, None) == before
    seen = []
    write = type(side.write).parquet
    try:
        type(side.write).parquet = lambda self, path: (seen.append(spark.conf.get(key)), write(self, path))[1]
        shared.kept(side, "again")
    finally:
        type(side.write).parquet = write
    assert seen == [str(shared.BROADCAST)]
