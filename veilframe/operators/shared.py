"""Tables of intermediate rows in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
#: Bytes up to which a side of a join is broadcast while a table is written: a statement may have a dozen such joins, and
#: the driver holds all their sides at once.
BROADCAST = 1 << 20
_registered: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This run's folder under spark.checkpoint.dir; a local master gets a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veilframe-core-{_RUN}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: its lineage is cut, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    top = folder(spark)
    if top not in _registered:
        _registered.add(top)
        atexit.register(_delete, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:10]}"
    with small_broadcasts(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Sides of joins of over BROADCAST bytes are shuffled in what is written meanwhile, unless the session has a lower bound."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    for key, value in zip(keys, before, strict=True):
        if value is None or not value.lstrip("-").isdigit() or int(value) > BROADCAST:
            spark.conf.set(key, str(BROADCAST))
    try:
        yield
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is computed meanwhile: Python holds a whole batch of what it reads and makes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pinned(rows: DataFrame) -> DataFrame:
    """rows with every column made once a row: a generator stands between them and expressions that use them often, such as
    in a lambda, where the optimizer would put the whole expression in place of the column."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
