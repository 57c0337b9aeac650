"""Session settings the jobs are written for, and where intermediate tables go."""

import re
import threading
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2097152b",
}
#: Bytes that go to a Python worker at once where rows are whole files.
BATCH_BYTES = 2 << 20


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Put the settings on a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of 2 MB, if the session's are larger.

    A worker holds a batch whole, and what it makes of it. By Spark's own limit of 64 MB each worker of a
    chain of readers grows with the rows of its task up to several times that.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index((unit or "b")[0]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


_SOURCES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_REGISTERING = threading.Lock()


def register(spark: SparkSession, source: type) -> None:
    """Make a data source known to a session, once: a second time would take it away for a moment."""
    with _REGISTERING:
        known = _SOURCES.setdefault(spark, set())
        if source not in known:
            spark.dataSource.register(source)
            known.add(source)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Only where none is named, as in tests, a folder of the warehouse is taken, which every executor
    of a session sees as well. Tables in it are not deleted: results may still be read from them.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Write a table to the shared folder, in folders by some columns if they are named, and read it back.

    Cuts the plan where a step looks at its input several times, survives lost executors, and
    unlike a checkpoint keeps column pruning and pushed filters for what comes after.
    """
    spark = df.sparkSession
    where = new_folder(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(where)
    return spark.read.schema(df.schema).parquet(where)
