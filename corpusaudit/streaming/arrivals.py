"""Arrivals as streams. Each job gives what its batch twin gives on the same input."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusaudit.operators.state import derive_state
from corpusaudit.sources.documents import SOURCE_KINDS, file_kind
from corpusaudit.sources.stores import append_new

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
STATES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("arrived_at", T.TimestampType()),
        T.StructField("state", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
#: What ``check_arrivals`` keeps of each arrival.
DERIVED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("damage", T.StringType()),
    ]
)
FOLDED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("arrived_at", T.TimestampType()),
        T.StructField("n", T.LongType()),
    ]
)


def inbox_stream(spark: SparkSession, folder: str, recursive: bool = True, kinds=SOURCE_KINDS) -> DataFrame:
    """New supported files of an inbox: path, byte_size, modified_at, kind, sha256."""
    files = spark.readStream.format("binaryFile").schema(FILES)
    if recursive:
        files = files.option("recursiveFileLookup", "true")
    accepted = [name for name, supported, *_ in kinds if supported]
    kind = file_kind(F.col("path"), kinds)
    return (
        files.load(folder)
        .filter(kind.isin(*accepted))
        .select(
            "path",
            F.col("length").alias("byte_size"),
            F.col("modificationTime").alias("modified_at"),
            kind.alias("kind"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


def check_arrivals(
    arrivals: DataFrame,
    evidence: Callable[[], DataFrame],
    artifacts: Callable[[], DataFrame],
    table: str,
    checkpoint: str,
):
    """Derive the state of every new arrival once and append it to ``table``.

    ``evidence`` and ``artifacts`` are read afresh for each batch. Writing is keyed by path and
    digest, so a batch that runs twice adds nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        append_new(derive_state(batch, evidence(), artifacts()), table, ["path", "sha256"])

    return (
        arrivals.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_arrivals(arrivals: DataFrame, horizon: str, time: str = "modified_at") -> DataFrame:
    """Each (path, digest) once within the horizon; state older than that is dropped."""
    return arrivals.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["path", "sha256"])


def arrival_counts(
    arrivals: DataFrame, by: str, length: str, slide: str | None = None, late: str = "10 minutes",
    time: str = "modified_at",
) -> DataFrame:
    """(begin, end, by, n) per tumbling or sliding window; rows later than ``late`` are dropped."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        arrivals.withWatermark(time, late)
        .groupBy(span.alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), by, "n")
    )


def drained(
    arrivals: DataFrame, shape: Callable[[DataFrame], DataFrame], home: str, schema: T.StructType,
    time: str = "modified_at", past: str | None = None,
) -> DataFrame:
    """Run ``shape`` of a stream to its end into a table under ``home``, and with ``past`` close the end.

    A stream that is drained keeps its last windows open, as its watermark stands at the latest event. With
    ``past``, an interval longer than windows and lateness together, a last batch follows of one row that
    is so much later than all others and null but for its time. The watermark then passes every window that
    holds an arrival, and what a window of the last row would say is never written. Arrivals that come to
    the stream after that are late.
    """
    spark = arrivals.sparkSession
    end = f"{home}/end"
    spark.createDataFrame([], arrivals.schema).coalesce(1).write.parquet(end)
    both = arrivals.unionByName(spark.readStream.schema(arrivals.schema).parquet(end)) if past else arrivals
    latest = _run(shape(both), home)
    if past and latest is not None:
        at = F.lit(latest).cast("timestamp") + F.expr(f"INTERVAL {past}")
        row = [(at if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in arrivals.schema]
        spark.range(1).select(*row).write.mode("append").parquet(end)
        _run(shape(both), home)
    return spark.read.schema(schema).parquet(f"{home}/table")


def _run(stream: DataFrame, home: str) -> str | None:
    """Run a stream until nothing is left; the latest event time that it met."""
    job = (
        stream.writeStream.format("parquet")
        .option("path", f"{home}/table")
        .option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return max((p["eventTime"]["max"] for p in job.recentProgress if "max" in (p["eventTime"] or {})), default=None)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrivals of one Arrow batch, one row per path and digest."""
    for batch in batches:
        groups = batch.groupby(["path", "sha256"], as_index=False)
        yield groups.agg(arrived_at=("arrived_at", "min"), n=("arrived_at", "size"))


class DigestStates(StatefulProcessor):
    """Remembers the digests of one share of a path and tells new ones from those seen before.

    Of the digests that are new in a batch the first by time may be the path's first of all, which only
    all shares together know; the others cannot be.
    """

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "sha256 string", "times bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Held in memory: one entry for each digest of the share in this batch, however often it arrived.
        arrived: dict = {}
        for chunk in rows:
            for digest, at, n in zip(chunk["sha256"], chunk["arrived_at"], chunk["n"], strict=True):
                first, times = arrived.get(digest, (at, 0))
                arrived[digest] = (min(first, at), times + int(n))
        known = self.seen.exists()
        out = []
        for digest, (at, n) in sorted(arrived.items(), key=lambda e: (e[1][0], e[0])):
            before = self.seen.containsKey((digest,))
            times = self.seen.getValue((digest,))[0] if before else 0
            self.seen.updateValue((digest,), (times + n,))
            if not before:
                out.append((key[0], digest, at, "changed" if known else "first", 1))
                n -= 1
            known = True
            if n:
                out.append((key[0], digest, at, "already-ready", n))
        yield pd.DataFrame(out, columns=["path", "sha256", "arrived_at", "state", "n"])

    def close(self) -> None:
        pass


class FirstOfPath(StatefulProcessor):
    """Of what may be the first of a path, says what is. Holds one row, and one mark for each path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "met boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, least = list(STATES.names), None
        for chunk in rows:
            chunk = chunk[names]
            first = chunk["state"] == "first"
            lost = []
            for row in chunk[first].itertuples(index=False):
                if least is None or (row.arrived_at, row.sha256) < (least.arrived_at, least.sha256):
                    row, least = least, row
                if row is not None:
                    lost.append(row._replace(state="changed"))
            yield chunk[~first]
            yield pd.DataFrame(lost, columns=names)
        if least is not None:
            yield pd.DataFrame([least._replace(state="changed" if self.known.exists() else "new")], columns=names)
            self.known.update((True,))

    def close(self) -> None:
        pass


#: Shares that the digests of one path are dealt into.
SHARES = 64


def path_states(arrivals: DataFrame, shares: int = SHARES, idle: int | None = None) -> DataFrame:
    """(path, sha256, arrived_at, state, n) of arrivals, across batches of the stream.

    A digest seen under the path before is ready, another one changed, the first one new; ``n``
    arrivals share the row. State is kept by (path, share of its digests), so a path with any part of all
    arrivals and any number of digests is dealt over ``shares`` tasks. A second operator by path gets one row
    of each share that may be the path's first; what is decided stays with its share. Copies are folded before
    the shuffle. With ``idle``, in milliseconds, digests that do not arrive for so long are forgotten.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    mode = "None" if idle is None else "ProcessingTime"
    seen = (
        arrivals.select("path", "arrived_at", "sha256")
        .mapInPandas(_fold, FOLDED)
        .withColumn("share", F.pmod(F.xxhash64("sha256"), F.lit(shares)).cast("int"))
        .groupBy("path", "share")
        .transformWithStateInPandas(
            statefulProcessor=DigestStates(idle), outputStructType=STATES, outputMode="Append", timeMode=mode
        )
    )
    decided = F.pmod(F.xxhash64("sha256"), F.lit(shares)).cast("int")
    return (
        seen.withColumn("share", F.when(F.col("state") == "first", F.lit(-1)).otherwise(decided))
        .groupBy("path", "share")
        .transformWithStateInPandas(
            statefulProcessor=FirstOfPath(), outputStructType=STATES, outputMode="Append", timeMode=mode
        )
    )


def path_states_batch(arrivals: DataFrame) -> DataFrame:
    """The batch twin of ``path_states``, over all arrivals at once, by partial aggregates."""
    order = F.struct("arrived_at", "sha256")
    per_digest = arrivals.groupBy("path", "sha256").agg(
        F.min("arrived_at").alias("arrived_at"), F.count("*").alias("n")
    )
    per_path = per_digest.groupBy("path").agg(F.min(order).alias("_first"))
    joined = per_digest.join(per_path, "path")
    fresh = F.when(order == F.col("_first"), F.lit("new")).otherwise(F.lit("changed"))
    one = F.lit(1).cast("bigint")
    rows = F.array(
        F.struct(fresh.alias("state"), one.alias("n")),
        F.struct(F.lit("already-ready").alias("state"), (F.col("n") - 1).alias("n")),
    )
    split = joined.select("path", "sha256", "arrived_at", F.inline(rows))
    return split.filter(F.col("n") > 0)
