"""Streams: the stage machine, change feeds, deduplication, counts over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators import index_state as I
from tidepool.operators.stage_machine import running_summary, stage_stream
from tidepool.sources.tables import current, publish, published_mark

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive, with ``ts`` as a timestamp that watermarks accept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for the queries that are started within; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stage_states(log: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """State per key of a streamed log; start it within ``rocksdb``. A new query continues from ``published``."""
    return stage_stream(log, published)


def live_summary(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Publishes (status, n) after every micro-batch of stage changes (status, before): before takes one, after adds one.

    The counts carry the number of the micro-batch they include, published with them as one
    version, so a micro-batch that is run again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if (mark := published_mark(spark, root)) is not None and number <= mark:
            return
        moved = running_summary(batch.select("before", F.col("status").alias("after")))
        if mark is not None:
            moved = moved.unionByName(current(spark, root).select("status", "n"))
        counts = moved.groupBy("status").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") != 0)
        publish(counts.coalesce(1), root, mark=number)  # a row a status

    return changes.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_over_time(results: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, status, n) of streamed results (ts, status); rows later than ``late`` no longer count."""
    return results.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))


def distinct_answers(results: DataFrame, request: list[str], late: str = "10 minutes") -> DataFrame:
    """The first answer of each request; the state of a request is dropped when it is too old to repeat."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(request)


def keep_index(
    snapshots: DataFrame, root: str, metadata: list[str], versions: dict[str, str], checkpoint: str, generation: str | None = None
) -> StreamingQuery:
    """Applies streamed snapshots (asset_id, metadata, batch rows) to the published assets and stages.

    Each micro-batch is one whole snapshot: it is compared with the published one, stages of
    changed assets start over, and the next versions are published. A repeated micro-batch
    finds no change and publishes the same rows. With a ``generation`` column, which counts
    the snapshots as they were asked for, the published assets carry theirs, and a slow
    snapshot of an older or the same generation changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark, assets, mark = batch.sparkSession, batch.select("asset_id", *metadata), None
        if generation:
            mark, newest = batch.agg(F.max(generation)).first()[0], published_mark(spark, f"{root}/assets")
            if mark is None or (newest is not None and mark <= newest):
                return
        none = assets.select("asset_id").limit(0)
        try:
            stored, stages = current(spark, f"{root}/assets"), current(spark, f"{root}/stages")
        except FileNotFoundError:
            stored = assets.limit(0)
            stages = spark.createDataFrame([], f"asset_id {assets.schema['asset_id'].dataType.simpleString()}, kind string, version string, status string")
        diff = I.snapshot_diff(stored, assets, none, metadata)
        publish(I.reconciled(stages, diff, versions), f"{root}/stages", ("kind", "version"))
        publish(assets, f"{root}/assets", mark=mark)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, sink: Callable | None = None) -> StreamingQuery:
    """Runs a stream over what is there now, into a memory table or a batch function, and waits for it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    q.awaitTermination(300)
    return q
