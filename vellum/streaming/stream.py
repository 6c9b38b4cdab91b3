"""Incremental arrival with Structured Streaming: landed responses, session status, run summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import ocr
from vellum.sources.workspace import settle, shared_path


def landed_responses(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of OCR responses as their files land."""
    return ocr.responses_of(spark.readStream.schema(ocr.RESPONSE).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path))


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all that has landed to Parquet, exactly once per checkpoint, and return."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State with timers or a time to live needs this store; it also keeps state out of the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_slices(rows: DataFrame, by: str, slices: int, run: Callable[[DataFrame], None]) -> None:
    """Let ``rows`` arrive in ``slices`` equal ranges of the number ``by``; ``run`` drains a stream of what has landed.

    Each run is a stream of its own that goes on from the checkpoint of the one before, as after a restart.
    """
    spark = rows.sparkSession
    rows = settle(rows, "arriving")  # made once, not for the bounds and for each slice
    path = shared_path(spark, "landing")
    first, last = rows.agg(F.min(by), F.max(by)).first()
    if first is None:
        first = last = 0
    width = (last - first) // slices + 1
    for k in range(slices):
        low = first + k * width
        rows.where(F.col(by).between(low, low + width - 1)).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def running_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """A running count per key, for complete or update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per time window and event type; events later than ``late`` are dropped with their state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def once_per_question(questions: DataFrame, within: str = "1 hour") -> DataFrame:
    """Questions without repeats of a cache key that arrive within the watermark."""
    return questions.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def collect_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write an aggregated stream's final state, all that is there now having been read."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_status(changes: DataFrame) -> DataFrame:
    """session_id, status: the last status of each session, of a batch or of what a stream has written."""
    return changes.groupBy("session_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
