"""Status of sessions as it moves: a keyed table that a stream's batches are merged into."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.workspace import delete

#: How a session's status moves, a step at a time; the last two end it.
LEVELS = {"UPLOADING": 1, "PROCESSING": 2, "READY": 3, "FAILED": 3}

TABLE = "session_id string, status string, since struct<ts:timestamp,event_id:bigint>, n_changes bigint, n_refused bigint, bucket int"


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Each bucket's committed versions, ascending, by the names of folders alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for top in fs.listStatus(root) if fs.exists(root) else []:
        version = re.fullmatch(r"v=(\d+)", top.getPath().getName())
        if version and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(top.getPath(), "_SUCCESS")):
            for own in fs.listStatus(top.getPath()):
                bucket = re.fullmatch(r"bucket=(\d+)", own.getPath().getName())
                if bucket:
                    out.setdefault(int(bucket[1]), []).append(int(version[1]))
    return {b: sorted(v) for b, v in out.items()}


def _read(spark: SparkSession, path: str, chosen: dict[int, int]) -> DataFrame:
    if not chosen:
        return spark.createDataFrame([], TABLE)
    folders = [f"{path}/v={v}/bucket={b}" for b, v in sorted(chosen.items())]
    return spark.read.schema(TABLE).option("basePath", path).parquet(*folders)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """session_id, status, since, n_changes and n_refused as the last committed batch left them."""
    return _read(spark, path, {b: v[-1] for b, v in _versions(spark, path).items()}).drop("bucket")


def _moved(now: DataFrame, changes: DataFrame) -> DataFrame:
    """``now`` after ``changes`` (session_id, level, status, at): each session takes the first change to its next level, level by level."""
    for level in range(max(LEVELS.values())):
        standing = now.where(F.col("level") == level).select("session_id", "since")
        next_ = changes.where(F.col("level") == level + 1).join(standing, "session_id").where("since IS NULL OR at > since")
        taken = next_.groupBy("session_id").agg(F.min_by("status", "at").alias("to"), F.min("at").alias("to_at"))
        moved = F.col("to").isNotNull()
        now = now.join(taken, "session_id", "left").select(
            "session_id", F.when(moved, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(moved, F.col("to_at")).otherwise(F.col("since")).alias("since"),
            (F.col("n_changes") + moved.cast("long")).alias("n_changes"), "n_refused", (F.col("level") + moved.cast("int")).alias("level"), "bucket",
        )
    return now


def merge_status(path: str, changes: DataFrame, batch_id: int, buckets: int = 64) -> None:
    """Merge a batch of ``changes`` (session_id, status, ts, event_id) into the table at ``path``.

    A session's status moves only from UPLOADING to PROCESSING and on to READY or FAILED, in the order
    of (ts, event_id); any other change, an unknown status and one before the last move are refused and
    counted. Nulls in session_id are left out; without a ts a change is refused.

    The table is cut into ``buckets`` by the session's hash. A batch writes a new version of the buckets
    that it touches from those of the batches before it, and counts once its folder is complete: a batch
    that is replayed under its own id, as a stream does after a failure, gives the same table. A
    version that two later ones cover is deleted.
    """
    spark = changes.sparkSession
    before = {b: [v for v in own if v < batch_id] for b, own in _versions(spark, path).items()}
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("status")]
    own = changes.where("session_id IS NOT NULL").select(
        F.col("session_id").cast("string").alias("session_id"), "status", level.alias("level"), bucket.alias("bucket"),
        F.when(F.col("ts").isNotNull(), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))).alias("at"),
    )
    # at most one row a bucket
    touched = {r[0] for r in own.select("bucket").distinct().collect()}
    if not touched:
        return
    old = _read(spark, path, {b: before[b][-1] for b in touched if before.get(b)})
    asked = own.groupBy("session_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    now = old.join(asked, ["session_id", "bucket"], "full").select(
        "session_id", "status", "since", F.coalesce("n_changes", zero).alias("n_changes"), (F.coalesce("n_refused", zero) + F.coalesce("n", zero)).alias("n_refused"),
        F.coalesce(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("status")], F.lit(0)).alias("level"), "bucket",
    )
    done = now.select("session_id", F.col("n_changes").alias("before"))
    # what was taken was not refused
    told = _moved(now, own.where("level IS NOT NULL AND at IS NOT NULL")).join(done, "session_id")
    told = told.withColumn("n_refused", F.col("n_refused") - (F.col("n_changes") - F.col("before")))
    rows = told.select("session_id", "status", "since", "n_changes", "n_refused", "bucket")
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
    for b in touched:
        for v in before.get(b, [])[:-1]:
            delete(spark, f"{path}/v={v}/bucket={b}")


def follow_status(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Merge all that a stream of ``changes`` has, batch by batch, and return."""
    merge = lambda batch, batch_id: merge_status(path, batch, batch_id)
    changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
