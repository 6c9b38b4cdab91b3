"""Experiments watched as their runs arrive: moments in the stream's state, the stopping rule at every trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import experiments


def watch(runs: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the moments of a stream of ``runs`` and log what each trigger finds at ``path``, then return.

    The state is a row for each variant and intent, merged from partial sums of every task. A trigger
    writes its moments under its own number, so a trigger that is replayed writes the same again.
    """

    def log(told: DataFrame, trigger: int) -> None:
        told.write.mode("overwrite").parquet(f"{path}/trigger={trigger}")

    query = experiments.moments(runs).writeStream.outputMode("complete").foreachBatch(log)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def last_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of all runs so far, from the last trigger's moments."""
    log = _log(spark, path)
    last = log.agg(F.max("trigger")).first()[0]
    return experiments.summary_of(log.where(F.col("trigger") == last))


def decisions(spark: SparkSession, path: str, **rule) -> DataFrame:
    """trigger, intent, n_a, n_b, decision, winner and stopped_at: the rule as each trigger finds it.

    stopped_at is the first trigger at which an intent's test stops; what comes later doesn't move it.
    """
    out = experiments.decision_of(_log(spark, path), by=("trigger", "intent"), **rule).withColumn("trigger", F.col("trigger").cast("long"))
    first = out.where("decision <> 'continue'").groupBy("intent").agg(F.min("trigger").alias("stopped_at"))
    return out.join(first, "intent", "left").select("trigger", "intent", "n_a", "n_b", "decision", "winner", "stopped_at")
