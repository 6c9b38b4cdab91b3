"""Counters of a job's stages, taken from the rows as they pass: no stage runs twice for its count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Watch frames of one job; ``counts`` has their numbers once an action has run over the last of them.

    A frame's counts are those of the first action that reads all of it. Frames that the optimizer
    doesn't read, as nothing of them is needed, are not counted.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, stage: str, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows``, unchanged, with their number and the characters of ``text`` counted under ``stage``."""
        seen = Observation(f"{stage}-{len(self._seen)}")
        self._seen.append((stage, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))

    def counts(self, spark: SparkSession) -> DataFrame:
        """seq, stage, n_rows and n_chars, a row for each watched frame in order."""
        rows = [(k, stage, seen.get["n_rows"], seen.get["n_chars"]) for k, (stage, seen) in enumerate(self._seen)]
        return spark.createDataFrame(rows, "seq int, stage string, n_rows long, n_chars long")
