"""A cache of answered questions for each session, with a life that starts at the first question and ends with the session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

ASKED = StructType([StructField("session_id", StringType()), StructField("turn", LongType()), StructField("key", StringType()), StructField("hit", BooleanType())])


class SessionCache(StatefulProcessor):
    """The keys that a session has asked for since its life began; a timer clears them when it ends."""

    def __init__(self, seconds: int) -> None:
        self.life = 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", StructType([StructField("ms", LongType())]))
        self.keys = handle.getMapState("keys", StructType([StructField("key", StringType())]), StructType([StructField("turn", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began = self.began.get()[0] if self.began.exists() else None
        own = pd.concat(list(rows)).sort_values(["asked_ms", "turn"], kind="stable")
        hits = []
        for r in own.itertuples(index=False):
            if began is None or r.asked_ms >= began + self.life:
                self.keys.clear()
                began = int(r.asked_ms)
                self.began.update((began,))
                self.handle.registerTimer(began + self.life)
            hits.append(self.keys.containsKey((r.key,)))
            if not hits[-1]:
                self.keys.updateValue((r.key,), (int(r.turn),))
        yield pd.DataFrame({"session_id": key[0], "turn": own["turn"].to_numpy(), "key": own["key"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of a life that a later question has ended already finds another one
        if self.began.exists() and self.began.get()[0] + self.life <= expiredTimerInfo.getExpiryTimeInMs():
            self.keys.clear()
            self.began.clear()
        yield from ()

    def close(self) -> None:
        pass


def answered(questions: DataFrame, seconds: int = 1800, late: str = "0 seconds") -> DataFrame:
    """session_id, turn, key and hit of every question of a stream: whether the session's cache held its answer.

    ``questions`` has session_id, turn, asked (a timestamp) and key. A session's cache lives for
    ``seconds`` from its first question; the first one after that begins another life, with nothing in
    it. Questions of a trigger are taken in order of time and turn. Keys of different sessions never meet.
    Rows without a session, time or key are left out.
    """
    rows = questions.where("session_id IS NOT NULL AND asked IS NOT NULL AND key IS NOT NULL").withWatermark("asked", late)
    told = rows.select("session_id", "asked", F.unix_millis("asked").alias("asked_ms"), F.col("turn").cast("long").alias("turn"), "key")
    return told.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionCache(seconds), outputStructType=ASKED, outputMode="Append", timeMode="EventTime")
