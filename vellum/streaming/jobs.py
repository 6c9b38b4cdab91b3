"""OCR jobs as state machines over a stream of poll responses.

A job is polled until it has succeeded or failed, up to a number of attempts and for a limited time;
after success its batches are fetched token by token. Every job gives one result: SUCCEEDED once its
last batch is there, FAILED, or TIMED_OUT. The states of jobs live in the state store, many in a bucket,
with a timer for the earliest time limit of a bucket, so a restart goes on where the last trigger ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Seconds between polls and how often a job is polled.
POLL_SECONDS, MOST_POLLS = 5, 120

RESULT = StructType([
    StructField("job_id", StringType()), StructField("outcome", StringType()), StructField("attempts", LongType()),
    StructField("n_batches", LongType()), StructField("ended_ms", LongType()),
])
#: What is kept of a bucket: its open jobs and the names of those that have ended, each as an Arrow stream.
_STATE = StructType([StructField("open", BinaryType()), StructField("ended", BinaryType())])
_COUNTS = ("started", "attempts", "batches", "awaited", "first", "last")
_OPEN = pa.schema([("job_id", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])
_ENDED = pa.schema([("job_id", pa.string())])
_ROW = {"job_id": pa.string(), "batch": pa.string(), "asked_ms": pa.int64(), "status": pa.int32(), "polled": pa.bool_(), "last": pa.bool_(), "awaited": pa.int64()}


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(stream)).read_all()


def _names(*tables: pa.Table) -> pa.Array:
    return pa.concat_arrays([c for t in tables for c in t["job_id"].chunks] or [pa.array([], pa.string())])


def _arrived(frames: Iterator[pd.DataFrame], ended: pa.Table) -> pa.Table:
    """A trigger's rows of jobs that haven't ended."""
    rows = pd.concat(list(frames))
    rows = pa.table({c: pa.array(rows[c], kind, from_pandas=True) for c, kind in _ROW.items()})
    return rows.filter(pc.invert(pc.is_in(rows["job_id"], value_set=_names(ended))))


def job_machine(most_polls: int, limit: int):
    """The states of a bucket's jobs: polling, fetching (succeeded, some batch missing), ended.

    Whether all batches are there is told without keeping them: each token that a batch names is awaited
    once and each that a batch was asked for with comes once, so in whole chains the sum of both kinds'
    hashes cancels out. The job is complete when it does, with a first and a last batch seen.
    """

    def moved(n: int, job: np.ndarray, rows: pa.Table, held: dict[str, np.ndarray], outcome: np.ndarray, ended_ms: np.ndarray) -> None:
        """Take ``rows`` of the jobs numbered ``job``, of which ``n`` were known, each job's in the order in which they were asked for."""
        asked = rows["asked_ms"].to_numpy()
        begins = np.flatnonzero(np.diff(job, prepend=-1))
        own, lengths = job[begins], np.diff(begins, append=len(job))
        held["started"][own[own >= n]] = asked[begins[own >= n]]
        due = held["started"][job] + limit
        over, status = asked > due, rows["status"].to_numpy()
        succeeded, failed, polled = (status == 1) & ~over, (status == 2) & ~over, rows["polled"].to_numpy() & ~over
        steps = {
            "attempts": polled, "batches": succeeded, "first": succeeded & polled, "last": succeeded & rows["last"].to_numpy(),
            "awaited": np.where(succeeded, rows["awaited"].to_numpy(), 0),
        }
        now = {}
        for c, step in steps.items():
            # a running sum over each job, from where it stood; over all jobs it may wrap, differences don't
            step = step.astype(np.int64)
            total = np.cumsum(step)
            now[c] = total - np.repeat(total[begins] - step[begins] - held[c][own], lengths)
        whole = succeeded & (now["awaited"] == 0) & (now["first"] > 0) & (now["last"] > 0)
        given_up = over | ((status == 0) & (now["attempts"] >= most_polls))
        # the row that ends each job, the first of its kind, or its last one
        at = np.minimum.reduceat(np.where(failed | whole | given_up, np.arange(len(job)), len(job)), begins)
        ends, at = at < len(job), np.minimum(at, begins + lengths - 1)
        for c in steps:
            held[c][own] = now[c][at]
        outcome[own[ends]] = np.select([failed, whole], ["FAILED", "SUCCEEDED"], "TIMED_OUT")[at[ends]]
        ended_ms[own[ends]] = np.where(over, due, asked)[at[ends]]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, ended = map(_unpacked, state.get) if state.exists else (_OPEN.empty_table(), _ENDED.empty_table())
        # a trigger's rows: polls and batches since the last one; none if it is time that has passed
        rows = None if state.hasTimedOut else _arrived(frames, ended)
        n, names = len(known), _names(known) if rows is None else _names(known, rows)
        names = names.dictionary_encode()  # numbered as they come, so those known keep their places
        jobs = len(names.dictionary)
        held = {c: np.concatenate([known[c].to_numpy(), np.zeros(jobs - n, np.int64)]) for c in _COUNTS}
        outcome, ended_ms = np.full(jobs, "", "U9"), np.zeros(jobs, np.int64)
        if rows is not None and len(rows):
            rows = rows.append_column("job", names.indices[n:]).sort_by([("job", "ascending"), ("asked_ms", "ascending"), ("batch", "ascending")])
            moved(n, rows["job"].to_numpy(), rows, held, outcome, ended_ms)
        clock, due = state.getCurrentWatermarkMs(), held["started"] + limit
        late = (outcome == "") & (clock > due)
        outcome[late], ended_ms[late] = "TIMED_OUT", due[late]
        done = outcome != ""
        left = pa.table([names.dictionary, *held.values()], schema=_OPEN).filter(pa.array(~done))
        gone = names.dictionary.filter(pa.array(done))
        state.update((_packed(left), _packed(pa.table([_names(ended, pa.table([gone], schema=_ENDED))], schema=_ENDED))))
        if len(left):
            # a timeout comes once the watermark has passed its time
            state.setTimeoutTimestamp(max(1, int(due[~done].min())))
        if len(gone):
            yield pd.DataFrame({"job_id": gone.to_pandas(), "outcome": outcome[done], "attempts": held["attempts"][done], "n_batches": held["batches"][done], "ended_ms": ended_ms[done]})

    return run


def job_results(responses: DataFrame, most_polls: int = MOST_POLLS, seconds: int = POLL_SECONDS * MOST_POLLS, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """job_id, outcome, attempts, n_batches and ended_ms of every job of a stream, one row each.

    ``responses`` has job_id, batch, asked (a timestamp), status, request_token and next_token; tokens
    are unique in a job. A poll is a response without a request_token. Attempts count polls; one that
    leaves a job undecided as its ``most_polls``th ends it, as does a response asked for more than
    ``seconds`` after the first, or time itself: a job is timed out once the stream's watermark passes
    its limit. What arrives after a job's end changes nothing. Rows without a job_id are left out.

    The states of jobs lie in ``buckets`` by the job's hash, a number that stays with a checkpoint. A
    trigger reads and writes the buckets that it touches whole, the names of ended jobs among them, and
    a bucket has to fit into a task, so streams of more than some 10^9 jobs want more of them.
    """
    rows = responses.where("job_id IS NOT NULL AND asked IS NOT NULL").withWatermark("asked", late)
    # 48 bits a token, so that sums of many stay far from a long's bounds
    number = lambda token: F.when(F.col(token).isNull(), 0).otherwise(F.shiftrightunsigned(F.xxhash64(token), 16))
    told = rows.select(
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("jobs"), F.col("job_id").cast("string").alias("job_id"), "asked", F.col("batch").cast("string").alias("batch"), F.unix_millis("asked").alias("asked_ms"),
        F.when(F.col("status") == "SUCCEEDED", 1).when(F.col("status") == "FAILED", 2).otherwise(0).alias("status"),
        F.col("request_token").isNull().alias("polled"), F.col("next_token").isNull().alias("last"),
        (number("next_token") - number("request_token")).alias("awaited"),
    )
    # rows and states of many jobs go to Python together, none asks the store for its own
    return told.groupBy("jobs").applyInPandasWithState(job_machine(most_polls, 1000 * seconds), RESULT, _STATE, "append", "EventTimeTimeout")
