"""Conversation logs flushed by row count, by a timer, and at stop.

Every session has a counter and a buffer of less than ``flush_rows`` rows, kept as
streaming state.  Whenever the buffer is full it becomes one flush; what is left waits
for more rows, for the timer, or for a control row: ``FLUSH`` writes it now, ``STOP``
writes it and ends the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley import fixed_values as fixed
from parley.operators.feedback import stamped

FLUSH, STOP, COUNT, TIMER = "FLUSH", "STOP", "count", "timer"
IDLE_MS = 60_000
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
OUTPUT = (
    "session STRING, flush_no BIGINT, cause STRING, place INT, input STRING, output STRING, timestamp STRING"
)
STATE = "held STRING, flushes BIGINT"
ROW = ["input", "output", "timestamp"]


def flush_by_count(
    rows: DataFrame, flush_rows: int = fixed.LOG_FLUSH_ROWS, idle_ms: int = IDLE_MS
) -> DataFrame:
    """Stream of flushed rows: ``session``, ``flush_no`` (0-based), ``cause``, ``place`` in the flush.

    ``rows``: ``session``, ``control`` (null, ``FLUSH`` or ``STOP``), ``input``, ``output`` and
    ``timestamp``.  A control row takes effect after the rows of its micro-batch; of two in one
    batch ``STOP`` wins.  A session that goes on after its stop counts its flushes anew.  Null
    sessions are one session, null fields stay null.  A session's rows are taken a chunk at a
    time; state holds at most ``flush_rows`` - 1 of them, however many arrive.
    """

    def flush(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, flushes = state.get if state.exists else ("[]", 0)
        held, control, out = json.loads(held), None, []

        def write(rows: list, cause: str) -> None:
            nonlocal flushes
            out.extend((*key, flushes, cause, place, *row) for place, row in enumerate(rows))
            flushes += 1

        def batch() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["session", "flush_no", "cause", "place", *ROW])
            out.clear()
            return frame

        if state.hasTimedOut:
            chunks = iter(())
            if held:
                write(held, TIMER)
            held = []
        for chunk in chunks:
            for signal, *row in chunk[["control", *ROW]].itertuples(index=False, name=None):
                if isinstance(signal, str):
                    control = STOP if STOP in (control, signal) else FLUSH
                    continue
                held.append([value if isinstance(value, str) else None for value in row])
                if len(held) == flush_rows:
                    write(held, COUNT)
                    held = []
            yield batch()
        if control and held:
            write(held, control)
            held = []
        if control == STOP:
            state.remove()
        else:
            state.update((json.dumps(held), flushes))
            if held:
                state.setTimeoutDuration(idle_ms)
        yield batch()

    return rows.groupBy("session").applyInPandasWithState(
        flush, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class CountedLogStream:
    """Exchange folder to a log of flushes; each flush is whole in one micro-batch of the log."""

    SCHEMA = "session STRING, control STRING, prompt STRING, response STRING"

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        root: str,
        flush_rows: int = fixed.LOG_FLUSH_ROWS,
        idle_ms: int = IDLE_MS,
    ):
        self.spark, self.source, self.root = spark, source, root.rstrip("/")
        self.flush_rows, self.idle_ms = flush_rows, idle_ms

    def start(self, once: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
        reader = self.spark.readStream.schema(self.SCHEMA)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = stamped(
            reader.json(self.source).select(
                "session", "control", F.col("prompt").alias("input"), F.col("response").alias("output")
            )
        )
        writer = (
            flush_by_count(rows, self.flush_rows, self.idle_ms)
            .writeStream.format("json")
            .option("path", f"{self.root}/log")
            .option("checkpointLocation", f"{self.root}/checkpoint")
        )
        if once:
            # A timer keeps asking for batches without data, so a run that drains would never end:
            # there it is looked at with every batch of data only.
            kept = self.spark.conf.get(EMPTY_BATCHES)
            self.spark.conf.set(EMPTY_BATCHES, "false")
            try:
                return writer.trigger(availableNow=True).start()
            finally:
                self.spark.conf.set(EMPTY_BATCHES, kept)
        return writer.trigger(processingTime=f"{fixed.POLL_SECONDS} seconds").start()

    def log(self) -> DataFrame:
        """The flushed rows so far; files of batches that failed midway are not among them."""
        return self.spark.read.schema(OUTPUT).json(f"{self.root}/log")
