"""Feedback feed to threshold-triggered training batches.

The feed is a folder that gains JSON Lines files, or files that gain lines.  Each micro-batch is parsed and
staged; when the lines staged since the last cycle reach the threshold, their
usable records become the next snapshot of training texts.

State after batch N is one small row computed from the row before it and the
batch's own line counts.  Staging folders, state rows and snapshots are all named
by batch number and overwritten on a retry, so a batch that runs twice leaves the
same result: at-least-once delivery, effectively-once output.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley import fixed_values as fixed
from parley.operators.feedback import parsed_lines
from parley.operators.prep import training_text
from parley.sources.files import Store
from parley.sources.growing import stream_lines
from parley.sources.writers import Snapshots

logger = logging.getLogger(__name__)

#: File times of a store and the driver's clock may differ by so much.
CLOCK_SKEW = timedelta(minutes=5)


def _file_name(column: str) -> Column:
    """A file's name without the escapes that some listings have."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))).alias("name")


@dataclass(frozen=True)
class FeedState:
    """Lines seen and consumed, and the last batch taken into a cycle."""

    lines_total: int = 0
    lines_consumed: int = 0
    consumed_through: int = -1
    cycles: int = 0

    @property
    def pending(self) -> int:
        return self.lines_total - self.lines_consumed


class FeedbackStream:
    def __init__(
        self,
        spark: SparkSession,
        feed: str,
        root: str,
        threshold: int = fixed.FEEDBACK_THRESHOLD,
        growing: bool = False,
    ):
        """``growing``: lines added to files already read are taken too (by ``stream_lines``);
        without it the feed gains whole files, and one that grows raises."""
        self.spark, self.feed, self.root = spark, feed, root.rstrip("/")
        self.growing = growing
        self.threshold = threshold
        self.snapshots = Snapshots(spark, f"{self.root}/cycles")
        self._store = Store(spark, self.root)

    # -- state ---------------------------------------------------------------

    def state(self, before: int | None = None) -> FeedState:
        """The latest state, or the one left by the batches before ``before``."""
        batches = [int(name) for name in self._store.names("state") if name.isdigit()]
        if before is not None:
            batches = [batch for batch in batches if batch < before]
        if not batches:
            return FeedState()
        return FeedState(**json.loads(self._store.read(f"state/{max(batches)}")))

    def _save(self, batch: int, state: FeedState) -> None:
        self._store.write(f"state/{batch}", json.dumps(asdict(state)))
        kept = sorted(int(name) for name in self._store.names("state") if name.isdigit())
        # A retry can only concern the last batch, so two rows are enough.
        for old in kept[:-3]:
            self._store.remove(f"state/{old}")

    # -- one micro-batch -----------------------------------------------------

    def _staged(self, batch: int) -> str:
        return f"{self.root}/staging/batch={batch}"

    def take(self, lines: DataFrame, batch: int) -> None:
        """Stage a micro-batch and start a cycle when enough lines are pending."""
        before = self.state(before=batch)
        parsed_lines(lines).drop("line").write.mode("overwrite").parquet(self._staged(batch))
        if "size" in lines.columns:
            sizes = lines.groupBy("file").agg(F.max("size").alias("size"))
            sizes.write.mode("overwrite").parquet(f"{self.root}/files/batch={batch}")
            self._refuse_grown(batch)
        arrived = self.spark.read.parquet(self._staged(batch)).count()
        after = FeedState(
            before.lines_total + arrived,
            before.lines_consumed,
            before.consumed_through,
            before.cycles,
        )
        due = after.pending >= self.threshold
        if due:
            after = self._cycle(after, batch)
        self._save(batch, after)
        if due:
            self._tidy(after)

    def _refuse_grown(self, batch: int) -> None:
        """Raise if a file already taken is longer now: its new lines would be lost.

        Only files modified since the check before are looked at, and the sizes of earlier
        batches are read only if one of those is not of this batch.
        """
        checks = [int(name) for name in self._store.names("checks") if name.isdigit()]
        earlier = [number for number in checks if number < batch]
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if earlier:
            reader = reader.option("modifiedAfter", self._store.read(f"checks/{max(earlier)}"))
        began = datetime.now(timezone.utc) - CLOCK_SKEW
        listed = reader.option("timeZone", "UTC").load(self.feed).select(_file_name("path"), "length")
        taken = self.spark.read.parquet(f"{self.root}/files").select("batch", _file_name("file"), "size")
        others = listed.join(taken.where(F.col("batch") == batch), "name", "left_anti")
        if not others.isEmpty():
            grown = others.join(taken, "name").groupBy("name", "length").agg(F.max("size").alias("size"))
            if first := grown.where("length > size").first():
                raise ValueError(f"feed file {first['name']} has grown after it was taken: add new files instead")
        self._store.write(f"checks/{batch}", began.strftime("%Y-%m-%dT%H:%M:%S"))
        for old in sorted(checks)[:-3]:
            self._store.remove(f"checks/{old}")

    def finish(self) -> None:
        """Start a last cycle over the lines that are still below the threshold, if the
        feed as a whole has reached it."""
        state = self.state()
        batches = [int(name) for name in self._store.names("state") if name.isdigit()]
        if state.pending and state.lines_total >= self.threshold:
            self._save(max(batches), self._cycle(state, max(batches)))

    def _cycle(self, state: FeedState, batch: int) -> FeedState:
        taken = range(state.consumed_through + 1, batch + 1)
        paths = [self._staged(number) for number in taken if self._store.exists(f"staging/batch={number}")]
        records = self.spark.read.parquet(*paths).where("usable")
        if records.isEmpty():
            logger.warning("No usable records in %d new lines; cycle skipped", state.pending)
        else:
            texts = records.select(
                "input", "output", "extras", training_text(F.col("input"), F.col("output")).alias("text")
            )
            self.snapshots.publish(texts, batch)
        # The lines count as consumed whether or not any was usable.
        return FeedState(state.lines_total, state.lines_total, batch, state.cycles + 1)

    def _tidy(self, state: FeedState) -> None:
        """Drop staging folders of cycles before the last published one."""
        published = self.snapshots.versions()
        settled = published[-2] if len(published) > 1 else -1
        for name in self._store.names("staging"):
            if int(name.split("=")[1]) <= min(settled, state.consumed_through):
                self._store.remove(f"staging/{name}")

    # -- running -------------------------------------------------------------

    def start(self, once: bool = False, files_per_batch: int | None = None) -> StreamingQuery:
        """Start reading; ``once`` drains what is there and stops.

        A growing feed is taken as it stands, so ``files_per_batch`` does not apply to it.
        """
        if self.growing:
            lines = stream_lines(self.spark, self.feed)
        else:
            reader = self.spark.readStream
            if files_per_batch:
                reader = reader.option("maxFilesPerTrigger", files_per_batch)
            lines = reader.text(self.feed).select(
                F.col("value").alias("line"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_size").alias("size"),
            )
        writer = (
            lines.writeStream.foreachBatch(self.take)
            .queryName("feedback_cycles")
            .option("checkpointLocation", f"{self.root}/checkpoint")
        )
        if once:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{fixed.POLL_SECONDS} seconds").start()


def run_with_budget(
    start: Callable[[], StreamingQuery],
    progressed: Callable[[], int],
    failures: int = fixed.MAX_FAILURES,
) -> None:
    """Restart a failing query; give up after ``failures`` in a row without progress."""
    in_a_row, mark = 0, progressed()
    while True:
        try:
            start().awaitTermination()
            return
        except Exception as problem:
            here = progressed()
            in_a_row = 1 if here > mark else in_a_row + 1
            mark = here
            logger.error("Feedback stream failed (%d/%d): %s", in_a_row, failures, problem)
            if in_a_row >= failures:
                raise


class LogStream:
    """Exchange folder to conversation log, in micro-batches of whole files."""

    SCHEMA = "prompt STRING, response STRING"

    def __init__(self, spark: SparkSession, source: str, root: str):
        self.spark, self.source, self.root = spark, source, root.rstrip("/")

    def start(self, once: bool = False, files_per_batch: int = fixed.LOG_FLUSH_ROWS) -> StreamingQuery:
        from parley.operators.feedback import conversation_log

        rows = (
            self.spark.readStream.schema(self.SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .json(self.source)
        )
        writer = (
            conversation_log(rows)
            .writeStream.format("json")
            .option("path", f"{self.root}/log")
            .option("checkpointLocation", f"{self.root}/checkpoint")
        )
        if once:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{fixed.POLL_SECONDS} seconds").start()

    def flush(self, query: StreamingQuery) -> None:
        """Write everything that has arrived so far."""
        query.processAllAvailable()


class FailsOnce(FeedbackStream):
    """For drills: the first batch that publishes fails before its state is saved."""

    failed = False

    def _save(self, batch: int, state: FeedState) -> None:
        if state.cycles and not self.failed:
            self.failed = True
            raise OSError("drill: the batch is lost after publishing")
        super()._save(batch, state)
