"""Accepted and corrected feedback by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, DELAY = "1 hour", "2 hours"


def _counts(accepted: Column) -> list[Column]:
    return [F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("corrected")]


def feedback_windows(
    feedback: DataFrame, moment: str = "at", window: str = WINDOW, delay: str = DELAY
) -> DataFrame:
    """Per window of event time how many answers were accepted and how many corrected.

    ``feedback``: a stream (or table) with ``accepted`` (boolean) and the timestamp ``moment``.
    Rows may arrive in any order within ``delay``; a window is given once, in append mode, when
    the latest moment seen is ``delay`` past its end.  State is one small row per open window.
    A row with null ``accepted`` counts for neither and only moves time on, which closes the
    last windows of a feed that ends; rows without a moment are left out.
    """
    windows = feedback.where(F.col(moment).isNotNull()).withWatermark(moment, delay)
    grouped = windows.groupBy(F.window(moment, window)).agg(*_counts(F.col("accepted")))
    return grouped.select("window.start", "window.end", "accepted", "corrected")


def late_counts(
    feedback: DataFrame, closed: DataFrame, moment: str = "at", window: str = WINDOW
) -> DataFrame:
    """What came too late for its window, per closed window: none is lost in silence.

    ``feedback``: all rows so far, as a table; ``closed``: the windows that were given.  Windows
    still open are not among the result, and neither are closed ones that nothing was late for.
    """
    timed = feedback.where(F.col(moment).isNotNull())
    whole = timed.groupBy(F.window(moment, window).alias("w")).agg(*_counts(F.col("accepted")))
    whole = whole.select(F.col("w.start").alias("start"), "accepted", "corrected")
    # A window that only late rows have was closed unseen: closed is what ended by the last one given.
    last = closed.agg(F.max("end")).first()[0]
    seen = closed.select("start", F.col("accepted").alias("given"), F.col("corrected").alias("given_corrected"))
    late = whole.where(F.col("start") < F.lit(last)).join(seen, "start", "left")
    return late.select(
        "start",
        (F.col("accepted") - F.coalesce("given", F.lit(0))).alias("late_accepted"),
        (F.col("corrected") - F.coalesce("given_corrected", F.lit(0))).alias("late_corrected"),
    ).where("late_accepted > 0 OR late_corrected > 0")
