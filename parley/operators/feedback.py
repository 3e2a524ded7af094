"""Feedback labelling, the conversation log and feed counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.jsontext import parse_record
from parley.functions.text import strip
from parley.session import computed_once


def is_quit(prompt: Column) -> Column:
    return F.lower(strip(prompt)).isin(fixed.QUIT_WORDS)


#: Places of a session that are looked at together.
SESSION_BLOCK = 4096


def open_prompts(df: DataFrame, session: str | None = None, order: str = "turn") -> DataFrame:
    """Prompts that reach the model: stripped, not blank, before the quit word.

    Without ``session`` columns a quit word only drops its own row.  With them a session ends at
    its first quit.  That is found per block of ``order`` (a long), carried on over the blocks of a
    session (one narrow row each), and joined by session and block, so that a session with a
    third of all rows is dealt to as many tasks as it has blocks.  A null order is a block of its
    own, ended by a quit in it or before.
    """
    asked = df.withColumn("prompt", strip(F.col("prompt")))
    filled = (F.col("prompt") != "") & ~is_quit(F.col("prompt"))
    if session is None:
        return asked.where(filled).select(*df.columns)
    block = F.floor(F.col(order) / SESSION_BLOCK)
    quit_at = F.min(F.when(is_quit(F.col("prompt")), F.col(order)))
    blocks = df.groupBy(F.col(session).alias("_session"), block.alias("_block")).agg(quit_at.alias("_quit_at"))
    so_far = Window.partitionBy("_session").orderBy(F.asc_nulls_last("_block"))
    blocks = blocks.withColumn("_quit_at", F.min("_quit_at").over(so_far)).where("_quit_at IS NOT NULL")
    same = F.col(session).eqNullSafe(F.col("_session")) & F.col("_at").eqNullSafe(F.col("_block"))
    kept = asked.withColumn("_at", block).join(blocks, same, "left")
    before = F.col("_quit_at").isNull() | (F.col(order) < F.col("_quit_at"))
    return kept.where(before & filled).select(*df.columns)


def label_feedback(df: DataFrame) -> DataFrame:
    """(prompt, response, correction) to approved pairs.

    A blank or missing correction accepts the response.
    """
    correction = strip(F.coalesce("correction", F.lit("")))
    accepted = correction == ""
    kept = [name for name in df.columns if name not in ("prompt", "response", "correction")]
    return df.select(
        *kept,
        F.col("prompt").alias("input"),
        F.when(accepted, F.col("response")).otherwise(correction).alias("output"),
        accepted.alias("accepted"),
    )


def stamped(df: DataFrame) -> DataFrame:
    """Add the current local time as an ISO text ``timestamp``."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumn("timestamp", now)


def compact_stamp(moment: Column) -> Column:
    """UTC stamp such as 20240601T120000123456, which sorts by time as text."""
    zone = F.to_utc_timestamp(moment, F.current_timezone())
    return F.concat(
        F.date_format(zone, "yyyyMMdd"), F.lit("T"), F.date_format(zone, "HHmmssSSSSSS")
    )


def conversation_log(df: DataFrame) -> DataFrame:
    """(prompt, response) rows as logged pairs."""
    return stamped(df.select(F.col("prompt").alias("input"), F.col("response").alias("output")))


def parsed_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Feed lines with ``usable``, ``kind``, ``input``, ``output`` and ``extras``; blanks dropped."""
    filled = lines.where(strip(F.col(line_col)) != "")
    parsed = computed_once(filled, "_record", parse_record(F.col(line_col)))
    return parsed.select(
        *lines.columns, *[f"_record.{name}" for name in ("usable", "kind", "input", "output", "extras")]
    )


def line_kinds(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Filled lines by kind: usable, malformed, keyless, undecodable."""
    return parsed_lines(lines.select(line_col), line_col).groupBy("kind").agg(F.count("*").alias("lines"))


def feed_counters(lines: DataFrame, consumed: int, line_col: str = "line") -> DataFrame:
    """Non-empty lines in the feed, lines consumed, and the difference.

    ``new`` goes negative when the feed was truncated; it is shown, not hidden.
    """
    filled = F.count_if(strip(F.col(line_col)) != "")
    return lines.agg(filled.alias("total")).select(
        "total",
        F.lit(consumed).cast("bigint").alias("consumed"),
        (F.col("total") - consumed).alias("new"),
    )
