"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import work_folder

#: Rows of a table that may be broadcast; more are joined with salted keys.
BROADCAST_ROWS = 20_000
SALTS = 16


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once to the shared folder and read again.

    Lost executors then cost a read, not a recomputation, and values that depend on
    how rows met are the same for every reader.
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of like-named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def look_up(
    rows: DataFrame, table: DataFrame, names: list[str], spread_by: Column, how: str = "left"
) -> DataFrame:
    """Join each row with the at most one row of ``table`` that has its ``names``.

    ``table`` must be cheap to read (stored).  It is broadcast if it has at most
    ``BROADCAST_ROWS`` rows; otherwise every key is split into ``SALTS`` parts, chosen
    per row by ``spread_by``, so that a key with a third of all rows is spread too.
    Column names of ``table`` other than ``names`` must not occur in ``rows``.
    """
    table = table.withColumnsRenamed({n: f"{n}__key" for n in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"{name}__key"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(table), condition, how)
    else:
        table = table.withColumn("salt__key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt__row", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
        condition = condition & (F.col("salt__row") == F.col("salt__key"))
        joined = rows.join(table, condition, how).drop("salt__key", "salt__row")
    return joined.drop(*[f"{n}__key" for n in names])
