"""Writers: JSON Lines, logs, feedback, formatted predictions, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.feedback import compact_stamp, stamped
from parley.operators.forecast import format_predictions
from parley.session import work_folder
from parley.sources.files import Store


def require_pair_columns(df: DataFrame) -> None:
    if not {"input", "output"} <= set(df.columns):
        raise ValueError("Record must have 'input' and 'output' keys")


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Pairs as JSON Lines; null fields are written out, non-ASCII text kept."""
    require_pair_columns(df)
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, *order: str) -> None:
    """Pairs as one file holding a JSON array, one object a line, in the given order.

    Rows are sorted by ranges and written by many tasks; the parts are then joined stream to
    stream, never collected.  Null fields are written out, non-ASCII text kept; an empty table
    gives ``[]``.  An existing file is replaced in one step.
    """
    require_pair_columns(df)
    store = Store(df.sparkSession, path.rpartition("/")[0])
    parts = work_folder(df.sparkSession, "parts")
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # Every object brings the comma before it; the very first one is skipped.
    sorted_rows.select(F.concat(F.lit(","), record).alias("value")).write.text(parts)
    store.join_parts(Store(df.sparkSession, parts), path.rpartition("/")[2], "[", "]", 1)


def append_log(df: DataFrame, path: str) -> None:
    """Append logged pairs; earlier files stay as they are."""
    require_pair_columns(df)
    df.write.mode("append").json(path)


def save_log(df: DataFrame, path: str | None) -> None:
    """Write the whole log, replacing what is there."""
    if not path:
        raise ValueError("No log file path specified")
    require_pair_columns(df)
    df.write.mode("overwrite").json(path)


def clear_log(spark: SparkSession, path: str) -> None:
    empty = spark.createDataFrame([], "input STRING, output STRING, timestamp STRING")
    empty.write.mode("overwrite").json(path)


def read_log(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Logged pairs; ``extra`` names further fields as DDL."""
    fields = "input STRING, output STRING, timestamp STRING"
    return spark.read.schema(f"{fields}, {extra}" if extra else fields).json(path)


def append_feedback(labelled: DataFrame, path: str) -> None:
    """Append approved pairs, stamped, as new files of the feed folder."""
    write_jsonl(stamped(labelled.select("input", "output", "accepted")), path)


def filtered_path(path: str) -> str:
    """``pairs.json`` to ``pairs_filtered.json``."""
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    if not stem:
        stem, dot, suffix = name, "", ""
    return f"{folder}{slash}{stem}_filtered{dot}{suffix}"


def append_exchanges(df: DataFrame, path: str) -> None:
    """Append (request_json, response) rows with their UTC stamp."""
    stamp = compact_stamp(F.current_timestamp())
    df.select(stamp.alias("stamp"), "request_json", "response").write.mode("append").json(path)


def write_predictions(
    df: DataFrame, path: str, fmt: str = "table", targets: list[str] | None = None
) -> None:
    """The lines of :func:`format_predictions`, in order, as text files."""
    lines = format_predictions(df, fmt, targets)
    lines.orderBy("line_kind", "datetime").select("line").write.mode("overwrite").text(path)


class Snapshots:
    """Versioned dataset: write a new version, then point to it.

    Every version stays unless ``keep`` says how many of the last ones do.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        self._spark, self._keep = spark, keep
        self._store = Store(spark, root)
        self.root = root.rstrip("/")

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        names = self._store.names("pointers")
        return sorted(int(name) for name in names if name.isdigit())

    def current(self) -> int | None:
        published = self.versions()
        return published[-1] if published else None

    def publish(self, df: DataFrame, version: int) -> None:
        """Idempotent: publishing a version again replaces its data."""
        df.write.mode("overwrite").parquet(f"{self.root}/data/version={version}")
        self._store.write(f"pointers/{version}", json.dumps({"version": version}))
        for old in self.versions()[: -self._keep] if self._keep else []:
            self._store.remove(f"pointers/{old}")
            self._store.remove(f"data/version={old}")

    def read(self, version: int | None = None) -> DataFrame:
        chosen = self.current() if version is None else version
        if chosen is None:
            raise ValueError(f"nothing published under {self.root}")
        return self._spark.read.parquet(f"{self.root}/data/version={chosen}")

    def read_all(self) -> DataFrame:
        """The rows of every published version, with their ``version``."""
        paths = [f"{self.root}/data/version={version}" for version in self.versions()]
        if not paths:
            raise ValueError(f"nothing published under {self.root}")
        return self._spark.read.option("basePath", f"{self.root}/data").parquet(*paths)
