"""Lines of files that grow, as a stream.

The offset is the size of every file.  A batch reads what was added to each, cut into
splits that are read by tasks of their own.  A line belongs to the split its line end
lies in, so no split needs to know another, and a last line without its end waits until
that is written.  A split that a line started before reads back to the line's start.

Files are opened with Arrow's file systems (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
SCHEMA = "file STRING, at BIGINT, data BINARY"


@dataclass
class Added(InputPartition):
    """Bytes of a file whose line ends are to be read."""

    file: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """Sizes of a file or of all files below a folder but those starting ``_`` or ``.``."""
    store, place = opened(path)
    found = store.get_file_info(place)
    if found.type == fs.FileType.Directory:
        listed = store.get_file_info(fs.FileSelector(place, recursive=True))
        place = found.path.rstrip("/")
    else:
        listed = [found]
    files = (f for f in listed if f.type == fs.FileType.File and f.base_name[0] not in "_.")
    hidden = ("/_", "/.")
    return {f.path: f.size for f in files if not any(h in f.path.removeprefix(place) for h in hidden)}


def splits(start: dict[str, int], end: dict[str, int], split_bytes: int) -> list[Added]:
    """What was added to each file; one that got shorter raises, as its lines are not known."""
    added = []
    for file, size in end.items():
        done = start.get(file, 0)
        if size < done:
            raise ValueError(f"feed file {file} shrank from {done} to {size} bytes: add to it or start anew")
        added += [Added(file, at, min(at + split_bytes, size)) for at in range(done, size, split_bytes)]
    return added


def line_start(source: pa.NativeFile, before: int, block: int = 1 << 16) -> int:
    """Place after the last line end ahead of ``before``."""
    while before > 0:
        at = max(0, before - block)
        source.seek(at)
        found = source.read(before - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        before, block = at, block * 2
    return 0


def lines_of(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that end inside a split, read a block at a time."""
    at, held = start, None
    while at < end:
        source.seek(at)
        block = source.read(min(READ_BYTES, end - at))
        if not block:
            return
        first = block.find(b"\n")
        if first < 0:
            held = held and [*held, block]
        else:
            if held is None:  # the first line end of the split: its line may start before
                place = line_start(source, start)
                source.seek(place)
                held = [source.read(at - place)]
            else:
                place = at - sum(map(len, held))
            *done, rest = b"".join([*held, block]).split(b"\n")
            for line in done:
                yield place, line
                place += len(line) + 1
            held = [rest]
        at += len(block)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[Added]:
        return splits(start, end, self.split_bytes)

    def read(self, partition: Added) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as source:
            places, lines, size = [], [], 0
            for place, line in lines_of(source, partition.start, partition.end):
                places.append(place)
                lines.append(line)
                size += len(line)
                if size > READ_BYTES or len(lines) >= 10_000:
                    yield self._batch(partition.file, places, lines)
                    places, lines, size = [], [], 0
            if lines:
                yield self._batch(partition.file, places, lines)

    @staticmethod
    def _batch(file: str, places: list[int], lines: list[bytes]) -> pa.RecordBatch:
        names = pa.array([file] * len(lines), pa.string())
        columns = [names, pa.array(places, pa.int64()), pa.array(lines, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["file", "at", "data"])


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options["splitBytes"]))


def stream_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stream of ``file``, ``at`` (byte at which the line starts) and ``line``.

    New files and new lines of files known are both read, each line once, when its line end
    is there.  ``\\r\\n`` and a lone ``\\r`` end lines too, as in any text file; the parts of such a line
    share their place.  Bytes that are no UTF-8 are kept, for the parser to report.
    """
    spark.dataSource.register(GrowingLines)
    raw = (
        spark.readStream.format("growing_lines")
        .option("path", path)
        .option("splitBytes", split_bytes)
        .load()
    )
    line = F.col("data").cast("string")
    whole = F.when(F.endswith(line, F.lit("\r")), F.expr("left(CAST(data AS STRING), length(CAST(data AS STRING)) - 1)")).otherwise(line)
    parts = F.when(F.contains(whole, F.lit("\r")), F.split(whole, "\r")).otherwise(F.array(whole))
    return raw.select("file", "at", F.explode(parts).alias("line"))
