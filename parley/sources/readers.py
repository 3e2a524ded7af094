"""Readers: JSON, JSON Lines, CSV, text folders, in-memory rows."""

from __future__ import annotations

import csv
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.text import strip, unix_newlines
from parley.operators.feedback import parsed_lines
from parley.session import work_folder
from parley.sources import framing, growing
from parley.sources.files import Store

PAIR_SCHEMA = "input STRING, output STRING"
# Per-split line offsets are broadcast up to this many splits (some 20 MB), else joined.
BROADCAST_SPLITS = 100_000


def guard_size(spark: SparkSession, path: str, limit: int = fixed.MAX_FILE_BYTES) -> None:
    """Refuse any single file above ``limit`` bytes."""
    if Store(spark, path).largest() > limit:
        raise ValueError(
            f"File '{path}' exceeds maximum allowed size of {limit // (1024 * 1024)} MB"
        )


def read_json(
    spark: SparkSession, path: str, extra: str | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Pairs from JSON files holding an array of objects or one object.

    ``extra`` names further fields as DDL: then each file is cut into objects by many
    tasks (``framing``).  Without it all fields are inferred by Spark's own reader, to which
    an array is one record, hence one task per file.  Keys are not checked; malformed
    text raises either way.
    """
    if max_bytes is not None:
        guard_size(spark, path, max_bytes)
    if extra is None:
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    schema = f"{PAIR_SCHEMA}, {extra}" if extra else PAIR_SCHEMA
    record = F.from_json("text", schema, {"mode": "FAILFAST"})
    return framing.json_objects(spark, path).select(record.alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Pairs of well-formed JSON Lines by Spark's own parser, with ``extra`` fields as DDL."""
    return spark.read.schema(f"{PAIR_SCHEMA}, {extra}" if extra else PAIR_SCHEMA).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and split they came from."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )


def read_jsonl(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Usable records of JSON Lines files: ``input``, ``output``, ``extras`` (JSON).

    Blank, malformed and key-less lines are skipped.  A key present with null
    counts as present.  A missing path raises.
    """
    if max_bytes is not None:
        guard_size(spark, path, max_bytes)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parsed_lines(lines).where("usable").select("input", "output", "extras")


def numbered_lines(spark: SparkSession, path: str, only_filled: bool = False) -> DataFrame:
    """Lines with their 1-based ``line_no`` within their file (blank ones left
    out of lines and count with ``only_filled``).

    Numbers come from per-split counts, summed per file, plus the place inside
    the split.  The tagged lines are written once to the shared folder, so that both
    uses see the same splits.  With the offsets broadcast, no line is shuffled.
    """
    lines = read_lines(spark, path)
    if only_filled:
        lines = lines.where(strip(F.col("line")) != "")
    folder = work_folder(spark, "lines")
    lines.withColumn("tag", F.monotonically_increasing_id()).write.parquet(folder)
    tagged = spark.read.parquet(folder)
    splits = tagged.groupBy("file", "split_start").agg(
        F.min("tag").alias("first_tag"), F.count("*").alias("lines")
    )
    earlier = Window.partitionBy("file").orderBy("split_start")
    before = F.sum("lines").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(
        "file", "split_start", "first_tag", F.coalesce(before, F.lit(0)).alias("before")
    )
    if splits.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = tagged.join(offsets, ["file", "split_start"])
    place = F.col("tag") - F.col("first_tag") + 1
    return joined.select("file", (F.col("before") + place).alias("line_no"), "line")


def read_jsonl_from(spark: SparkSession, path: str, start_line: int = 0) -> DataFrame:
    """Usable records after ``start_line`` physical lines (blank ones counted) per file."""
    lines = numbered_lines(spark, path).where(F.col("line_no") > start_line)
    return parsed_lines(lines).where("usable").select(
        "file", "line_no", "input", "output", "extras"
    )


def line_totals(spark: SparkSession, path: str) -> DataFrame:
    """Physical and non-empty lines per file: the next offsets."""
    filled = F.count_if(strip(F.col("line")) != "")
    return (
        read_lines(spark, path)
        .groupBy("file")
        .agg(F.count("*").alias("lines"), filled.alias("filled_lines"))
    )


def count_and_read_jsonl(
    spark: SparkSession, path: str, start_line: int = 0
) -> tuple[int, DataFrame]:
    """(non-empty lines, usable records after ``start_line`` non-empty lines).

    Malformed lines count; a missing path gives zero and no rows.
    """
    if not Store(spark, path).exists():
        empty = "file STRING, line_no BIGINT, input STRING, output STRING, extras STRING"
        return 0, spark.createDataFrame([], empty)
    lines = numbered_lines(spark, path, only_filled=True)
    records = parsed_lines(lines.where(F.col("line_no") > start_line)).where("usable")
    # Counted on the written lines: the feed is read once.
    return lines.count(), records.select("file", "line_no", "input", "output", "extras")


def unlisted_files(spark: SparkSession, folder: str) -> list[str]:
    """``*.txt`` files of a folder or glob that Spark's file listing leaves out: those whose
    names start ``_`` or ``.``."""
    return Store(spark, folder).hidden_files(".txt")


def _known_to_arrow(folder: str) -> bool:
    try:
        store, place = growing.opened(folder)
        return store.get_file_info(place).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def files_of(spark: SparkSession, folders: list[str], suffix: str) -> DataFrame:
    """``path`` of the files directly in folders, whatever their names, and of the not hidden ones in
    ``key=value`` folders below; each folder is listed by a task and nothing on the driver."""

    def list_(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, place = growing.opened(folder)
                waiting = [place]
                while waiting:
                    inside = waiting.pop()
                    paths = []
                    for item in store.get_file_info(fs.FileSelector(inside)):
                        name = item.base_name
                        hidden = inside != place and name[0] in "_."
                        if item.type == fs.FileType.File and name.endswith(suffix) and not hidden:
                            paths.append(folder.rstrip("/") + item.path.removeprefix(place.rstrip("/")))
                        elif item.type == fs.FileType.Directory and "=" in name and name[0] not in "_.":
                            waiting.append(item.path)
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    named = spark.createDataFrame([(folder,) for folder in folders], "folder STRING")
    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    return named.repartition(tasks).mapInArrow(list_, "path STRING")


def read_files(paths: DataFrame) -> DataFrame:
    """``path`` and ``content`` of named files, read where they are dealt to."""

    def read(batches):
        for batch in batches:
            held, size = {"path": [], "content": []}, 0
            for path in batch.column(0).to_pylist():
                store, place = growing.opened(path)
                with store.open_input_stream(place) as source:
                    content = source.read()
                held["path"].append(path)
                held["content"].append(content)
                size += len(content)
                if size >= growing.READ_BYTES:
                    yield pa.RecordBatch.from_pydict(held)
                    held, size = {"path": [], "content": []}, 0
            if held["path"]:
                yield pa.RecordBatch.from_pydict(held)

    spark = paths.sparkSession
    # by number, as a table of names is small enough to be joined up for one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return paths.repartition(tasks, "path").mapInArrow(read, "path STRING, content BINARY")


def read_text_folder(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """``*.txt`` files as ``path``, ``name``, ``content``; null content if not UTF-8.

    ``folder`` may be a glob of folders.  One file is one row, as large as a row may be.  The
    driver only learns the names of the folders; their files are listed and read by tasks, those
    whose names start ``_`` or ``.`` as well.  On a store that Arrow does not know Spark lists the
    files on the driver, and such names by a glob of their own.
    ``ordered`` sorts by path (a range shuffle of the texts; leave it off where order does not
    matter).
    """
    folders = Store(spark, folder).folders()
    if folders and _known_to_arrow(folders[0]):
        raw = read_files(files_of(spark, folders, ".txt"))
    else:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
        raw = reader.load(folder).select("path", "content")
        if paths := unlisted_files(spark, folder):
            raw = raw.unionByName(read_files(spark.createDataFrame([(path,) for path in paths], "path STRING")))
    text = F.col("content").cast("string")
    rows = raw.orderBy("path") if ordered else raw
    return rows.select(
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.when(F.is_valid_utf8(text), unix_newlines(text)).alias("content"),
    )


def read_csv(spark: SparkSession, path: str, input_col: str = "question", output_col: str = "answer") -> DataFrame:
    """Pairs from CSV with a header line; quoted cells may hold line breaks and ``""``.

    Files are cut into records by many tasks (``framing``).  The first record of each names
    its columns, the same in all files.  Blank lines are skipped; a malformed row raises, and so
    does a missing column.  Without any file content there are no rows.
    """
    records = framing.csv_rows(spark, path)
    is_header = (F.col("split") == 0) & (F.col("no") == 0)
    header = records.where(is_header).orderBy("file").select("text").first()
    names = next(csv.reader([header["text"]]), []) if header else [input_col, output_col]
    if not {input_col, output_col} <= set(names):
        raise ValueError(f"CSV must have '{input_col}' and '{output_col}' columns")
    schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)
    cells = F.from_csv("text", schema, {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    rows = records.where(~is_header & (F.col("text") != "")).select(cells.alias("r")).select("r.*")
    return rows.withColumnsRenamed({input_col: "input", output_col: "output"})


def add_pairs(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """In-memory rows as pairs; a row lacking a key is refused."""
    rows = list(rows)
    for row in rows:
        if not {"input", "output"} <= row.keys():
            raise ValueError("Conversation must have 'input' and 'output' keys")
    return spark.createDataFrame([(r["input"], r["output"]) for r in rows], PAIR_SCHEMA)


def sample_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.SAMPLE_PAIRS, PAIR_SCHEMA)


def combine(*parts: DataFrame) -> DataFrame:
    """Append datasets whose extra columns may differ."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
